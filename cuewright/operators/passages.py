"""Passages: the text of a video cut into sentences or word windows and packed, each with its time and its cues."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import scan
from .timeline import interpolate, spans

SENTENCE_END = r"""[.!?]+["')\]]*$"""
PASSAGES = "video_id string, idx int, text string, start_s double, end_s double, seg_start int, seg_end int, char_start int, char_end int, n_chars int"


@dataclass(frozen=True)
class Packing:
    """Everything that moves the edges of passages."""

    max_chars: int = 900
    overlap_chars: int = 150
    min_chars: int = 250
    words_per_window: int = 28
    punctuation_density_threshold: float = 0.004
    version: int = 1

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def words(timeline: DataFrame) -> DataFrame:
    """A row for each word with its place in the video's text, its times and its cue; the cue knows the time, so nothing is joined."""
    each = timeline.select("video_id", "seg_index", "char_start", "char_end", "t_start", "t_end", F.posexplode(F.split("text", " ")).alias("k", "word"))
    line = Window.partitionBy("video_id").orderBy("seg_index", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = (F.sum(F.char_length("word") + 1).over(line) - 1).cast("int")
    each = each.withColumn("word_end", end).withColumn("word_start", F.col("word_end") - F.char_length("word"))
    at = lambda pos: interpolate(F.col(pos), F.col("char_start"), F.col("char_end"), F.col("t_start"), F.col("t_end"))
    return each.filter("word <> ''").select("video_id", "word", "word_start", "word_end", at("word_start").alias("from_s"), at("word_end").alias("to_s"), "seg_index")


def densities(timeline: DataFrame) -> DataFrame:
    """(video_id, density): sentence ends per character of the whole text."""
    chars = F.sum(F.char_length("text") + 1) - 1
    return timeline.groupBy("video_id").agg((F.sum(F.regexp_count("text", F.lit("[.!?]"))) / F.nullif(chars, F.lit(0))).alias("density"))


def strategies(timeline: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """(video_id, strategy): `sentences` in videos with enough punctuation, else `windows`."""
    enough = F.coalesce("density", F.lit(0.0)) >= packing.punctuation_density_threshold
    return densities(timeline).select("video_id", F.when(enough, "sentences").otherwise("windows").alias("strategy"))


def units(timeline: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """Words with the number of their unit: a sentence in videos with enough punctuation, else a window of words."""
    dense = strategies(timeline, packing).select("video_id", (F.col("strategy") == "sentences").alias("dense"))
    line = Window.partitionBy("video_id").orderBy("word_start")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    sentence = F.coalesce(F.sum(F.col("word").rlike(SENTENCE_END).cast("int")).over(before), F.lit(0))
    window = F.floor((F.row_number().over(line) - 1) / packing.words_per_window)
    return words(timeline).join(dense, "video_id").withColumn("unit", F.when(F.col("dense"), sentence).otherwise(window).cast("int"))


def unit_spans(timeline: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """(video_id, unit, char_start, char_end) before long units are split."""
    return units(timeline, packing).groupBy("video_id", "unit").agg(F.min("word_start").alias("char_start"), F.max("word_end").alias("char_end"))


def whole_units(timeline: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """A row for each unit: (video_id, unit, start, end, from_s, to_s, first, last, text, words).

    words, the unit's words in order with their places, is there only where the unit is too long for a passage.
    """
    place = F.struct("word_start", "word_end", "from_s", "to_s", "seg_index", "word")
    each = units(timeline, packing).groupBy("video_id", "unit").agg(F.array_sort(F.collect_list(place)).alias("w"))
    first, last = F.element_at("w", 1), F.element_at("w", -1)
    long = last["word_end"] - first["word_start"] > packing.max_chars
    return each.select(
        "video_id", "unit", first["word_start"].alias("start"), last["word_end"].alias("end"), first["from_s"].alias("from_s"), last["to_s"].alias("to_s"),
        first["seg_index"].alias("first"), last["seg_index"].alias("last"), F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), F.when(long, F.col("w")).alias("words"),
    )


@dataclass
class _Unit:
    start: int
    end: int
    from_s: float
    to_s: float
    first: int
    last: int
    text: str

    @property
    def size(self) -> int:
        return self.end - self.start


class _Packer:
    """Splits units over the limit at words and cuts the line of units into passages.

    A passage is two places in the line. Where it ends and where its overlap begins is looked up in the running sums
    of the units' sizes; units before the last passage that is not told yet are let go.
    """

    def __init__(self, packing: Packing) -> None:
        self.p, self.n, self.video = packing, 0, None
        self.line: list[_Unit] = []
        self.sums = [0]
        #: The open passage begins at `first`, and `new` is the first unit that no passage has; `last` is the one before it.
        self.first = self.new = 0
        self.last: tuple[int, int] | None = None

    def feed(self, row: dict) -> list[tuple]:
        self.video = row["video_id"]
        for unit in self._pieces(row):
            self.line.append(unit)
            self.sums.append(self.sums[-1] + unit.size)
        out = []
        while (end := self._end()) < len(self.line):
            out += [self._row(*self.last)] if self.last else []
            self.last, self.first, self.new = (self.first, end), self._overlap(end), end
        self._forget()
        return out

    def _pieces(self, row: dict) -> Iterator[_Unit]:
        if not row["words"]:
            yield _Unit(row["start"], row["end"], row["from_s"], row["to_s"], row["first"], row["last"], row["text"])
            return
        words, at = row["words"], 0
        starts = [w["word_start"] for w in words]
        while at < len(words):
            # As many words as end within the limit, one at least.
            stop = max(at + 1, bisect_right(words, starts[at] + self.p.max_chars, lo=at, key=lambda w: w["word_end"]))
            a, b = words[at], words[stop - 1]
            yield _Unit(a["word_start"], b["word_end"], a["from_s"], b["to_s"], a["seg_index"], b["seg_index"], " ".join(w["word"] for w in words[at:stop]))
            at = stop

    def _end(self) -> int:
        """Where the open passage ends: after the last unit that fits with a space between each two, and after a new one at least."""
        room = self.sums[self.first] + self.first + self.p.max_chars + 1
        return max(self.new + 1, bisect_right(range(len(self.sums)), room, lo=self.first, key=lambda k: self.sums[k] + k) - 1)

    def _overlap(self, end: int) -> int:
        """Where the overlap before `end` begins: all last units that fit into it, or a single one of under twice its size."""
        most = self.p.overlap_chars
        if most <= 0:
            return end
        begin = max(self.first, bisect_left(self.sums, self.sums[end] - most, hi=end))
        return end - 1 if begin == end and self.line[end - 1].size <= 2 * most else begin

    def _forget(self) -> None:
        gone = (self.last or (self.first,))[0]
        if gone > 256:
            del self.line[:gone], self.sums[:gone]
            self.first, self.new = self.first - gone, self.new - gone
            self.last = self.last and (self.last[0] - gone, self.last[1] - gone)

    def _row(self, begin: int, end: int) -> tuple:
        group = self.line[begin:end]
        text = " ".join(u.text for u in group)
        start, stop = group[0].from_s, max(group[0].from_s, group[-1].to_s)
        self.n += 1
        return (self.video, self.n - 1, text, round(start, 3), round(stop, 3), group[0].first, group[-1].last, group[0].start, group[-1].end, len(text))

    def close(self) -> list[tuple]:
        end = len(self.line)
        if not end:
            return []
        if self.last and self.sums[end] - self.sums[self.first] < self.p.min_chars:
            return [self._row(self.last[0], end)]  # a last passage that is too short joins the one before
        return [self._row(*g) for g in (self.last, (self.first, end)) if g]


def pack(timeline: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """Passages of cleaned cues' spans. Spark makes units of words; units are packed by a scan, as each edge depends on the one before."""
    return scan(whole_units(timeline, packing), ["video_id"], ["start"], lambda: _Packer(packing), PASSAGES)


class _Packers:
    """A packer for each of several sizes, fed with the same units."""

    def __init__(self, packings: list[Packing]) -> None:
        self.own = [_Packer(p) for p in packings]

    def feed(self, row: dict) -> list[tuple]:
        return [(x.p.max_chars, *r) for x in self.own for r in x.feed(row)]

    def close(self) -> list[tuple]:
        return [(x.p.max_chars, *r) for x in self.own for r in x.close()]


def pack_sizes(timeline: DataFrame, packings: list[Packing]) -> DataFrame:
    """pack for several packings that differ in sizes only, with max_chars before its columns: units are made once."""
    if len({(p.words_per_window, p.punctuation_density_threshold) for p in packings}) > 1:
        raise ValueError("packings with other units")
    units = whole_units(timeline, min(packings, key=lambda p: p.max_chars))
    return scan(units, ["video_id"], ["start"], lambda: _Packers(packings), f"max_chars int, {PASSAGES}")


def passages_of(cues: DataFrame, packing: Packing = Packing()) -> DataFrame:
    return pack(spans(cues), packing)
