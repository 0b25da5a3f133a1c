"""Benchmark decontamination: n-gram seeds find test items in training text, Smith-Waterman scores the copies.

Every n-gram of an item is a seed, however often the corpus has it: counts cannot tell a leak that was copied often
from a common phrase. What makes a seed rare enough is its item: chance hits are turned away by a bound on the score
that the words in common allow, before anything is aligned. Items come to the tasks in passes of bounded size; a
benchmark of several passes is never held whole, neither by the driver nor by a task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_text, discard, fresh, materialize, prepare

#: Words in a seed.
SEED_WORDS = 3
#: Share of an item's words that the best alignment must recover.
LEAK = 0.4
#: Words of test items that tasks get at once, some 100 MB with their seeds; a larger benchmark takes several passes.
PASS_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ARROW_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

_odd = re.compile(r"[^\w\x00-\x7f]+")
_word_bytes = np.zeros(256, np.uint8)
_word_bytes[48:58], _word_bytes[97:123], _word_bytes[65:91], _word_bytes[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of a number modulo 2^64, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.held = base, np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            grown = np.full(max(n, 1 << 16), self.base, np.uint64)
            grown[0] = 1
            self.held = np.cumprod(grown)
        return self.held[:n]


_up, _down = _Powers(_BASE), _Powers(_INVERSE)


def _plain(text: bytes) -> bytes:
    """Composed, in small letters, and with a space for signs beyond ASCII that are no letters or digits."""
    if text.isascii():
        return text
    s = as_text(text)
    s = s if unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s)
    return _odd.sub(" ", s.lower()).encode("utf-8", "replace")


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin (one entry more than texts).

    Words are runs of letters and digits, whatever their script and case.
    """
    texts = [_plain(t) for t in texts]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    b = _word_bytes[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    inside = b != 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A polynomial in the bytes, from running sums; the inverse power moves every word's to its first byte.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _up.first(len(b)) * inside)))
    hashes = _mix((sums[ends] - sums[starts]) * _down.first(len(b) + 1)[starts]) + (ends - starts).astype(np.uint64)
    return hashes, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words in a row."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count])
    return out


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Score of the best local alignment as a share of the item's own, and where in the passage it begins and ends."""
    n = len(passage)
    shift = np.arange(n + 1) * -GAP
    above, begins = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        diagonal, up = above[:-1] + step, above[1:] + GAP
        here = np.concatenate(([0], np.maximum(0, np.maximum(diagonal, up))))
        origin = np.concatenate(([0], np.where(here[1:] == 0, np.arange(1, n + 1), np.where(diagonal >= up, begins[:-1], begins[1:]))))
        # A gap in the item moves right along the row: the running maximum of score plus distance walked.
        lifted = here + shift
        top = np.maximum.accumulate(lifted)
        from_ = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        above, begins = top - shift, origin[from_]
        j = int(above.argmax())
        if above[j] > best[0]:
            best = (int(above[j]), int(begins[j]), j)
    return best[0] / (MATCH * max(1, len(item))), best[1], best[2]


@dataclass
class Items:
    """Test items as word hashes, and their n-grams, sorted: each one's item and its first and last place in it."""

    ids: list[int]
    words: list[np.ndarray]
    width: int
    keys: np.ndarray
    item: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, ids: list[int], words: list[np.ndarray], width: int) -> Items:
        grams = [ngrams(w, width) for w in words]
        item = np.repeat(np.arange(len(words)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.lexsort((place, item, keys))
        keys, item, place = keys[order], item[order], place[order]
        new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (item[1:] != item[:-1]))) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(keys)) - 1 if len(keys) else new
        return cls(ids, words, width, keys[new], item[new], place[new], place[ends])

    def _places(self, seeds: np.ndarray, ordered: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in a text an item would begin by its seeds, at the earliest and at the latest (places below 0 too), in order.

        ordered and line are the text's n-grams sorted and where they stand. A seed that the item repeats is one hit.
        """
        low, high = np.searchsorted(ordered, self.keys[seeds]), np.searchsorted(ordered, self.keys[seeds], "right")
        n = high - low
        at = line[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]
        first, last = at - np.repeat(self.last[seeds], n), at - np.repeat(self.first[seeds], n)
        order = np.lexsort((last, first))
        return first[order], last[order]

    def leaks(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item_id, score, start, end) of the items found in one text; places count its words.

        First come items alone, each with the seeds that the text has somewhere: a seed that is common in both is one
        pair for each of its items, however often the text has it. Most items go by the words in common; only for one
        that stays, and one at a time, are the places looked up.
        """
        grams = ngrams(words, self.width)
        line = np.argsort(grams, kind="stable")
        ordered = grams[line]
        own = ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered
        low, high = np.searchsorted(self.keys, own), np.searchsorted(self.keys, own, "right")
        n = high - low
        seed = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
        seed = seed[np.argsort(self.item[seed], kind="stable")]
        numbers, edges = np.unique(self.item[seed], return_index=True)
        if not len(numbers):
            return []
        # Where even all words in common in order would score lower, the item needs no look at its places.
        sizes = np.array([len(self.words[i]) for i in numbers])
        common = np.add.reduceat(np.isin(np.concatenate([self.words[i] for i in numbers]), words), np.cumsum(sizes) - sizes, dtype=np.int64)
        found = []
        for i, seeds, able in zip(numbers.tolist(), np.split(seed, edges[1:]), common >= LEAK * sizes):
            if not able:
                continue
            low, high = self._places(seeds, ordered, line)
            item = self.words[i]
            # Words of the text within an alignment cost a point each where they match nothing, and all of the item's
            # words together earn two each, so a score of LEAK leaves room for so many; no alignment through a seed
            # leaves the passage.
            room = int(2 * (1 - LEAK) * len(item)) + 1
            best = (0.0, 0, 0)
            # Seeds whose passages overlap share one.
            reach = np.maximum.accumulate(high + len(item) + room)
            starts = np.flatnonzero(np.append(True, low[1:] - room > reach[:-1]))
            for k, after in zip(starts.tolist(), [*starts[1:].tolist(), len(low)]):
                a, b = max(0, int(low[k]) - room), min(len(words), int(reach[after - 1]))
                passage = words[a:b]
                if np.isin(item, passage).sum() < LEAK * len(item):
                    continue
                score, s, e = smith_waterman(item, passage)
                best = max(best, (score, a + s, a + e), key=lambda x: x[0])
            if best[0] >= LEAK:
                found.append((self.ids[i], *best))
        return found


def _chunks(benchmark: DataFrame, id_col: str, text_col: str, pass_words: int) -> Iterator[list[Items]]:
    """The items in passes of about pass_words words; those of fewer words than a seed have seeds of their length."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    size = 0
    for row in benchmark.select(id_col, text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        words = words_of([row[1].encode()])[0]
        if len(words):
            ids, texts = held.setdefault(min(SEED_WORDS, len(words)), ([], []))
            ids.append(row[0])
            texts.append(words)
            size += len(words)
        if size >= pass_words:
            yield [Items.of(*group, n) for n, group in sorted(held.items())]
            held, size = {}, 0
    if held:
        yield [Items.of(*group, n) for n, group in sorted(held.items())]


def _one_pass(df: DataFrame, items: list[Items], text_col: str, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)

    def setup():
        def compute(texts: list[bytes]) -> list[pa.Array]:
            words, starts = words_of(texts)
            held: list[list[dict]] = [[] for _ in texts]
            for one in shared.value:
                grams = ngrams(words, one.width)
                at = np.minimum(np.searchsorted(one.keys, grams), max(0, len(one.keys) - 1))
                hit = np.flatnonzero(one.keys[at] == grams) if len(one.keys) else []
                for i in np.unique(np.searchsorted(starts, hit, "right") - 1).tolist():
                    held[i] += [dict(zip(("item_id", "score", "start", "end"), x)) for x in one.leaks(words[starts[i] : starts[i + 1]])]
            return [pa.array(held, ARROW_LEAKS)]

        return compute

    return append_columns(df, text_col, [T.StructField(out, LEAKS)], setup)


def find_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "leaks", pass_words: int = PASS_WORDS) -> DataFrame:
    """df with the test items that each whole text holds, as an array of (item_id, score, start, end) in words.

    Score is the best Smith-Waterman alignment of the item's words with the text's (match 2, mismatch and gap -1) as a share of
    the item's own; items of at least LEAK that share SEED_WORDS words in a row with the text are listed, each once. Null and
    empty texts hold none; null or wordless items are never found; repeated items are found each by its id; with
    no items every array is empty. A column named like out is replaced; all rows are kept, nothing is shuffled.

    A benchmark of up to pass_words words takes one lazy pass. Of a larger one each pass is run and written to the
    shared folder before the next one's items are read, so memory does not grow with the benchmark.
    """
    prepare(df)
    before, found = None, None
    for items in _chunks(benchmark, item_col, item_text_col, pass_words):
        if found is None:
            found = _one_pass(df, items, text_col, out)
            continue
        done = materialize(found, "leaks")
        if before is not None:
            discard(before)
        held = fresh(done, "held")
        more = _one_pass(done.withColumnRenamed(out, held), items, text_col, out)
        before, found = done, more.withColumn(out, F.concat(held, out)).select(*done.columns)
    return _one_pass(df, [], text_col, out) if found is None else found
