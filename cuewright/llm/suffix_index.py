"""Suffix-array deduplication with a logarithmic family of indexes.

Texts come in batches. A batch's suffixes are sampled (see suffixes.py) and lie in a table with their places; its
suffix array tells in order of their beginnings, as hashes, how often each occurs. A new array is merge-scanned
against every level for suffixes that begin alike, and levels of equal size are merged, so n batches make about
log n levels. Arrays lie in buckets, so scans and merges move nothing; a beginning that a third of all texts share
is one row of an array. What begins alike is then compared in full:

* suffixes whose whole surroundings are equal repeat every window that they stand for;
* suffixes of a beginning with up to GROUP occurrences are brought next to each other and matched to both sides;
* of one with more, each window is hashed, and hashes are counted with a partial sum before the shuffle.

Equal texts are one blob with a count, so a text that a third of all rows repeat is indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, drop_table, materialize, prepare, release_shuffles, slices
from .suffixes import WINDOW, sample, window_hashes

#: Occurrences of one beginning whose surroundings are compared with each other in one task.
GROUP = 48
#: Batches that a whole table is cut into.
BATCHES = 3
_SUFFIXES = "key long, run long, blob binary, place int, lead int, count int, n long"
_SPANS = "blob binary, start int, end int"


def blob_id(text: Column) -> Column:
    """The MD5 digest of a text (null: empty) as 16 bytes."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def blobs_of(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(blob, text, n): each different text and the number of its rows."""
    rows = df.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.groupBy("blob").agg(F.first("text").alias("text"), F.count("*").alias("n"))


def suffixes_of(blobs: DataFrame) -> DataFrame:
    """Sampled suffixes of the blobs, a row each: beginning and surroundings as hashes, place, windows before it, windows, copies."""
    prepare(blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                found = [sample(np.frombuffer(t, np.uint8)) for t in texts]
                at = pa.array(np.repeat(np.arange(len(texts)), [len(f[0]) for f in found]))
                place, key, whole, first, count = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), part.column(0).take(at), pa.array(place.astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array(count.astype(np.int32)), part.column(2).take(at)],
                    names=["key", "run", "blob", "place", "lead", "count", "n"],
                )

    return blobs.select("blob", "text", "n").filter(F.octet_length("text") >= WINDOW).mapInArrow(run, _SUFFIXES)


class SuffixIndex:
    """Levels of suffix arrays (key, n): level k tells of the suffixes of 2^k batches; keys that were found twice are remembered."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.suffixes: list[DataFrame] = []
        self.found: list[DataFrame] = []

    def add(self, blobs: DataFrame) -> DataFrame:
        """Scan a new batch against itself and all levels, then insert it, merging equal levels.

        Returns the batch's suffixes whose beginning stands somewhere else too; suffixes of older batches are not read.
        """
        rows = materialize(suffixes_of(blobs), "suffixes")
        self.suffixes.append(rows)
        new = bucketed(rows.groupBy("key").agg(F.sum("n").alias("n")), "key", "key", name="array")
        release_shuffles(new.sparkSession)
        alike = [new.filter("n > 1").select("key")]
        alike += [new.select("key").join(level.select("key"), "key", "left_semi") for _, level in self.levels]
        fresh = [materialize(keys, "found") for keys in alike]
        self.found += fresh
        size = 0
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            both = level.join(new.withColumnRenamed("n", "m"), "key", "full")
            merged = bucketed(both.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")), "key", "key", name="array")
            drop_table(level)
            drop_table(new)
            new, size = merged, size + 1
        self.levels.append((size, new))
        return rows.join(reduce(DataFrame.union, fresh).distinct(), "key", "left_semi")

    def matches(self) -> DataFrame:
        """All suffixes whose beginning was found twice, with `often`, how often it occurs."""
        keys = reduce(DataFrame.union, self.found).distinct()
        counts = reduce(DataFrame.unionByName, (level.join(keys, "key", "left_semi") for _, level in self.levels))
        # A table of its own, so that the join below can split a beginning that very many suffixes share.
        often = materialize(counts.groupBy("key").agg(F.sum("n").alias("often")), "often")
        self.found.append(often)
        return reduce(DataFrame.unionByName, self.suffixes).join(often, "key")

    def close(self) -> None:
        for _, level in self.levels:
            drop_table(level)
        for rows in [*self.found, *self.suffixes]:
            discard(rows)


def _aligned(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before each suffix's place, from it backwards, and from it onwards; what a text lacks equals nothing."""
    left = np.zeros((len(rows), max(lead for lead, _ in rows)), np.int32)
    right = np.zeros((len(rows), max(len(b) - lead for lead, b in rows)), np.int32)
    for i, (lead, b) in enumerate(rows):
        v = np.frombuffer(b, np.uint8)
        left[i], right[i] = -1 - i, -1 - i
        left[i, :lead], right[i, : len(v) - lead] = v[:lead][::-1], v[lead:]
    return left, right


def _prefix(equal: np.ndarray) -> np.ndarray:
    """The number of True before the first False in each row."""
    return np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1)) if equal.shape[1] else np.zeros(len(equal), np.int64)


def repeated_windows(rows: list[tuple[int, int, bytes]]) -> list[list[tuple[int, int]]]:
    """For suffixes (lead, count, surroundings) that begin alike: where each one's repeated windows begin (from, to; relative to it)."""
    left, right = _aligned([(lead, b) for lead, _, b in rows])
    out: list[list[tuple[int, int]]] = []
    for i, (lead, count, _) in enumerate(rows):
        before, after = _prefix(left == left[i]), _prefix(right == right[i])
        low, high = np.maximum(WINDOW - after, lead - count + 1), np.minimum(before, lead)
        good = low <= high
        good[i] = False
        out.append(sorted({(-int(h), -int(lo)) for lo, h in zip(low[good], high[good])}))
    return out


def _surroundings(blobs: DataFrame, asked: DataFrame) -> DataFrame:
    """For asked(blob, key, place, lead, count, many): the bytes that the windows cover or, for many, the windows' hashes.

    Texts stay where their bucket is; what is asked of a blob is brought to it.
    """
    lists = asked.groupBy("blob").agg(F.collect_list(F.struct("key", "place", "lead", "count", "many")).alias("asked"))
    rows = blobs.select("blob", "text").join(lists, "blob").select("blob", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                out: dict[str, list] = {c: [] for c in ("blob", "key", "place", "lead", "count", "covered", "window")}
                for blob, text, wanted in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist()):
                    for a in wanted:
                        first = a["place"] - a["lead"]
                        covered = text[first : first + a["count"] - 1 + WINDOW]
                        if not a["many"]:
                            got = [(a["place"], a["lead"], a["count"], covered, None)]
                        else:
                            got = [(first + k, 0, 1, None, h) for k, h in enumerate(window_hashes(np.frombuffer(covered, np.uint8)).view(np.int64).tolist())]
                        out["blob"] += [blob] * len(got)
                        out["key"] += [a["key"]] * len(got)
                        for name, values in zip(("place", "lead", "count", "covered", "window"), zip(*got)):
                            out[name] += values
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return rows.mapInArrow(run, "blob binary, key long, place int, lead int, count int, covered binary, window long")


def _compare(rows: DataFrame) -> DataFrame:
    """Spans of repeated windows among rows(blob, key, place, lead, count, covered) whose keys occur at most GROUP times."""
    sorted_rows = rows.select("key", "covered", "blob", "place", "lead", "count").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> list[tuple[bytes, int, int]]:
            spans = []
            for row, begins in zip(held, repeated_windows([(r[4], r[5], r[1]) for r in held])):
                spans += [(row[2], row[3] + a, row[3] + b + WINDOW) for a, b in begins]
            return spans

        def emit(spans: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
            blob, start, end = zip(*spans) if spans else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(blob, pa.binary()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["blob", "start", "end"])

        for batch in batches:
            spans: list[tuple[bytes, int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    spans += close() if len(held) > 1 else []
                    held = []
                held.append(row)
            yield emit(spans)
        yield emit(close() if len(held) > 1 else [])

    return sorted_rows.mapInArrow(run, _SPANS)


def repeated_spans(blobs: DataFrame, index: SuffixIndex) -> tuple[DataFrame, list[DataFrame]]:
    """(blob, start, end): bytes covered by windows that stand somewhere else too; spans may overlap. And the tables that this reads."""
    matches = materialize(index.matches(), "matches")
    release_shuffles(blobs.sparkSession)
    runs = materialize(matches.groupBy("key", "run").agg(F.sum("n").alias("copies")), "runs")
    told = matches.join(runs, ["key", "run"]).withColumn("status", F.when(F.col("copies") > 1, "all").when(F.col("often") > GROUP, "many").otherwise("few"))
    told = materialize(told.select("blob", "key", "run", "place", "lead", "count", "status"), "told")
    release_shuffles(blobs.sparkSession)
    whole = told.filter("status = 'all'").select("blob", (F.col("place") - F.col("lead")).alias("start"), (F.col("place") - F.col("lead") + F.col("count") - 1 + WINDOW).alias("end"))
    single = told.filter("status <> 'all'")
    # Surroundings that several suffixes share are also what single ones are held against; one of them stands for all.
    shared = told.filter("status = 'all'").groupBy("key", "run").agg(F.min(F.struct("blob", "place", "lead", "count")).alias("s")).select("key", "s.*")
    open_keys = single.groupBy("key").agg(F.first("status").alias("status"))
    shared = shared.join(open_keys, "key").select("blob", "key", "place", "lead", "count", (F.col("status") == "many").alias("many"))
    asked = single.select("blob", "key", "place", "lead", "count", (F.col("status") == "many").alias("many")).unionByName(shared)
    around = materialize(_surroundings(blobs, asked), "around")
    release_shuffles(blobs.sparkSession)
    few = _compare(around.filter("covered IS NOT NULL"))
    windows = around.filter("window IS NOT NULL").select("blob", "key", "window", "place")
    often = materialize(windows.groupBy("key", "window").agg(F.count("*").alias("n")).filter("n > 1").select("key", "window"), "often")
    many = windows.join(often, ["key", "window"], "left_semi").select("blob", F.col("place").alias("start"), (F.col("place") + WINDOW).alias("end"))
    return whole.union(few).union(many), [matches, runs, told, around, often]


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(blobs: DataFrame, spans: DataFrame) -> DataFrame:
    """(blob, n_bytes, spans, kept): maximal removed runs of each blob, and its other bytes in order."""
    lists = spans.groupBy("blob").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    # A text with copies repeats itself from end to end.
    rows = blobs.join(lists, "blob", "left").select("blob", "text", "n", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                runs, kept = [], []
                for text, n, found in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if n > 1 and len(text) >= WINDOW:
                        merged = [(0, len(text))]
                    else:
                        merged = _merge(np.array([s["start"] for s in found or []], np.int64), np.array([s["end"] for s in found or []], np.int64))
                    edges = [0, *(x for span in merged for x in span), len(text)]
                    runs.append([{"start": a, "end": b} for a, b in merged])
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["blob", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(run, "blob binary, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(df: DataFrame, *columns: Column, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Each row's text without the bytes that a 200-byte string which also starts anywhere else covers.

    Returns (id_col, *columns), a row for each row. Columns are expressions over what was found for the text:
    n_bytes, spans (an array of (start, end) in bytes: maximal removed runs) and kept (the other bytes); without any
    all three are returned. The result reads one table in the shared folder; all others are deleted. Null texts count as empty; texts under 200 bytes keep all; repeated rows are
    separate texts, so both lose everything; ids may be null or repeated; other columns are not looked at.
    """
    blobs = bucketed(blobs_of(df, text_col), "blob", name="blobs")
    release_shuffles(df.sparkSession)
    index = SuffixIndex()
    for k in range(batches):
        index.add(blobs.filter(F.pmod(F.xxhash64("blob"), F.lit(batches)) == k))
    spans, read = repeated_spans(blobs, index)
    done = materialize(cut(blobs, spans).select("blob", *(columns or ("n_bytes", "spans", "kept"))), "cut")
    for one in read:
        discard(one)
    index.close()
    drop_table(blobs)
    release_shuffles(df.sparkSession)
    return df.select(F.col(id_col), blob_id(F.col(text_col)).alias("blob")).join(done, "blob").drop("blob")
