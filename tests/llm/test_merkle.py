"""Merkle fingerprints: equality, edits, likeness, and the next document whatever the ids' distances."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.llm import merkle

DOCS = "doc_id long, text string"


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_equal_fingerprints_mean_equal_texts(spark):
    texts = ["a b. c", "\x01a b. c", "a b. c\x01", "\x00", "", "\n", "\n\n", "a\nb", "a\n\nb", "a\nb\n", "0" * 64 + ".", ".", ";", "a;b", "😀" * 100, "😀" * 99 + "é", "x" * 400, "x" * 401, "\r\n", "a. b", "a.  b"]
    prints = frame(spark, *texts, *texts).select("doc_id", merkle.as_string(merkle.fingerprint(F.col("text"))).alias("p")).collect()
    got = [r.p for r in sorted(prints)]
    assert got[: len(texts)] == got[len(texts) :] and len(set(got)) == len(texts) and len({p[:64] for p in got}) == len(texts)


def changes(spark, old, new):
    found = merkle.edits(merkle.nodes(frame(spark, *old)), merkle.nodes(frame(spark, *new)))
    return sorted((r.doc_id, r.change, 0 if r.section is None else 1, 0 if r.new_section is None else 1) for r in found.collect())


def test_an_insertion_is_one_row(spark):
    lines = [f"line {i}\n" for i in range(200)]
    old, new = "".join(lines), "".join(["first\n", *lines])
    assert changes(spark, [old, old, "same", "", old], [new, old, "same", "x", old.replace("line 77\n", "line x\n").replace("line 150\n", "")]) == [(0, "added", 0, 1), (3, "added", 0, 1), (4, "edited", 1, 1), (4, "removed", 1, 0)]


def test_edits_of_repeated_lines(spark):
    line = "again\n"
    assert changes(spark, [line * 5 + "\n" + line * 5], [line * 4 + "\n" + line * 5]) == [(0, "removed", 1, 0)]
    assert changes(spark, [None], [None]) == []


@pytest.mark.parametrize("unit", ["word ", "漢字漢字", "a,b;c! ", "x"])
def test_likeness_without_sentences(spark, unit):
    pick = random.Random(1)
    half = lambda: "".join(unit + str(pick.randrange(10**6)) for _ in range(400))
    a, b, c = half(), half(), half()
    df = spark.createDataFrame([(a + b, a + c, c + half())], "x string, y string, z string").select(*(merkle.fingerprint(F.col(k)).alias(k) for k in "xyz"))
    row = merkle.with_likeness(merkle.with_likeness(merkle.with_likeness(df, "x", "y", "near"), "x", "z", "far"), "y", "x", "back").first()
    assert 0.4 < row.near < 0.6 and row.far < 0.1 and row.near == row.back


def test_likeness_is_about_the_share_in_common(spark):
    pick = random.Random(2)
    lines = ["".join(pick.choice("abcdef ") for _ in range(60)) + "\n" for _ in range(300)]
    rows = [(k, "".join(lines), "".join(lines[: 300 - k] + [x.upper() for x in lines[300 - k :]])) for k in (0, 30, 150, 300)]
    df = spark.createDataFrame(rows, "k int, x string, y string").select("k", *(merkle.fingerprint(F.col(c)).alias(c) for c in "xy"))
    near = {r.k: r.near for r in merkle.with_likeness(df, "x", "y", "near").collect()}
    assert near[0] == 1 and abs(near[30] - 0.9) < 0.02 and abs(near[150] - 0.5) < 0.02 and near[300] == 0


def test_next_document_with_outlier_ids_nulls_and_repeats(spark):
    rows = [(i, f"t{i}") for i in range(500)] + [(1 << 60, "far"), (-(1 << 60), "low"), (7, "t7 again")] + [(None, f"n{i}") for i in range(3)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"_own": F.lit("clash"), "_range": F.lit("clash")}).select("doc_id", "text")
    got = {r.text: r.after for r in merkle.with_next(df, "doc_id", [F.col("text")], {"text": "after"}).collect()}
    order = [t for _, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda r: (-r[0], r[1]))] + ["n0", "n1", "n2"]
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}


def test_rank_among_edges(spark):
    from cuewright.llm.common import rank_among

    for edges in ([], [3], [1, 5, 5, 9], list(range(0, 200, 3))):
        got = spark.range(-2, 205).select("id", rank_among(edges, F.col("id")).alias("n")).collect()
        assert all(r.n == sum(e < r.id for e in edges) for r in got)
    assert spark.range(1).select(rank_among([1, 2], F.lit(None).cast("long")).alias("n")).first().n is None


def test_outlier_ids_leave_no_full_range(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.createDataFrame([(1 << 60, "t")], DOCS))
    spread = merkle.with_next(df, "doc_id", [], {"text": "after"}).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in spread) == 20_001 and max(r["count"] for r in spread) < 12_000


def test_lone_and_empty_tables(spark):
    lone = merkle.compare_edits(frame(spark, "x y")).collect()[0]
    assert lone.near_next == 1.0 and lone.n_chars == 3
    assert merkle.compare_edits(spark.createDataFrame([], DOCS)).count() == 0
    both = merkle.compare_edits(spark.createDataFrame([(1, None), (2, "")], DOCS)).collect()
    assert {(r.n_chars, r.near_edited, r.near_next) for r in both} == {(0, 1.0, 1.0)} and len({r.fingerprint for r in both}) == 1
