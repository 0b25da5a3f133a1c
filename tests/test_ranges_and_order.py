"""Joins of ranges, orders over whole tables, groupings and sketches on small and odd tables."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators import cases, dense, intervals, ordered, sketches, timeline
from cuewright.operators.embed import hash_embed, hash_embed_md5

LEFT, RIGHT = "video_id string, a int, start_s double, end_s double", "video_id string, b int, gold_start double, gold_end double"


def test_all_overlapping_pairs_once(spark):
    rng = random.Random(1)
    span = lambda: (lambda s, n: (s, s + n))(rng.uniform(-50, 500), rng.choice([0.0, 0.01, 0.25, 1.0, 7.0, 300.0, 1e6]))
    left = [(rng.choice(["v", "v", "w"]), i, *span()) for i in range(150)] + [(None, 900, 0.0, 9.0), ("v", 901, None, 4.0), ("v", 902, 5.0, 4.0)]
    right = [(rng.choice(["v", "v", "w"]), i, *span()) for i in range(120)] + [(None, 900, 0.0, 9.0), ("v", 901, 3.0, None)]
    got = intervals.overlapping(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)).collect()
    ok = lambda x: x[0] is not None and x[2] is not None and x[3] is not None and x[3] > x[2]
    want = {(l[1], r[1]): min(l[3], r[3]) - max(l[2], r[2]) for l in left for r in right if ok(l) and ok(r) and l[0] == r[0] and min(l[3], r[3]) > max(l[2], r[2])}
    assert len(got) == len(want) and {(r.a, r.b): r.shared_s for r in got} == pytest.approx(want)
    assert intervals.overlapping(spark.createDataFrame(left, LEFT), spark.createDataFrame([], RIGHT)).count() == 0


def test_rows_of_one_very_long_video_grow_with_its_ranges(spark):
    for n in (2_000, 8_000):
        ends = [F.col("id") * 2.0, F.col("id") * 2.0 + 2.0]
        left = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("a"), ends[0].alias("start_s"), ends[1].alias("end_s"))
        right = spark.range(n // 10).select(F.lit("v").alias("video_id"), F.col("id").alias("b"), (F.col("id") * 20.0 + 1).alias("gold_start"), (F.col("id") * 20.0 + 6).alias("gold_end"))
        assert intervals._placed(left.filter("end_s > start_s"), "start_s", "end_s", [5], "l").count() <= 5 * n
        assert intervals.overlapping(left, right).count() == 3 * (n // 10)


def in_order(rows):
    """The order of a plain walk: what a case follows comes right before it unless it came already."""
    up, out = dict(rows), []

    def place(c):
        if c not in out:
            if up[c]:
                place(up[c])
            out.append(c)

    for c, _ in rows:
        place(c)
    return out


def test_order_of_cases(spark):
    rng = random.Random(3)
    names = [f"c{i}" for i in range(120)]
    line = names[:]
    rng.shuffle(line)
    rows = [(c, rng.choice(line[: line.index(c)]) if line.index(c) and rng.random() < 0.7 else None) for c in names]
    chain = [(f"d{i}", f"d{i + 1}" if i < 40 else None) for i in range(41)]
    odd = [("x", "y"), ("y", "x"), ("z", "x"), ("lost", "nowhere")]
    want = in_order(rows + chain)
    frame = spark.createDataFrame([(c, u, i) for i, (c, u) in enumerate(rows + chain + odd)], "case_id string, followup_to string, place long").repartition(3)
    got = {r.case_id: r.position for r in cases.in_order(frame).collect()}
    assert [c for c, _ in sorted(((c, p) for c, p in got.items() if p is not None), key=lambda x: x[1])] == want
    assert {c for c, p in got.items() if p is None} == {"x", "y", "z", "lost"}
    assert cases.in_order(frame.limit(0)).count() == 0


def test_running_sums_and_percent_ranks(spark):
    rows = [(i, float(v)) for i, v in enumerate([5, 1, 1, 1, 9, 2] * 30)] + [(999, None)]
    frame = spark.createDataFrame(rows, "id long, x double").repartition(4)
    got = {r.id: r.percent_rank for r in ordered.percent_ranks(frame, "x").collect()}
    held = [x for _, x in rows if x is not None]
    assert got == pytest.approx({i: None if x is None else sum(y < x for y in held) / (len(held) - 1) for i, x in rows})
    places = {r.id: r.position for r in ordered.numbered(frame, [F.col("id").desc()]).collect()}
    assert places == {i: n for n, i in enumerate(sorted((i for i, _ in rows), reverse=True))}
    assert ordered.percent_ranks(frame.limit(0), "x").count() == 0 and ordered.percent_ranks(frame.filter("id = 3"), "x").first().percent_rank == 0


def test_recent_frames_are_of_values(spark):
    marks = spark.createDataFrame([("v", 0.0, 5.0, True), ("v", 10.0, 5.0, False), ("v", 10.0, 5.0, True), ("v", 30.0, 40.0, False), ("v", 61.0, 1.0, True)], "video_id string, at_s double, talk_s double, hit boolean")
    got = [(r.at_s, round(r.talk_share, 6), round(r.hit_share, 6), r.silence_s) for r in timeline.recent(marks).orderBy("at_s", "talk_s").collect()]
    assert got == [(0.0, round(5 / 30, 6), 1.0, 25.0), (10.0, 0.5, round(2 / 3, 6), 15.0), (10.0, 0.5, round(2 / 3, 6), 15.0), (30.0, 1.0, 0.5, 0.0), (61.0, round(1 / 30, 6), 1.0, 29.0)]


def test_sketches_merge_without_rows(spark):
    told = spark.range(6000).select((F.col("id") % 3).cast("string").alias("scope"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.concat(F.lit("w"), F.col("id") % 2500, F.lit(" w"), F.col("id") % 7).alias("text"), (F.col("id") / 6000).alias("confidence"))
    kept = sketches.daily(told)
    by_scope = sketches.merged(kept, ["scope"])
    whole = sketches.merged(by_scope, []).select("n", sketches.distinct_terms(F.col("terms")).alias("terms"), sketches.quantile(F.col("confidences"), 0.9).alias("q")).first()
    assert whole.n == 6000 and abs(whole.terms - 2500) < 0.04 * 2500 and abs(whole.q - 0.9) < 0.03
    assert kept.count() == 15


def test_long_texts_in_pieces(spark):
    texts = spark.createDataFrame([(1, "a b c " * 3000), (2, None), (3, ""), (4, "x"), (5, "a b c " * 3000)], "passage_id long, text string")
    got = {r.passage_id: r.vector for r in hash_embed(texts, 16).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[5] and not any(got[2]) and not any(got[3])
    assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5)
    md5 = {r.passage_id: r.vector for r in hash_embed_md5(texts, 16).collect()}
    assert sum(x * x for x in md5[4]) == pytest.approx(1) and not any(md5[2])


def test_many_queries_take_several_steps(spark):
    vectors = spark.range(3000).select(F.col("id").alias("passage_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sin(F.col("id") * i)).alias("vector"))
    queries = vectors.select(F.col("passage_id").alias("query_id"), "vector")
    seen = spark.createDataFrame([(-1, [0.0] * 16)], queries.schema)
    got = dense.retrieve(vectors, queries.union(seen), 2)
    assert dense.CELLS // 3001 < 3000  # a step of a task is smaller than its batch
    best = got.filter("rank = 0 AND query_id > 0").collect()
    assert len(best) == 2999 and all(r.score == 1 for r in best) and got.count() == 6002


def test_texts_are_cut_into_terms_once(spark):
    """However often features need them; and rows of one id add up where the SQL adds them."""
    texts = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, None), (3, "x " * 2000 + "y")], "passage_id long, text string")
    for made in (hash_embed(texts, 16), hash_embed_md5(texts, 16)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = {r.passage_id: r.vector for r in hash_embed_md5(texts, 16).collect()}
    want = [0.0] * 16
    for f in "a b a a_b b_a b c b_c".split():
        h = hashlib.md5(f.encode()).hexdigest()
        want[int(h[:8], 16) % 16] += -1.0 if h[8] >= "8" else 1.0
    norm = math.sqrt(sum(x * x for x in want))
    assert len(got) == 3 and got[2] == [0.0] * 16 and all(abs(a - b / norm) < 1e-12 for a, b in zip(got[1], want))
