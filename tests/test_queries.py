"""Every registered query of the library: against its SQL where there is one, else that it runs over its whole tables."""

import hashlib
import math
import re

import pytest
from compare import FOLDER, assert_same
from pyspark.sql import functions as F
from test_passages import check_packing, plain_units

from cuewright.operators import cues, passages, timeline
from cuewright.plans import fixtures as fx
from cuewright.plans.oracles import ORACLES
from cuewright.plans.queries import QUERIES, _first_questions
from cuewright.sources.settings import Settings


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def cleaned(spark):
    """Cues of each video that cleaning leaves, as the library has them."""
    got = {}
    for r in cues.clean_transcript(fx.cues(spark, FOLDER)).orderBy("video_id", "idx").collect():
        got.setdefault(r.video_id, []).append(r)
    return got


def test_hash_embed_against_plain_hashing(spark):
    rows = {r.passage_id: r.vector for r in QUERIES["hash_embed"](spark, FOLDER).collect()}
    texts = fx.passages(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in texts:
        terms = re.findall("[a-z0-9]+", r.text.lower())
        want = [0.0] * 384
        for f in terms + [f"{a}_{b}" for a, b in zip(terms, terms[1:])]:
            v = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            want[v % 384] += 1 if v >> 63 else -1
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert rows[r.passage_id] == pytest.approx([x / norm for x in want], abs=1e-6)


def test_registered_packing_keeps_the_rules(spark):
    packing, got = Settings().packing, {}
    for r in QUERIES["pack_chunks"](spark, FOLDER).orderBy("video_id", "idx").collect():
        got.setdefault(r.video_id, []).append((r.char_start, r.char_end, r.text))
    texts = {v: " ".join(c.text for c in own) for v, own in cleaned(spark).items()}
    assert set(got) == {v for v, t in texts.items() if t}
    for v, rows in got.items():
        flat = plain_units(texts[v], packing)
        begins, ends = {a: k for k, (a, _) in enumerate(flat)}, {b: k for k, (_, b) in enumerate(flat)}
        check_packing([b - a for a, b in flat], [(begins[a], ends[b]) for a, b, _ in rows], packing)
        assert all(t == texts[v][a:b] for a, b, t in rows)


def test_index_counts(spark):
    got = {r.table_name: r.n for r in QUERIES["index_videos"](spark, FOLDER).collect()}
    packed = QUERIES["pack_chunks"](spark, FOLDER).collect()
    videos, own = fx.cues(spark, FOLDER).select("video_id").distinct().count(), {r.video_id for r in packed}
    assert got == {"videos": videos, "segments": sum(map(len, cleaned(spark).values())), "chunk_sets": len(own), "chunks": len(packed), "embedding_sets": len(own), "embeddings": len(packed), "conversations": 0, "messages": 0}


def test_size_sweep_against_packing_each_size(spark):
    line = timeline.spans(cues.clean(fx.cues(spark, FOLDER)))
    got = {(r.max_chars, r.video_id): (r.passages, r.mean_s, r.mean_chars) for r in QUERIES["chunk_size_sweep"](spark, FOLDER).collect()}
    want = {}
    for size in (400, 700, 1000, 1500):
        held = {}
        for r in passages.pack(line, passages.Packing(size, int(0.17 * size), min(250, size // 3))).collect():
            held.setdefault(r.video_id, []).append(r)
        want |= {(size, v): (len(rs), sum(r.end_s - r.start_s for r in rs) / len(rs), sum(r.n_chars for r in rs) / len(rs)) for v, rs in held.items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def plain_scores(hits, spans):
    """(recall, precision, mrr, ndcg, best IoU) of hits (start, end) in order, by their definitions."""
    shared = lambda h, s: max(0.0, min(h[1], s[1]) - max(h[0], s[0]))
    covers = lambda h, s: (n := min(h[1] - h[0], s[1] - s[0])) > 0 and shared(h, s) / n >= 0.3
    iou = lambda h, s: shared(h, s) / (max(h[1], s[1]) - min(h[0], s[0])) if shared(h, s) else 0.0
    good = [any(covers(h, s) for s in spans) for h in hits]
    gain = sum(1 / math.log2(k + 2) for k, g in enumerate(good) if g)
    best = sum(1 / math.log2(k + 2) for k in range(sum(good)))
    return (
        sum(any(covers(h, s) for h in hits) for s in spans) / len(spans), sum(good) / len(good) if good else 0.0, 1 / (1 + good.index(True)) if any(good) else 0.0, gain / best if best else 0.0,
        sum(max(iou(h, s) for s in spans) for h in hits) / len(hits) if hits else 0.0,
    )


def test_retrievers_and_sizes_against_plain_scores(spark):
    line, asked = timeline.spans(cues.clean(fx.cues(spark, FOLDER))), _first_questions(spark, FOLDER)
    settings, gold = Settings(), {r.case_id: [tuple(s) for s in r.spans] for r in asked.collect()}
    answerable = {r.case_id for r in asked.filter("answerable").collect()}
    got = {r.max_chars: r for r in QUERIES["chunk_retrieval_sweep"](spark, FOLDER).filter("retriever = 'dense'").collect()}
    rows = passages.pack(line, passages.Packing(700, 119, 233))
    own = rows.select(F.lit("all").alias("scope"), F.xxhash64("video_id", "idx").alias("passage_id"), "video_id", "start_s", "end_s", "text").cache()
    texts = own.collect()
    vectors = {r.passage_id: r.vector for r in settings.embed(own.select("passage_id", "text")).collect()}
    places, each = {r.passage_id: (r.start_s, r.end_s) for r in texts}, []
    questions = asked.select(F.xxhash64("case_id").alias("passage_id"), "case_id", F.col("question").alias("text"))
    asked_vectors = {r.passage_id: r.vector for r in settings.embed(questions.select("passage_id", "text")).collect()}
    for r in questions.collect():
        if r.case_id in answerable:
            near = sorted(((-round(sum(a * b for a, b in zip(asked_vectors[r.passage_id], v)), 6), p) for p, v in vectors.items()))[: settings.top_k]
            each.append(plain_scores([places[p] for _, p in near], gold[r.case_id]))
    want = [sum(x) / len(each) for x in zip(*each)]
    row = got[700]
    assert row.n_passages == len(texts)
    assert [row.recall_at_k, row.precision_at_k, row.mrr, row.ndcg_at_k, row.citation_iou] == pytest.approx(want, abs=0.02)  # sums of floats decide ties
    whole = QUERIES["evaluate_retrievers"](spark, FOLDER).collect()
    assert len(whole) == 3 * len(gold) and {r.retriever for r in whole} == {"dense", "sparse", "hybrid"}


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
