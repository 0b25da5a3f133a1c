"""Registered evaluations of retrievers against the same searches in plain Python, case by case."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import FOLDER
from pyspark.sql import functions as F
from test_queries import plain_scores

from cuewright.functions.tokens import STOPWORDS
from cuewright.operators import cues, dense, lexical, passages, timeline
from cuewright.operators.tops import Best
from cuewright.plans import fixtures as fx
from cuewright.plans.queries import QUERIES, _first_questions, _index
from cuewright.sources.settings import Settings


def terms(text):
    found = re.findall("[a-z0-9]+(?:['-][a-z0-9]+)*", text.lower())
    spread = [x for w in found for x in ([w, *re.split("['-]", w)] if re.search("['-]", w) else [w])]
    return [w for w in spread if w not in STOPWORDS]


class Plain:
    """Dense, lexical and fused search over passages (id, start_s, end_s, text) with their vectors."""

    def __init__(self, rows, vectors):
        self.places, self.vectors = {r.passage_id: (r.start_s, r.end_s) for r in rows}, vectors
        self.counts = {r.passage_id: Counter(terms(r.text)) for r in rows}
        self.sizes = {p: sum(c.values()) for p, c in self.counts.items()}
        self.mean = sum(self.sizes.values()) / max(1, len(rows))
        self.df = Counter(t for c in self.counts.values() for t in c)

    def dense(self, vector, k):
        scores = {p: round(sum(a * b for a, b in zip(vector, v)), 6) for p, v in self.vectors.items()}
        return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]

    def sparse(self, text, k):
        scores = {}
        for t, n in Counter(terms(text)).items():
            idf = math.log(1 + (len(self.counts) - self.df[t] + 0.5) / (self.df[t] + 0.5))
            for p, c in self.counts.items():
                if c[t]:
                    scores[p] = scores.get(p, 0.0) + n * idf * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * self.sizes[p] / self.mean))
        kept = {p: round(s, 6) for p, s in scores.items() if round(s, 6) > 0}
        return sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:k]

    def search(self, name, text, vector, k, pool):
        """(passage, confidence) of the best k."""
        sure = lambda s: max(0.0, min(1.0, s))
        lexical = lambda s: 1 - math.exp(-s / 8.0)
        if name == "dense":
            return [(p, sure(s)) for p, s in self.dense(vector, k)]
        if name == "sparse":
            return [(p, lexical(s)) for p, s in self.sparse(text, k)]
        d, s = self.dense(vector, pool), self.sparse(text, pool)
        rank = [{p: i for i, (p, _) in enumerate(x)} for x in (d, s)]
        score = {p: round(sum(1 / (61 + r[p]) for r in rank if p in r), 6) for p in {**rank[0], **rank[1]}}
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
        d, s = dict(d), dict(s)
        return [(p, (a := sure(d.get(p, 0.0))) + 0.15 * (lexical(s[p]) if p in s else 0.0) * (1 - a)) for p, _ in best]


def asked_with_vectors(spark, settings):
    asked = _first_questions(spark, FOLDER).cache()
    numbered = asked.select(F.xxhash64("case_id").alias("passage_id"), "case_id", F.col("question").alias("text"))
    vectors = {r.passage_id: r.vector for r in settings.embed(numbered.select("passage_id", "text")).collect()}
    return {r.case_id: (r.text, vectors[r.passage_id]) for r in numbered.collect()}, {r.case_id: [tuple(s) for s in r.spans] for r in asked.collect()}, {r.case_id for r in asked.collect() if r.answerable}


def near(got, want):
    """Scores of sums of floats may order equal hits the other way."""
    return all(abs(a - b) < 1e-4 for a, b in zip(got, want))


def test_every_retriever_case_by_case(spark):
    settings, store = Settings(), _index(spark, FOLDER)
    asked, gold, _ = asked_with_vectors(spark, settings)
    key = settings.packing.fingerprint()
    rows = store.chunks(key).withColumnRenamed("chunk_id", "passage_id").collect()
    own = Plain(rows, {r.chunk_id: r.vector for r in store.embeddings(key, settings.model_id).collect()})
    got = {(r.retriever, r.case_id): r for r in QUERIES["evaluate_retrievers"](spark, FOLDER).collect()}
    assert len(got) == 3 * len(asked)
    agreed = 0
    for (name, case), r in got.items():
        hits = own.search(name, *asked[case], settings.top_k, settings.candidate_k)
        want = [*plain_scores([own.places[p] for p, _ in hits], gold[case])[:4], max((c for _, c in hits), default=0.0)]
        agreed += near([r.recall_at_k, r.precision_at_k, r.mrr, r.ndcg_at_k, r.top_confidence], want)
    assert agreed >= 0.98 * len(got)


def test_every_row_of_the_retrieval_sweep(spark):
    settings, line = Settings(), timeline.spans(cues.clean(fx.cues(spark, FOLDER)))
    asked, gold, answerable = asked_with_vectors(spark, settings)
    got = {(r.max_chars, r.retriever): r for r in QUERIES["chunk_retrieval_sweep"](spark, FOLDER).collect()}
    assert len(got) == 8
    for size in {s for s, _ in got}:
        packed = passages.pack(line, passages.Packing(size, int(0.17 * size), min(250, size // 3)))
        frame = packed.select(F.xxhash64("video_id", "idx").alias("passage_id"), "start_s", "end_s", "text").cache()
        own = Plain(frame.collect(), {r.passage_id: r.vector for r in settings.embed(frame.select("passage_id", "text")).collect()})
        for name in {n for s, n in got if s == size}:
            each = [plain_scores([own.places[p] for p, _ in own.search(name, *asked[c], settings.top_k, settings.candidate_k)], gold[c]) for c in answerable]
            row, want = got[size, name], [sum(x) / len(each) for x in zip(*each)]
            assert row.n_passages == len(own.places)
            assert [row.recall_at_k, row.precision_at_k, row.mrr, row.ndcg_at_k, row.citation_iou] == pytest.approx(want, abs=0.005)


def test_hits_are_added_up_where_postings_lie(spark):
    """Queries times passages are not shuffled before they are ranked, and several tasks give what one gives."""
    passages, questions = fx.passages(spark, FOLDER), fx.questions(spark, FOLDER)
    plan = lexical.score(passages, questions)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and plan.count(" Exchange ") == 1
    one = lexical.retrieve(passages, questions, 5).collect()
    before, lexical.PAIRS = lexical.PAIRS, 1000
    try:
        assert sorted(lexical.retrieve(passages, questions, 5).collect()) == sorted(one) and len(one) > 100
    finally:
        lexical.PAIRS = before


def test_tiles_give_what_all_scores_ranked_give(spark, monkeypatch):
    """Pairs of a passage and a query are never rows: small tiles of both hand on k hits of a query each, and ties and repeated ids are as in one line."""
    said = [(s, i // 2 if i % 7 == 0 else i, " ".join(f"w{(i * k) % 11}" for k in range(1, 2 + i % 9)) * (i % 13 > 0)) for s in ("a", "b", None) for i in range(90)]
    passages = spark.createDataFrame(said, "scope string, passage_id long, text string")
    queries = spark.createDataFrame([(q, f"w{q % 11} w{q % 5} w{q % 5} other") for q in range(40)], "query_id long, text string")
    for name, size in (("PASSAGES", 16), ("POSTINGS", 100), ("QUERIES", 16), ("TERMS", 50), ("CELLS", 37)):
        monkeypatch.setattr(lexical, name, size)
    bound = queries.withColumn("scope", F.when(F.col("query_id") % 2 == 0, "a").otherwise("b"))
    for asked in (queries, bound):
        for k in (0, 1, 4, 500):
            want = lexical.ranked(lexical.score(passages, asked), k).select("query_id", "scope", "passage_id", "score", "rank")
            got = lexical.retrieve(passages, asked, k).drop("confidence")
            assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    rows = lexical.best(passages, queries, 2).groupBy("scope", "query_id").count()
    assert rows.agg(F.max("count")).first()[0] <= 2 * lexical.TILES < 90 / 2


def test_best_of_blocks_is_what_sorting_gives():
    rng = np.random.default_rng(3)
    for k, positive in ((1, False), (3, True), (5, False)):
        scores = np.round(rng.normal(size=(7, 700)), 1) * (rng.random((7, 700)) < 0.9)  # many ties, and many zeros
        scores[2], scores[3, 5:] = -1.0, 0.0
        held = Best(7, k, positive)
        for first, stop in ((300, 700), (0, 2), (2, 300)):
            for row in (0, 3):
                held.offer(row, scores[row : row + 3 + row // 3, first:stop], 10 * np.arange(first, stop))
        want = [(q, 10 * i, scores[q, i]) for q in range(7) for i in sorted((i for i in range(700) if scores[q, i] > 0 or not positive), key=lambda i: (-scores[q, i], i))[:k]]
        assert list(zip(*(x.tolist() for x in held.hits()))) == want


def test_sizes_packed_together(spark):
    line = timeline.spans(cues.clean(fx.cues(spark, FOLDER))).cache()
    every = passages.pack_sizes(line, [passages.Packing(size, size // 6, size // 3) for size in (900, 60, 300)])
    for size in (900, 60, 300):
        one = passages.pack(line, passages.Packing(size, size // 6, size // 3))
        assert sorted(every.filter(F.col("max_chars") == size).drop("max_chars").collect()) == sorted(one.collect())


@pytest.mark.parametrize("name, searches, packings", [("chunk_retrieval_sweep", 4, 1), ("evaluate_retrievers", 1, 1)])
def test_what_retrievers_share_is_made_once(spark, monkeypatch, name, searches, packings):
    """Each size is searched once by vectors and once by terms, whatever the number of retrievers, and units are made once for all sizes."""
    did = Counter()
    for module, f in ((dense, "retrieve"), (lexical, "retrieve"), (passages, "whole_units")):
        monkeypatch.setattr(module, f, lambda *a, key=(module.__name__, f), whole=getattr(module, f), **b: (did.update([key]), whole(*a, **b))[1])
    QUERIES[name](spark, FOLDER)
    assert [did[m.__name__, f] for m, f in ((dense, "retrieve"), (lexical, "retrieve"), (passages, "whole_units"))] == [searches, searches, packings]
