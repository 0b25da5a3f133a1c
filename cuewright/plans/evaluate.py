"""Evaluating retrievers, and whole answers, against cases with time spans."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers as ans
from ..operators.calibrate import threshold_sweep
from ..operators.cases import with_depth
from ..operators.citations import context, within_budget
from ..operators.metrics import citation_scores, passage_iou, retrieval_scores
from ..operators.passages import Packing, pack, pack_sizes
from ..shared import materialize
from ..sources.settings import Settings
from .retrieve import asked_vectors, retrieve_each


def case_spans(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.explode("spans").alias("s")).select("case_id", "s.*")


def _located(hits: DataFrame, passages: DataFrame) -> DataFrame:
    return hits.join(passages.select("passage_id", "video_id", "start_s", "end_s", "text"), "passage_id")


def evaluate(name: str, cases: DataFrame, passages: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None, load: Callable[[], ans.Model] | None = None, combined: bool = True) -> DataFrame:
    """A row for each case: retrieval scores and, with a model, answer, citation and judged scores.

    passages: (scope, passage_id, video_id, start_s, end_s, text). Without a model nothing is answered, so refusal
    and citation scores and latency are empty, and every question is searched for as it stands. With one, follow-ups
    are asked after the cases that they follow, with those as history: a round for each depth asks all
    conversations at once. Retrieval is scored on what the answer kept: the hits in its context, or all hits if it
    refused. combined: one call of the judge a case.
    """
    if load is not None:
        return _evaluate_answers(name, cases, passages, settings, vectors, load, combined)
    return evaluate_each((name,), cases, passages, settings, vectors)


def evaluate_each(names: tuple[str, ...], cases: DataFrame, passages: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None) -> DataFrame:
    """evaluate without a model, for several retrievers, which share what they search for."""
    spans, none, out = case_spans(cases), F.lit(None).cast("double"), []
    for name, found in _search_each(names, cases.withColumn("search_text", F.col("question")), passages, settings, vectors).items():
        hits = materialize(found)
        one = _with_top(cases, hits).join(retrieval_scores(hits, spans, cases, settings.top_k), "case_id")
        out.append(one.withColumns({"refused": F.lit(False), "has_answer": F.lit(False), "citation_precision": F.lit(0.0), "citation_hit_rate": F.lit(0.0), **dict.fromkeys(ans.JUDGED, none), "retriever": F.lit(name), "latency_ms": none}))
    return reduce(DataFrame.unionByName, out)


def _numbered(asked: DataFrame) -> DataFrame:
    return asked.select(F.xxhash64("case_id").alias("query_id"), "case_id", F.col("search_text").alias("text"))


def _search_each(names: tuple[str, ...], asked: DataFrame, passages: DataFrame, settings: Settings, vectors: DataFrame | None, asked_with: DataFrame | None = None) -> dict[str, DataFrame]:
    """Hits of each retriever for asked(case_id, search_text), with their passages and the case."""
    numbered = _numbered(asked)
    each = retrieve_each(names, passages, numbered.select("query_id", "text"), settings, vectors, asked_with)
    return {n: _located(hits, passages).join(numbered.select("query_id", "case_id"), "query_id") for n, hits in each.items()}


def _search(name: str, asked: DataFrame, passages: DataFrame, settings: Settings, vectors: DataFrame | None) -> DataFrame:
    return _search_each((name,), asked, passages, settings, vectors)[name]


def _with_top(cases: DataFrame, hits: DataFrame) -> DataFrame:
    top = hits.groupBy("case_id").agg(F.max("confidence").alias("top_confidence"))
    return cases.select("case_id", "answerable", "tags", "followup_to").join(top, "case_id", "left").withColumn("top_confidence", F.coalesce("top_confidence", F.lit(0.0)))


def _evaluate_answers(name: str, cases: DataFrame, passages: DataFrame, settings: Settings, vectors: DataFrame | None, load: Callable[[], ans.Model], combined: bool) -> DataFrame:
    placed = materialize(with_depth(cases))  # a case in or after a cycle has no depth and is asked as a first question
    placed = placed.withColumn("depth", F.coalesce("depth", F.lit(0)))
    turns, rounds = None, []
    for depth in range((placed.agg(F.max("depth")).first()[0] or 0) + 1):
        now = placed.filter(F.col("depth") == depth)
        before = None
        if turns is not None:
            # A case's history is its predecessor's and the predecessor's own two turns.
            before = materialize(now.select("case_id", F.col("followup_to").alias("_up")).join(turns.withColumnRenamed("case_id", "_up"), "_up").select("case_id", "turn", "role", "text"))
        asked = now.withColumn("search_text", F.col("question"))
        if before is not None and settings.rewrite:
            history = ans.history_text(before.withColumnRenamed("case_id", "conversation_id"), settings.history_turns)
            known = now.select(F.col("case_id").alias("question_id"), F.col("case_id").alias("conversation_id"), F.col("question").alias("text"))
            found = materialize(ans.rewrite(known, history, load).select(F.col("question_id").alias("case_id"), "search_text"))
            asked = now.join(found, "case_id")
        hits = materialize(_search(name, asked, passages, settings, vectors))
        questions = now.select(F.xxhash64("case_id").alias("question_id"), F.col("question").alias("text"))
        told, citations, kept = ans.answer(questions, hits.withColumnRenamed("query_id", "question_id").drop("case_id"), load, settings.min_score, settings.require_citations, settings.max_context_chars)
        ids = now.select(F.xxhash64("case_id").alias("question_id"), "case_id")
        told, citations, kept = (materialize(x.join(ids, "question_id")) for x in (told, citations, kept))
        rounds.append((hits, told, citations, kept))
        own = told.join(now.select("case_id", "question"), "case_id")
        pair = own.select("case_id", F.explode(F.array(F.struct(F.lit(2 * depth).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(2 * depth + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("text")))).alias("t")).select("case_id", "t.*")
        turns = pair if before is None else before.filter(F.col("turn") >= 2 * depth - settings.history_turns).unionByName(pair)
    hits, told, citations, kept = (reduce(DataFrame.unionByName, side) for side in zip(*rounds))
    spans = case_spans(cases)
    given = told.select("question_id", "case_id", "text", "refused").join(cases.select("case_id", "question", "expected"), "case_id")
    given = given.join(context(within_budget(hits.withColumnRenamed("query_id", "question_id").drop("case_id"), settings.max_context_chars)), "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    judged = materialize(ans.judge(given.select("question_id", "case_id", "question", "context", "text", "refused", "expected"), load, combined).select("case_id", "refused", *ans.JUDGED))
    cited = citations.select("case_id", F.col("place").alias("rank"), "start_s", "end_s")
    out = _with_top(cases, hits).join(retrieval_scores(kept, spans, cases, settings.top_k), "case_id").join(citation_scores(cited, spans, cases), "case_id")
    out = out.join(judged, "case_id").join(told.select("case_id", "latency_ms"), "case_id")
    return out.withColumns({"has_answer": F.lit(True), "retriever": F.lit(name)})


def calibrate(results: DataFrame) -> DataFrame:
    """Thresholds over the top confidences of first questions; follow-ups stay out, as their search depends on the talk."""
    return threshold_sweep(results.filter("followup_to IS NULL").select(F.col("top_confidence").alias("confidence"), "answerable"))


def size_grid(sizes: tuple[int, ...] = (400, 700, 1000, 1500)) -> list[Packing]:
    """Packings of several sizes: an overlap of 17 % and a least size of a third, at most 250."""
    return [Packing(size, int(0.17 * size), min(250, size // 3)) for size in sizes]


def sweep_sizes(timeline: DataFrame, sizes: tuple[int, ...] = (400, 700, 1000, 1500)) -> DataFrame:
    """(max_chars, video_id, passages, mean_s, mean_chars) of each packing of the same timeline."""
    out = None
    for packing in size_grid(sizes):
        one = pack(timeline, packing).groupBy("video_id").agg(F.count("*").alias("passages"), F.avg(F.col("end_s") - F.col("start_s")).alias("mean_s"), F.avg("n_chars").alias("mean_chars")).withColumn("max_chars", F.lit(packing.max_chars))
        out = one if out is None else out.unionByName(one)
    return out


def sweep_retrieval(timeline: DataFrame, cases: DataFrame, settings: Settings = Settings(), sizes: tuple[int, ...] = (400, 700, 1000, 1500), names: tuple[str, ...] = ("dense", "hybrid")) -> DataFrame:
    """What retrieval reaches at each size of passages: a row for each size and retriever, means over the answerable cases.

    (max_chars, retriever, n_passages, mean_s, recall_at_k, precision_at_k, mrr, ndcg_at_k, citation_iou). All videos
    of the timeline are one scope; cases: (case_id, question, answerable, spans).
    """
    asked = materialize(cases.filter("answerable").withColumn("search_text", F.col("question")))
    spans, numbered = case_spans(asked), _numbered(asked)
    asked_with = asked_vectors(numbered, settings) if set(names) - {"sparse"} else None
    rows = materialize(pack_sizes(materialize(timeline), size_grid(sizes)).withColumn("passage_id", F.xxhash64("video_id", "idx")))
    # Passages of all sizes of a video follow each other: what they have in common is hashed once, and each task writes some of each size.
    every = settings.embed(rows.select(F.struct("max_chars", F.col("passage_id").alias("id")).alias("passage_id"), "text"))
    vectors, found = materialize(every.select("passage_id.max_chars", F.col("passage_id.id").alias("passage_id"), "vector"), "max_chars"), []
    for size in sizes:
        of_size = F.col("max_chars") == size
        own = rows.filter(of_size).select(F.lit("all").alias("scope"), "passage_id", "video_id", "start_s", "end_s", "text")
        each = _search_each(names, asked, own, settings, vectors.filter(of_size).drop("max_chars"), asked_with)
        found += [hits.withColumns({"max_chars": F.lit(size), "retriever": F.lit(name)}) for name, hits in each.items()]
    # A case of a size and a retriever is a case of its own, so that all are scored together.
    keys = asked.sparkSession.createDataFrame([(s, n) for s in sizes for n in names], "max_chars int, retriever string")
    case = F.struct("max_chars", "retriever", "case_id").alias("case_id")
    hits = materialize(reduce(DataFrame.unionByName, found).withColumn("case_id", case))
    spans, asked = spans.crossJoin(keys).withColumn("case_id", case).drop(*keys.columns), asked.select("case_id").crossJoin(keys).select(case)
    scores = retrieval_scores(hits, spans, asked, settings.top_k).join(passage_iou(hits, spans, asked), "case_id")
    means = scores.groupBy("case_id.max_chars", "case_id.retriever").agg(*(F.avg(c).alias(c) for c in scores.columns[1:]))
    size = rows.groupBy("max_chars").agg(F.count("*").alias("n_passages"), F.avg(F.col("end_s") - F.col("start_s")).alias("mean_s"))
    # Without answerable cases, or without passages, a size and retriever still has its row.
    told = keys.join(size, "max_chars", "left").join(means, ["max_chars", "retriever"], "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))
    return told.select("max_chars", "retriever", "n_passages", "mean_s", "recall_at_k", "precision_at_k", "mrr", "ndcg_at_k", "citation_iou")
