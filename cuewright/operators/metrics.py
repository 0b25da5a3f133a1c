"""Retrieval and citation metrics against time spans, or against given relevance, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import span_coverage, span_iou

#: Coverage from which a hit is relevant, and IoU from which a citation hits.
RELEVANT, CITED = 0.30, 0.1


def hits_by_span(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Each pair of a hit (case_id, rank, start_s, end_s) and a span of its case (case_id, gold_start, gold_end), with coverage and IoU.

    An equi-join on the case; the few spans of a case are what each of its hits meets.
    """
    ends = [F.col(c) for c in ("start_s", "end_s", "gold_start", "gold_end")]
    return hits.join(spans, "case_id").withColumns({"coverage": span_coverage(*ends), "iou": span_iou(*ends)})


def relevance(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """hits with `relevant`: whether any span of the case is covered enough."""
    found = hits_by_span(hits, spans).groupBy("case_id", "rank").agg(F.max(F.col("coverage") >= RELEVANT).alias("relevant"))
    return hits.join(found, ["case_id", "rank"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def _gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 2)


def ranking_scores(judged: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """(case_id, precision_at_k, mrr, ndcg_at_k) of judged(case_id, rank, relevant); zeros for cases without hits.

    Precision is over the hits returned, the reciprocal rank looks at the whole list, and the ideal of nDCG is
    the same list in the best order.
    """
    top = F.col("rank") < k
    order = Window.partitionBy("case_id").orderBy(F.col("relevant").desc(), "rank")
    placed = judged.filter(top).withColumn("ideal", F.row_number().over(order) - 1)
    gain = F.sum(F.when(F.col("relevant"), _gain(F.col("rank")))) / F.sum(F.when(F.col("relevant"), _gain(F.col("ideal"))))
    near = placed.groupBy("case_id").agg(F.avg(F.col("relevant").cast("int")).alias("precision_at_k"), gain.alias("ndcg_at_k"))
    first = judged.groupBy("case_id").agg((1 / F.min(F.when(F.col("relevant"), F.col("rank") + 1))).alias("mrr"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return cases.select("case_id").join(near, "case_id", "left").join(first, "case_id", "left").select("case_id", zero("precision_at_k"), zero("mrr"), zero("ndcg_at_k"))


def span_recall(hits: DataFrame, spans: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """(case_id, recall_at_k): share of a case's spans that a hit among the first k covers; 0 without spans."""
    pairs = hits_by_span(hits.filter(F.col("rank") < k), spans)
    found = pairs.groupBy("case_id", "gold_start", "gold_end").agg(F.max(F.col("coverage") >= RELEVANT).alias("found"))
    share = spans.join(found, ["case_id", "gold_start", "gold_end"], "left").groupBy("case_id").agg(F.avg(F.coalesce("found", F.lit(False)).cast("int")).alias("recall_at_k"))
    return cases.select("case_id").join(share, "case_id", "left").select("case_id", F.coalesce("recall_at_k", F.lit(0.0)).alias("recall_at_k"))


def passage_iou(hits: DataFrame, spans: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, citation_iou): the mean over a case's hits of the best IoU with a gold span; 0 without hits or spans.

    A citation has the span of its passage, so this is what citations can reach at best, without any answer.
    """
    best = hits_by_span(hits, spans).groupBy("case_id", "rank").agg(F.max("iou").alias("iou"))
    mean = hits.select("case_id", "rank").join(best, ["case_id", "rank"], "left").groupBy("case_id").agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("citation_iou"))
    return cases.select("case_id").join(mean, "case_id", "left").select("case_id", F.coalesce("citation_iou", F.lit(0.0)).alias("citation_iou"))


def retrieval_scores(hits: DataFrame, spans: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """(case_id, recall_at_k, precision_at_k, mrr, ndcg_at_k)."""
    return span_recall(hits, spans, cases, k).join(ranking_scores(relevance(hits, spans), cases, k), "case_id")


def citation_scores(citations: DataFrame, spans: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, citation_precision, citation_hit_rate): mean of each citation's best IoU, and share of citations with one of CITED or more."""
    best = hits_by_span(citations, spans).groupBy("case_id", "rank").agg(F.max("iou").alias("iou"))
    each = citations.join(best, ["case_id", "rank"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))
    means = each.groupBy("case_id").agg(F.avg("iou").alias("citation_precision"), F.avg((F.col("iou") >= CITED).cast("int")).alias("citation_hit_rate"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return cases.select("case_id").join(means, "case_id", "left").select("case_id", zero("citation_precision"), zero("citation_hit_rate"))


def mean_scores(scores: DataFrame, cases: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over answerable cases only; 0 without any."""
    kept = scores.join(cases.filter("answerable").select("case_id"), "case_id", "left_semi")
    return kept.groupBy(*(by or [])).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns))


def summary(results: DataFrame, by: str = "retriever") -> DataFrame:
    """One row for each retriever of case results: mean retrieval, citation and judged scores, and both refusal rates."""
    return results.groupBy(by).agg(*_summaries())


def summaries(results: DataFrame) -> DataFrame:
    """summary for each retriever and tag, for each retriever, for each tag, and for all; null stands for all.

    A case counts once for each of its tags and once without them, so a case of several tags is not counted twice
    where tags do not matter. Every row goes with its partial sums through one shuffle.
    """
    tags = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())))
    sides = F.array(F.lit(None).cast("string"), F.col("retriever").cast("string"))
    spread = results.withColumn("tag", F.explode(tags)).withColumn("side", F.explode(sides)).drop("retriever")
    return spread.groupBy(F.col("side").alias("retriever"), "tag").agg(*_summaries())


def _summaries() -> list[Column]:
    """The columns of a summary.

    results: (by, case_id, answerable, refused, has_answer, recall_at_k, precision_at_k, mrr, ndcg_at_k,
    citation_precision, faithfulness, answer_relevance, correctness). Correctness skips nulls; rates and citations
    count only cases with an answer; empty denominators give 0.
    """
    answerable, answered = F.col("answerable"), F.col("has_answer")
    mean = lambda c, which: F.coalesce(F.avg(F.when(which, F.col(c))), F.lit(0.0)).alias(c)
    rate = lambda which, name: F.coalesce(F.avg(F.when(which & answered, F.col("refused").cast("int"))), F.lit(0.0)).alias(name)
    return [
        F.count("*").alias("cases"), *(mean(c, answerable) for c in ("recall_at_k", "precision_at_k", "mrr", "ndcg_at_k")), mean("citation_precision", answerable & answered & ~F.col("refused")),
        *(F.avg(c).alias(c) for c in ("faithfulness", "answer_relevance", "correctness")), rate(~answerable, "correct_refusal_rate"), rate(answerable, "false_refusal_rate"),
    ]


def failures(results: DataFrame, most: int | None = 8, by: str = "retriever") -> DataFrame:
    """(by, case_id, failure): FALSE REFUSAL, RETRIEVAL MISS or MISSED REFUSAL; the first `most` of each retriever (a report's digest)."""
    label = F.when(F.col("answerable") & F.col("refused"), "FALSE REFUSAL").when(F.col("answerable") & (F.col("recall_at_k") == 0), "RETRIEVAL MISS").when(~F.col("answerable") & ~F.col("refused"), "MISSED REFUSAL")
    found = results.withColumn("failure", label).filter("failure IS NOT NULL").withColumn("retrieved", F.col("recall_at_k") > 0)
    if most is not None:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("case_id"))).filter(F.col("_n") <= most)
    return found.select(by, "case_id", "failure", "retrieved")
