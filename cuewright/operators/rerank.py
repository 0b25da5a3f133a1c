"""Second-stage ranking of a pool of hits, and confidences over hit lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from .lexical import DIGITS


def jaccard_logit(query: Column, passage: Column) -> Column:
    """12 J - 6 of the sets of words over two letters, in lower case; -6 if both are empty."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: F.char_length(w) > 2))
    a, b = words(query), words(passage)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, -6.0).otherwise(12.0 * F.size(F.array_intersect(a, b)) / union - 6.0)


def rerank(hits: DataFrame, queries: DataFrame, passages: DataFrame, k: int, pool: int = 30, logit: Callable[[Column, Column], Column] = jaccard_logit) -> DataFrame:
    """The best k of the first `pool` hits by logit(query text, passage text), ties by the rank before.

    logit may be a pandas UDF around a cross-encoder. Columns base_score, base_rank and logit tell both stages;
    confidence is the logit's sigmoid.
    """
    short = hits.filter(F.col("rank") < max(pool, k)).select("query_id", "passage_id", F.col("score").alias("base_score"), F.col("rank").alias("base_rank"))
    texts = short.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(passages.select("passage_id", F.col("text").alias("_p")), "passage_id")
    scored = texts.withColumn("logit", F.round(logit(F.col("_q"), F.col("_p")), DIGITS)).drop("_q", "_p")
    line = Window.partitionBy("query_id").orderBy(F.col("logit").desc(), "base_rank")
    best = scored.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)
    return best.select("query_id", "passage_id", F.col("logit").alias("score"), (F.col("rank") - 1).alias("rank"), sigmoid(F.col("logit")).alias("confidence"), "base_score", "base_rank", "logit")


def best_confidence(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, confidence): the highest of all hits, which need not be the first's; 0 without hits."""
    best = hits.groupBy("query_id").agg(F.max("confidence").alias("confidence"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
