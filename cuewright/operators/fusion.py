"""Hybrid retrieval: the union of dense and lexical candidates, fused by rank or by scaled score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import DIGITS, ranked

RRF_K = 60
ALPHA = 0.5
#: A lexical hit closes at most this share of what the dense confidence leaves open.
LEXICAL_SHARE = 0.15
#: Below this width a list of scores has no range.
FLAT = 1e-12


def candidates(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, passage_id, dense_*, lexical_*): full outer join of two hit lists with score, rank and confidence; a missing side is null."""
    side = lambda hits, name: hits.select("query_id", "passage_id", *(F.col(c).alias(f"{name}_{c}") for c in ("score", "rank", "confidence")))
    return side(dense, "dense").join(side(lexical, "lexical"), ["query_id", "passage_id"], "full")


def rrf(k: int = RRF_K) -> Column:
    part = lambda side: F.coalesce(1 / (k + F.col(f"{side}_rank") + 1), F.lit(0.0))
    return part("dense") + part("lexical")


def scaled(score: str) -> Column:
    """Scores of one side from 0 to 1 within a query; without a range 1 if they are positive, else 0; a missing side 0."""
    whole = Window.partitionBy("query_id")
    low, high = F.min(score).over(whole), F.max(score).over(whole)
    inside = F.when(high - low < FLAT, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((F.col(score) - low) / (high - low))
    return F.when(F.col(score).isNull(), 0.0).otherwise(inside)


def weighted(alpha: float = ALPHA) -> Column:
    return alpha * scaled("dense_score") + (1 - alpha) * scaled("lexical_score")


def anchored_confidence() -> Column:
    d, s = F.coalesce("dense_confidence", F.lit(0.0)), F.coalesce("lexical_confidence", F.lit(0.0))
    return d + LEXICAL_SHARE * s * (1 - d)


def fuse(dense: DataFrame, lexical: DataFrame, k: int, mode: str = "rrf", rrf_k: int = RRF_K, alpha: float = ALPHA) -> DataFrame:
    """The best k candidates: (query_id, passage_id, score, rank, confidence) and both sides' columns."""
    if mode not in ("rrf", "weighted"):
        raise ValueError(f"unknown fusion: {mode}")
    both = candidates(dense, lexical)
    fused = both.withColumn("score", F.round(rrf(rrf_k) if mode == "rrf" else weighted(alpha), DIGITS)).withColumn("confidence", anchored_confidence())
    return ranked(fused, k, per=("query_id",))
