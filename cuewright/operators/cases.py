"""Evaluation cases: what makes a benchmark invalid, and the order in which a conversation's cases run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from .ordered import numbered


def validate(cases: DataFrame) -> DataFrame:
    """(case_id, problem) for cases(case_id, question, answerable, n_spans, followup_to); an empty table is a problem with a null id."""
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("duplicate id").alias("problem"))
    bare = cases.filter("answerable AND n_spans = 0").select("case_id", F.lit("answerable without spans").alias("problem"))
    odd = cases.filter("NOT answerable AND n_spans > 0").select("case_id", F.lit("unanswerable with spans").alias("problem"))
    ids = cases.select(F.col("case_id").alias("followup_to")).distinct()
    lost = cases.filter("followup_to IS NOT NULL").join(ids, "followup_to", "left_anti").select("case_id", F.lit("unknown follow-up").alias("problem"))
    empty = cases.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"), F.lit("no cases").alias("problem"))
    return twice.union(bare).union(odd).union(lost).union(empty)


def with_depth(cases: DataFrame) -> DataFrame:
    """cases with depth: 0 for a first question, else one more than the case it follows; null in or after a cycle or if that is unknown.

    Each round joins every open case with the ancestor of its ancestor, so rounds grow with the logarithm of the longest chain.
    """
    step = F.when(F.col("followup_to").isNull(), 0).otherwise(1)
    steps = materialize(cases.select("case_id", F.col("followup_to").alias("up"), step.alias("depth")))
    done, still = steps.filter("up IS NULL"), steps.filter("up IS NOT NULL")
    while True:
        hop = done.union(still).select(F.col("case_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        longer = materialize(still.join(hop, "up").select("case_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")))
        ended = longer.filter("up IS NULL")
        # A chain has cases of every depth up to its own, so a round in which none ends leaves only cycles.
        if ended.isEmpty():
            return cases.join(done.select("case_id", "depth"), "case_id", "left")
        done, still = done.union(ended), longer.filter("up IS NOT NULL")


def in_order(cases: DataFrame, place: str = "place") -> DataFrame:
    """cases(case_id, followup_to, place) with `position`: the order in which all can be asked, as their file has them else.

    A case stands right after what it follows where the file would have it earlier: it comes when the file first
    names it or a case after it in its conversation, and of those that come together the earlier turns come first.
    Cases in or after a cycle, and after one that is unknown, have no position. Each round lets a case know of
    followers twice as far away, so rounds grow with the logarithm of the longest chain, and a case keeps one number.
    """
    own = with_depth(cases).select("case_id", F.col("followup_to").alias("up"), place, "depth").filter("depth IS NOT NULL")
    held = materialize(own.withColumn("first", F.col(place)))
    longest = held.agg(F.max("depth")).first()[0] or 0
    for _ in range(longest.bit_length()):
        below = held.filter("up IS NOT NULL").groupBy(F.col("up").alias("case_id")).agg(F.min("first").alias("below"))
        above = held.select(F.col("case_id").alias("up"), F.col("up").alias("next"))
        held = materialize(held.join(below, "case_id", "left").join(above, "up", "left").select("case_id", F.col("next").alias("up"), place, "depth", F.least("first", "below").alias("first")))
    placed = numbered(held.select("case_id", "first", "depth"), [F.col("first"), F.col("depth"), F.col("case_id")])
    return cases.join(placed.select("case_id", "position"), "case_id", "left")


def split(cases: DataFrame) -> DataFrame:
    """(answerable, unanswerable) counts."""
    return cases.agg(F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable"))
