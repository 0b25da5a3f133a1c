"""Which confidence is too low to answer: a sweep of thresholds and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 20
#: Share of answerable questions that may be refused.
TOLERATED = 0.15


def threshold_sweep(confidences: DataFrame, steps: int = STEPS) -> DataFrame:
    """(threshold, correct_refusal_rate, false_refusal_rate, youden_j) for thresholds 0, 1/steps, ... 1.

    confidences: (confidence, answerable). Cases are counted by the first threshold above their confidence, so
    one aggregate over the cases is all that is shuffled, whatever the number of thresholds.
    """
    # The first step s with confidence < s / steps; beyond the last: never refused.
    first = F.least(F.lit(steps + 1), F.greatest(F.lit(0), F.floor(F.col("confidence") * steps).cast("int") + 1))
    # Guard the edge where a product rounds across a step.
    below = F.when((first > 0) & (F.col("confidence") < (first - 1) / steps), first - 1).when(F.col("confidence") >= first / steps, first + 1).otherwise(first)
    counted = confidences.groupBy(below.alias("step")).agg(F.count_if("answerable").alias("yes"), F.count_if(~F.col("answerable")).alias("no"))
    sums = counted.agg(*(F.sum(c).alias(f"all_{c}") for c in ("yes", "no")), F.collect_list(F.struct("step", "yes", "no")).alias("steps"))
    upto = lambda c: F.aggregate("steps", F.lit(0).cast("long"), lambda n, x: n + F.when(x["step"] <= F.col("id"), x[c]).otherwise(0))
    rate = lambda c: F.coalesce(upto(c) / F.nullif(F.col(f"all_{c}"), F.lit(0)), F.lit(0.0))
    grid = sums.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(steps))))  # one row of at most steps + 3 counts, once for each threshold
    return grid.select((F.col("id") / steps).alias("threshold"), rate("no").alias("correct_refusal_rate"), rate("yes").alias("false_refusal_rate")).withColumn("youden_j", F.col("correct_refusal_rate") - F.col("false_refusal_rate"))


def best_threshold(sweep: DataFrame, tolerated: float = TOLERATED) -> DataFrame:
    """The sweep's row with the most correct refusals among those within the tolerated false ones, else with the highest J; ties go to the lowest."""
    fine = F.col("false_refusal_rate") <= tolerated
    order = F.struct(fine.alias("fine"), F.when(fine, F.col("correct_refusal_rate")).otherwise(F.col("youden_j")).alias("value"), (-F.col("threshold")).alias("low"))
    return sweep.agg(F.max_by(F.struct(*sweep.columns), order).alias("best")).select("best.*")
