"""Numbers, running sums and ranks over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize


def running(df: DataFrame, order: list[Column], amount: Column, out: str) -> DataFrame:
    """df with the sum of `amount` over all rows before this one in an order without ties.

    Rows are dealt to partitions by ranges of the order. Within a partition a window sums up; what the partitions
    before it hold comes as one number for each, so the driver sees as many numbers as there are partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(df.withColumn("_amount", amount).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = sorted((r[0], r[1]) for r in laid.groupBy("_part").agg(F.sum("_amount")).collect())
    before, total = {}, 0
    for part, n in sums:
        before[part] = total
        total += n
    line = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("_part")) if before else F.lit(0)
    return laid.withColumn(out, F.coalesce(F.sum("_amount").over(line), F.lit(0)) + base).drop("_amount", "_part")


def numbered(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """df with its place in an order without ties, from 0."""
    return running(df, order, F.lit(1).cast("long"), out)


def percent_ranks(df: DataFrame, column: str, out: str = "percent_rank") -> DataFrame:
    """df with the share of the other rows that lie below each row's value; equal values have equal ranks, nulls have none.

    Equal values are counted first, so a value that very many rows have is one row of the running sum.
    """
    held = df.filter(F.col(column).isNotNull())
    counts = running(held.groupBy(column).agg(F.count("*").alias("_n")), [F.col(column)], F.col("_n"), "_below")
    others = F.greatest(F.lit(1), df.select(F.count(column)).first()[0] - F.lit(1))
    return df.join(counts.select(column, (F.col("_below") / others).alias(out)), column, "left")
