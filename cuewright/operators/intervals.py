"""Joins of time ranges: all overlapping pairs of two tables, by cells of time, without a comparison of everything with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width in seconds of the cells of level 0; each level's cells are twice as wide as those of the one below.
FINEST = 0.25


def _level(start: str, end: str) -> Column:
    """The first level whose cells are as wide as the range is long, so that it touches at most two of them."""
    return F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start)) / FINEST))).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / (F.lit(FINEST) * F.pow(F.lit(2.0), level)))


def _placed(df: DataFrame, start: str, end: str, levels: list[int], side: str) -> DataFrame:
    """df, once for each cell that it touches at its own level and at each level above that the other side has."""
    own = F.col(f"_level_{side}")
    levels_ = F.filter(F.array(*map(F.lit, levels)), lambda m: m >= own)
    at = F.flatten(F.transform(F.array_distinct(F.concat(F.array(own), levels_)), lambda m: F.transform(F.sequence(_cell(F.col(start), m), _cell(F.col(end), m)), lambda c: F.struct(m.alias("m"), c.alias("c")))))
    return df.withColumn(f"_level_{side}", _level(start, end)).withColumn("_at", F.explode(at)).select("*", F.col("_at.m").alias("_m"), F.col("_at.c").alias("_c")).drop("_at")


def overlapping(left: DataFrame, right: DataFrame, key: str = "video_id", left_span: tuple[str, str] = ("start_s", "end_s"), right_span: tuple[str, str] = ("gold_start", "gold_end")) -> DataFrame:
    """Pairs of a left and a right row of one key whose ranges share time, with `shared_s` seconds; each pair once.

    Both sides keep their columns, which have to differ but for the key. Ranges meet in cells of the wider one's
    level, of which it touches two at most, so a row is copied twice for each level of length that the other side
    has above its own (doubling lengths, a few dozen at most) and not once for each other row. A pair belongs to the
    cell in which the later of both begins. A key with very many ranges is as many join keys as it has cells. Rows
    without a key, a start or an end, and ranges without length, share time with nothing.
    """
    (a0, a1), (b0, b1) = left_span, right_span
    left, right = (df.filter(F.col(key).isNotNull() & (F.col(e) > F.col(s))) for df, s, e in ((left, a0, a1), (right, b0, b1)))
    # Lengths are doubles, so there are some thousand levels at most; in practice a few dozen.
    levels = [sorted(r[0] for r in df.select(_level(s, e)).distinct().collect()) for df, s, e in ((left, a0, a1), (right, b0, b1))]
    l, r = _placed(left, a0, a1, levels[1], "l"), _placed(right, b0, b1, levels[0], "r")
    pairs = l.join(r, [key, "_m", "_c"]).filter((F.col("_m") == F.greatest("_level_l", "_level_r")) & (F.col("_c") == _cell(F.greatest(a0, b0), F.col("_m"))))
    shared = F.least(a1, b1) - F.greatest(a0, b0)
    return pairs.withColumn("shared_s", shared).filter("shared_s > 0").drop("_m", "_c", "_level_l", "_level_r")
