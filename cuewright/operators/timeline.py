"""Where each cue stands in the text of its video, and what time a character has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a cue without length.
INSTANT = 0.001


def spans(cues: DataFrame) -> DataFrame:
    """Cues with half-open character ranges in the video's text (non-empty trimmed texts, one space between) and times."""
    kept = cues.withColumn("text", F.trim("text")).filter("text <> ''")
    size = F.char_length("text")
    line = Window.partitionBy("video_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(size + 1).over(line) - 1
    t_end = F.when(F.col("end_s") > F.col("start_s"), F.col("end_s")).otherwise(F.col("start_s") + INSTANT)
    return kept.select("video_id", F.col("idx").alias("seg_index"), (end - size).cast("int").alias("char_start"), end.cast("int").alias("char_end"), F.col("start_s").alias("t_start"), t_end.alias("t_end"), "text")


def interpolate(pos: Column, char_start: Column, char_end: Column, t_start: Column, t_end: Column) -> Column:
    share = (pos - char_start) / F.nullif(char_end - char_start, F.lit(0))
    return F.when(pos <= char_start, t_start).when(pos >= char_end, t_end).otherwise(t_start + share * (t_end - t_start))


def times_at(positions: DataFrame, timeline: DataFrame) -> DataFrame:
    """positions(video_id, pos, ...) with time_s and seg_index: an as-of join to the last span that begins at or before pos.

    Both sides are sorted into one line for each video and the last span is carried forward: one shuffle and no
    range join. Positions before the first span get its start. Videos without spans get null.
    """
    held = F.struct("seg_index", "char_start", "char_end", "t_start", "t_end")
    extra = [c for c in positions.columns if c not in ("video_id", "pos")]
    left = timeline.select("video_id", F.col("char_start").alias("pos"), F.lit(0).alias("asked"), held.alias("span"), *(F.lit(None).cast(positions.schema[c].dataType).alias(c) for c in extra))
    right = positions.select("video_id", F.greatest("pos", F.lit(0)).alias("pos"), F.lit(1).alias("asked"), F.lit(None).cast(left.schema["span"].dataType).alias("span"), *extra)
    line = Window.partitionBy("video_id").orderBy("pos", "asked")
    found = left.unionByName(right).withColumn("s", F.last("span", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("asked = 1")
    time = interpolate(F.col("pos"), *(F.col(f"s.{c}") for c in ("char_start", "char_end", "t_start", "t_end")))
    return found.select("video_id", "pos", *extra, time.alias("time_s"), F.col("s.seg_index").alias("seg_index"))


def recent(marks: DataFrame, seconds: float = 30.0, key: str = "video_id") -> DataFrame:
    """marks(key, at_s, talk_s, hit) with talk_share, hit_share and silence_s over those that begin in the last `seconds` up to and with each.

    talk_s is how long a mark lasts, hit whether it counts as one. The frame is one of values: however many marks a
    second has, it reaches back the same time. Marks that begin together see each other.
    """
    frame = f"OVER (PARTITION BY `{key}` ORDER BY CAST(at_s AS DOUBLE) RANGE BETWEEN {float(seconds)}D PRECEDING AND CURRENT ROW)"
    talk = F.least(F.lit(float(seconds)), F.expr(f"sum(talk_s) {frame}"))
    return marks.withColumns({"talk_share": talk / seconds, "hit_share": F.expr(f"avg(CAST(hit AS DOUBLE)) {frame}"), "silence_s": F.lit(float(seconds)) - talk})


def time_coverage(ranges: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, covered_s): seconds that the union of (key, start_s, end_s) covers; ranges that touch or overlap are islands."""
    before = Window.partitionBy(key).orderBy("start_s", "end_s").rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy(key).orderBy("start_s", "end_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = ranges.withColumn("reach", F.max("end_s").over(before))
    marked = reach.withColumn("island", F.sum(F.when(F.col("start_s") <= F.col("reach"), 0).otherwise(1)).over(line))
    islands = marked.groupBy(key, "island").agg((F.max("end_s") - F.min("start_s")).alias("s"))
    return islands.groupBy(key).agg(F.sum("s").alias("covered_s"))
