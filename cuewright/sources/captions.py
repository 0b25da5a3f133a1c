"""Caption tracks and metadata: which of several sources a video's rows come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_locator

KINDS = ("manual", "generated", "translated", "unknown")


def kind_priority(kind: Column, prefer_manual: bool = True) -> Column:
    """0 for the kind to take first; a kind outside KINDS fails the job."""
    order = KINDS if prefer_manual else (KINDS[1], KINDS[0], *KINDS[2:])
    place = F.array_position(F.array(*map(F.lit, order)), kind)
    return F.when(place > 0, place - 1).otherwise(F.raise_error(F.concat(F.lit("unknown kind of transcript: "), F.coalesce(kind, F.lit("null")))))


def prefer_track(tracks: DataFrame, languages: tuple[str, ...] = ("en", "en-US", "en-GB"), prefer_manual: bool = True) -> DataFrame:
    """One track of each video from tracks(video_id, language, kind, ...): by kind, then by the languages' order, then by name."""
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("language"))
    line = Window.partitionBy("video_id").orderBy(kind_priority(F.col("kind"), prefer_manual), F.when(place > 0, place).otherwise(len(languages) + 1), "language")
    return tracks.withColumn("_n", F.row_number().over(line)).filter("_n = 1").drop("_n")


def first_available(providers: list[DataFrame]) -> DataFrame:
    """All rows of each video from the first provider that has any, with `provider` its place in the list."""
    every = reduce(DataFrame.unionByName, (p.withColumn("provider", F.lit(i)) for i, p in enumerate(providers)))
    first = every.groupBy("video_id").agg(F.min("provider").alias("provider"))
    return every.join(first, ["video_id", "provider"])


def with_metadata(videos: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """videos(video_id) with title, channel and duration_s, each from the first source that has it; the title is never null."""
    out = videos
    for i, source in enumerate(sources):
        out = out.join(source.select("video_id", *(F.col(c).alias(f"{c}_{i}") for c in ("title", "channel", "duration_s"))), "video_id", "left")
    pick = lambda c: F.coalesce(*(F.col(f"{c}_{i}") for i in range(len(sources))), F.lit(None))
    title = F.coalesce(pick("title"), F.concat(F.lit("Video "), F.col("video_id").cast("string")))
    return out.select(*videos.columns, title.alias("title"), pick("channel").cast("string").alias("channel"), pick("duration_s").cast("double").alias("duration_s"))


def located(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows of requests(locator, ...); valid ones have a video_id."""
    marked = requests.withColumn("video_id", parse_locator(F.col("locator")))
    return marked.filter("video_id IS NOT NULL"), marked.filter("video_id IS NULL").drop("video_id")
