"""Caption tracks as files (WebVTT, SubRip), one to a file or packed: read whole in batches or as a stream, parsed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKS = "video_id string, language string, kind string"
_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"
#: The line with a cue's times and what else stands on it; the text is below.
_LINE = rf"(?m)^[ \t]*{_TIME}[ \t]*-->[ \t]*{_TIME}[^\n]*"
#: Video, language and kind of a file that lies in no folder of its own: VIDEO.LANGUAGE.vtt or VIDEO.LANGUAGE.KIND.srt.
_NAME = r"([^/]+?)\.([A-Za-z]{2,3}(?:-[A-Za-z0-9]+)*)(?:\.([a-z]+))?\.(?:vtt|srt)$"


def _clock(seconds: Column) -> Column:
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    part = lambda n, width: F.lpad(n.cast("string"), width, "0")
    hours = (ms / 3_600_000).cast("long")
    return F.concat(F.when(hours < 100, part(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), part((ms / 60_000).cast("long") % 60, 2), F.lit(":"), part((ms / 1000).cast("long") % 60, 2), F.lit("."), part(ms % 1000, 3))


def write_tracks(cues: DataFrame, folder: str, packed: bool = False) -> None:
    """A WebVTT document for each track of cues(video_id, language, kind, idx, start_s, end_s, text).

    Each is a file of its own in folders by video, language and kind, as players take them; the file system then makes as
    many files and folders as there are tracks, which takes most of the time. Packed, they are rows (video_id, value) of
    Parquet files in folders by language and kind, of which a task writes one for each, however many tracks it has.
    Times are kept to the millisecond; empty lines of a cue go, as they would end it. A track is gathered by its task.
    """
    below = F.concat(F.lit("\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"))
    block = F.concat(_clock(F.col("start_s")), F.lit(" --> "), _clock(F.col("end_s")), F.regexp_replace(below, r"\n\s*\n", "\n"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("idx", block.alias("block")))), lambda x: x["block"])
    whole = cues.groupBy("video_id", "language", "kind").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(line, "\n\n"), F.lit("\n")).alias("value"))
    if packed:
        whole.write.mode("append").partitionBy("language", "kind").parquet(folder)
    else:
        whole.write.mode("append").partitionBy("video_id", "language", "kind").text(folder)


def read_tracks(spark: SparkSession, folder: str, flat: bool = False, stream: bool = False, packed: bool = False) -> DataFrame:
    """(video_id, language, kind, idx, start_s, duration_s, text) of all tracks below a folder, as normalise_rows takes them.

    Files may lie as write_tracks has them, packed if they were written so, where a filter on language or kind, and on video
    if they are not packed, leaves whole folders unread, or side by side (flat) under names such as VIDEO.en.vtt (kind
    `unknown` unless named). Times may lack hours; what is no cue (headers, notes, styles, numbers) is passed over. A track
    without cues has no rows. As a stream each new file is read once.
    """
    if flat and packed:
        raise ValueError("packed tracks have their names in the file, flat ones are files")
    reader = (spark.readStream if stream else spark.read).format("parquet" if packed else "text").option("wholetext", True)
    kept = reader.schema("value string" if flat else f"value string, {TRACKS}").load(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    told = [F.nullif(F.regexp_extract(name, _NAME, i), F.lit("")) for i in (1, 2, 3)] if flat else [F.col(c) for c in ("video_id", "language", "kind")]
    tracks = kept.select(told[0].alias("video_id"), told[1].alias("language"), F.coalesce(told[2], F.lit("unknown")).alias("kind"), F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    blocks = F.filter(F.split("value", r"\n[ \t]*\n\s*"), lambda b: b.rlike(_LINE))
    # The eight numbers are taken from the line alone: looking for each in the whole block took most of a read.
    parts = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, _LINE, 0).alias("line"), F.substring(F.split(b, _LINE, 2)[1], 2, 2**31 - 1).alias("text")))
    at = lambda p, i: F.concat(F.lit("0"), F.regexp_extract(p["line"], _LINE, i)).cast("double")
    seconds = lambda p, i: at(p, i) * 3600 + at(p, i + 1) * 60 + at(p, i + 2) + at(p, i + 3) / 1000
    cues = F.transform(parts, lambda p: F.struct(seconds(p, 1).alias("s"), seconds(p, 5).alias("e"), p["text"].alias("text")))
    each = tracks.select("video_id", "language", "kind", F.posexplode(cues).alias("idx", "c"))
    return each.select("video_id", "language", "kind", "idx", F.col("c.s").alias("start_s"), F.round(F.col("c.e") - F.col("c.s"), 3).alias("duration_s"), "c.text")
