"""The cache: tables of videos, cues, passages, vectors and conversations, kept as snapshots.

What belongs together is replaced together: a reader sees all tables before a change or all after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CacheProblem
from .snapshots import Change, Snapshots, Version

VERSION = 2
#: Parts of each table of a new cache; a replacement rewrites the parts of its videos only.
PARTS = 32
SCHEMAS = {
    "videos": "video_id string, title string, channel string, duration_s double, language string, transcript_kind string, n_segments int, fetched_at timestamp",
    "segments": "video_id string, idx int, start_s double, end_s double, text string",
    "chunk_sets": "video_id string, chunk_set_id long, fingerprint string, n_chunks int",
    "chunks": "video_id string, chunk_set_id long, chunk_id long, idx int, text string, start_s double, end_s double, seg_start int, seg_end int, n_chars int",
    "embedding_sets": "video_id string, chunk_set_id long, embedding_set_id long, model_id string, dim int",
    "embeddings": "video_id string, embedding_set_id long, chunk_id long, vector array<float>",
    "conversations": "video_id string, conversation_id string",
    "messages": "video_id string, conversation_id string, message_id long, role string, content string, citations string",
}


class Store(Snapshots):
    """Tables of SCHEMAS below a folder. Each is keyed by video; everything of a video can be replaced or deleted at once."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS) -> None:
        super().__init__(spark, folder, {name: (schema, "video_id") for name, schema in SCHEMAS.items()}, parts)
        path = f"{folder}/_version"
        if self._names(path):
            held, self.parts = spark.read.parquet(path).select("version", "parts").first()
            if held != VERSION:
                raise CacheProblem(f"the cache has version {held}; this code needs {VERSION}")
        else:
            spark.createDataFrame([(VERSION, parts)], "version int, parts int").write.parquet(path)

    def table(self, name: str, videos: list[str] | None = None, at: Version | None = None) -> DataFrame:
        """A table as of a version; with a few videos named, only their parts are listed and read."""
        if videos is None:
            return self.read(name, at)
        wanted = self.parts_of(name, self.spark.createDataFrame([(v,) for v in videos], "video_id string"))
        return self.read(name, at, wanted).filter(F.col("video_id").isin(videos))

    def append(self, name: str, rows: DataFrame) -> None:
        self.commit(lambda change: change.append(name, rows))

    def replace(self, name: str, rows: DataFrame, keys: DataFrame, on: list[str]) -> None:
        """Put rows in the place of all rows whose `on` columns are among keys; repeated calls with the same rows change nothing."""
        self.commit(lambda change: change.replace(name, rows, keys, on))

    def transcript(self, videos: list[str] | None = None) -> DataFrame:
        """Cached cues (video_id, language, transcript_kind, idx, start_s, duration_s, text) in order of idx within a video; an unknown language is `en`."""
        at = self.version()
        held = self.table("videos", videos, at).select("video_id", F.coalesce("language", F.lit("en")).alias("language"), "transcript_kind")
        cues = self.table("segments", videos, at).join(held, "video_id")
        rows = cues.select("video_id", "language", "transcript_kind", "idx", "start_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "text")
        return rows.repartition("video_id").sortWithinPartitions("video_id", "idx")

    def save_videos(self, videos: DataFrame, segments: DataFrame) -> None:
        """Upsert videos and all their segments; language and kind are the transcript's, a missing duration is that of the last segment."""
        last = segments.groupBy("video_id").agg(F.max_by("end_s", "idx").alias("_end"), F.count("*").cast("int").alias("n_segments"))
        rows = videos.drop("n_segments").join(last, "video_id", "left").withColumns({"duration_s": F.coalesce("duration_s", "_end"), "n_segments": F.coalesce("n_segments", F.lit(0)), "fetched_at": F.current_timestamp()})

        def change(c: Change) -> None:
            c.replace("segments", segments, videos, ["video_id"])
            c.replace("videos", rows, videos, ["video_id"])

        self.commit(change)

    def save_chunks(self, chunks: DataFrame, fingerprint: str, videos: DataFrame | None = None) -> None:
        """Replace the passages of videos(video_id) under one fingerprint, so a video that has none left keeps none; without
        videos, those that chunks have. Ids are hashes, so saving again gives the same."""
        set_id = F.xxhash64("video_id", F.lit(fingerprint))
        rows = chunks.withColumns({"chunk_set_id": set_id, "chunk_id": F.xxhash64("video_id", F.lit(fingerprint), "idx")})
        sets = rows.groupBy("video_id", "chunk_set_id").agg(F.count("*").cast("int").alias("n_chunks")).withColumn("fingerprint", F.lit(fingerprint))
        keys = sets if videos is None else videos.select("video_id").distinct().withColumn("chunk_set_id", set_id)

        def change(c: Change) -> None:
            c.replace("chunks", rows, keys, ["video_id", "chunk_set_id"])
            c.replace("chunk_sets", sets, keys, ["video_id", "chunk_set_id"])

        self.commit(change)

    def chunks(self, fingerprint: str, at: Version | None = None) -> DataFrame:
        at = at or self.version()
        sets = self.read("chunk_sets", at).filter(F.col("fingerprint") == fingerprint).select("video_id", "chunk_set_id")
        return self.read("chunks", at).join(sets, ["video_id", "chunk_set_id"])

    def save_embeddings(self, vectors: DataFrame, model: str, dim: int) -> None:
        """vectors(video_id, chunk_set_id, chunk_id, vector); a vector of another width fails the job."""
        checked = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} numbers")))
        rows = vectors.withColumns({"embedding_set_id": F.xxhash64("chunk_set_id", F.lit(model)), "vector": checked})
        sets = rows.select("video_id", "chunk_set_id", "embedding_set_id").distinct().withColumns({"model_id": F.lit(model), "dim": F.lit(dim)})

        def change(c: Change) -> None:
            c.replace("embeddings", rows, sets, ["video_id", "embedding_set_id"])
            c.replace("embedding_sets", sets, sets, ["video_id", "embedding_set_id"])

        self.commit(change)

    def embeddings(self, fingerprint: str, model: str) -> DataFrame:
        """Vectors of the passages of a packing with the passages; a vector of another width than its set's fails the job."""
        at = self.version()
        sets = self.read("embedding_sets", at).filter(F.col("model_id") == model).select("video_id", "chunk_set_id", "embedding_set_id", "dim")
        checked = F.when(F.size("vector") == F.col("dim"), F.col("vector")).otherwise(F.raise_error(F.lit("a cached vector has not the width of its set")))
        held = self.read("embeddings", at).join(sets, ["video_id", "embedding_set_id"]).withColumn("vector", checked).drop("dim")
        return held.join(self.chunks(fingerprint, at), ["video_id", "chunk_set_id", "chunk_id"])

    def clear(self, videos: DataFrame) -> None:
        """Delete videos(video_id) with everything that depends on them."""

        def change(c: Change) -> None:
            for name in SCHEMAS:
                if c.base.of(name):
                    c.replace(name, self.spark.createDataFrame([], SCHEMAS[name]), videos, ["video_id"])

        self.commit(change)

    def stats(self) -> DataFrame:
        """(table_name, n) of all tables."""
        at = self.version()
        return reduce(DataFrame.union, (self.read(t, at).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in SCHEMAS))
