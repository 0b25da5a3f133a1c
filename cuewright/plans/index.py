"""Indexing many videos at once in stages, each of which does only what its key in the cache lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cues import clean_transcript, normalise_rows
from ..operators.passages import passages_of
from ..shared import materialize
from ..sources.settings import Settings
from ..sources.store import Store


def ensure_indexed(store: Store, videos: DataFrame, rows: DataFrame, settings: Settings = Settings(), force: bool = False) -> dict[str, int]:
    """Transcripts, passages and vectors for videos(video_id, title, channel, duration_s, language, transcript_kind).

    rows are raw captions (video_id, idx, start_s, duration_s, text). Known transcripts are not cleaned again,
    passages only made for a new (video, packing) and vectors for a new (passages, model). force forgets the
    videos first. Returns how many videos each stage worked on.
    """
    if force:
        store.clear(videos)
    new = videos.join(store.read("videos").select("video_id"), "video_id", "left_anti")
    did = {"transcripts": new.count()}
    if did["transcripts"]:
        store.save_videos(new, materialize(clean_transcript(normalise_rows(rows.join(new.select("video_id"), "video_id", "left_semi")))))
    fingerprint, wanted = settings.packing.fingerprint(), videos.select("video_id")
    sets = store.read("chunk_sets").filter(F.col("fingerprint") == fingerprint)
    bare = wanted.join(sets, "video_id", "left_anti")
    did["passages"] = bare.count()
    if did["passages"]:
        store.save_chunks(materialize(passages_of(store.read("segments").join(bare, "video_id", "left_semi"), settings.packing)), fingerprint, bare)
    model = settings.model_id
    chunks = store.chunks(fingerprint).join(wanted, "video_id", "left_semi")
    blank = chunks.select("video_id", "chunk_set_id").distinct().join(store.read("embedding_sets").filter(F.col("model_id") == model), ["video_id", "chunk_set_id"], "left_anti")
    did["vectors"] = blank.count()
    if did["vectors"]:
        todo = chunks.join(blank, ["video_id", "chunk_set_id"], "left_semi")
        vectors = settings.embed(todo.select(F.col("chunk_id").alias("passage_id"), "text")).select(F.col("passage_id").alias("chunk_id"), F.col("vector").cast("array<float>").alias("vector"))
        store.save_embeddings(materialize(todo.select("video_id", "chunk_set_id", "chunk_id").join(vectors, "chunk_id")), model, settings.dim)
    return did
