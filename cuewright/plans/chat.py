"""A conversation about one video: rewrite, search, answer, remember."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import RetrievalProblem
from ..operators import answers as ans
from ..shared import materialize
from ..sources.settings import Settings
from ..sources.store import Store
from .retrieve import RETRIEVERS, compare, retrieve


class ChatSession:
    """Asks one question at a time; each is a small batch of the same operators that answer many."""

    def __init__(self, store: Store, video_id: str, load: Callable[[], ans.Model], settings: Settings = Settings()) -> None:
        self.store, self.video_id, self.load, self.settings = store, video_id, load, settings
        self.told: dict | None = None
        self.begin()

    def begin(self) -> None:
        """Start anew: what was said so far stays in the cache, and is not looked at any more."""
        self.conversation_id = uuid.uuid4().hex
        self.store.append("conversations", self.store.spark.createDataFrame([(self.video_id, self.conversation_id)], "video_id string, conversation_id string"))

    def use(self, retriever: str) -> None:
        if retriever not in RETRIEVERS:
            raise RetrievalProblem(f"unknown retriever: {retriever}")
        self.settings = replace(self.settings, retriever=retriever)

    def history(self):
        turns = self.store.table("messages", [self.video_id]).filter(F.col("conversation_id") == self.conversation_id)
        return turns.select("conversation_id", F.col("message_id").alias("turn"), "role", F.col("content").alias("text"))

    def ask(self, question: str) -> dict:
        """(text, refused, layer, citations, search_text) of the answer, after storing both turns. The prompt has the question as asked."""
        spark, s = self.store.spark, self.settings
        turns = self.history()
        asked = spark.createDataFrame([(0, self.conversation_id, question)], "question_id long, conversation_id string, text string")
        search = question
        if s.rewrite:
            search = ans.rewrite(asked, ans.history_text(turns, s.history_turns), self.load).first()["search_text"]
        chunks = self.store.chunks(s.packing.fingerprint()).filter(F.col("video_id") == self.video_id)
        passages = chunks.select(F.col("video_id").alias("scope"), F.col("chunk_id").alias("passage_id"), "text")
        vectors = self.store.embeddings(s.packing.fingerprint(), s.model_id).filter(F.col("video_id") == self.video_id).select(F.col("chunk_id").alias("passage_id"), "vector")
        hits = retrieve(s.retriever, passages, spark.createDataFrame([(0, search)], "query_id long, text string"), s, vectors)
        hits = materialize(hits)
        full = hits.withColumnRenamed("query_id", "question_id").join(chunks.select(F.col("chunk_id").alias("passage_id"), "video_id", "start_s", "end_s", "text"), "passage_id")
        told, citations, _ = ans.answer(asked.select("question_id", "text"), full, self.load, s.min_score, s.require_citations, s.max_context_chars)
        row, cited = told.first(), [r.asDict() for r in citations.orderBy("place").collect()]
        n = turns.count()
        as_json = F.to_json(F.array(*(F.struct(F.lit(c["marker"]).alias("marker"), F.lit(c["url"]).alias("url")) for c in cited))) if cited else F.lit("[]")
        message = lambda i, role, content: spark.range(1).select(F.lit(self.video_id).alias("video_id"), F.lit(self.conversation_id).alias("conversation_id"), F.lit(n + i).cast("long").alias("message_id"), F.lit(role).alias("role"), F.lit(content).alias("content"), (as_json if i else F.lit("[]")).alias("citations"))
        self.store.append("messages", message(0, "user", question).unionByName(message(1, "assistant", row["text"])))
        best = full.agg(F.max("confidence")).first()[0]
        self.told = {"text": row["text"], "refused": row["refused"], "layer": row["layer"], "citations": cited, "search_text": search, "confidence": best}
        return self.told

    def passages(self):
        """(passages, vectors) of the video."""
        chunks = self.store.chunks(self.settings.packing.fingerprint()).filter(F.col("video_id") == self.video_id)
        vectors = self.store.embeddings(self.settings.packing.fingerprint(), self.settings.model_id).filter(F.col("video_id") == self.video_id)
        return chunks.select(F.col("video_id").alias("scope"), F.col("chunk_id").alias("passage_id"), "start_s", "text"), vectors.select(F.col("chunk_id").alias("passage_id"), "vector")

    def compare(self, question: str) -> list:
        """(retriever, rank, confidence, start_s, text) of the hits of all retrievers."""
        own, vectors = self.passages()
        hits = compare(own, self.store.spark.createDataFrame([(0, question)], "query_id long, text string"), self.settings, vectors)
        return hits.join(own.drop("scope"), "passage_id").orderBy("retriever", "rank").select("retriever", "rank", F.round("confidence", 2).alias("confidence"), "start_s", "text").collect()
