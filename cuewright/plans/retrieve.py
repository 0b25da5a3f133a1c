"""Retrievers by name, over the passages and vectors of an index, for many questions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RetrievalProblem
from ..operators import dense, fusion, lexical, rerank
from ..shared import materialize
from ..sources.settings import Settings

RETRIEVERS = ("dense", "sparse", "hybrid")
HITS = ("query_id", "passage_id", "score", "rank", "confidence")


def retrieve(name: str, passages: DataFrame, questions: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None) -> DataFrame:
    """Hits of questions(query_id, text) among passages(scope, passage_id, text); vectors(passage_id, vector) for dense and hybrid.

    Blank questions have no hits. Passages are those of one scope. With settings.rerank the best candidates are
    ranked anew.
    """
    return retrieve_each((name,), passages, questions, settings, vectors)[name]


def asked_vectors(questions: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, vector) of questions that are not blank, written once."""
    asked = questions.filter(F.trim("text") != "").select(F.col("query_id").alias("passage_id"), "text")
    return materialize(settings.embed(asked, query=True).withColumnRenamed("passage_id", "query_id"))


def retrieve_each(names: tuple[str, ...], passages: DataFrame, questions: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None, asked_with: DataFrame | None = None) -> dict[str, DataFrame]:
    """Hits of each retriever, as `retrieve` has them. What several of them need is searched for once, as deep as any of them looks.

    asked_with: asked_vectors of the questions, where they are known.
    """
    for name in names:
        if name not in RETRIEVERS:
            raise RetrievalProblem(f"unknown retriever: {name}")
        if name != "sparse" and vectors is None:
            raise RetrievalProblem(f"{name} needs vectors")
    asked = questions.filter(F.trim("text") != "").select("query_id", "text")
    k = settings.top_k
    depth = max(settings.rerank_candidates, k) if settings.rerank else k
    pool = max(settings.candidate_k, depth)
    sides, deep = {}, pool if "hybrid" in names else depth
    if {"dense", "hybrid"} & set(names):
        own = asked_vectors(questions, settings) if asked_with is None else asked_with
        sides["dense"] = dense.retrieve(vectors, own, deep).join(passages.select("passage_id"), "passage_id", "left_semi")
    if {"sparse", "hybrid"} & set(names):
        sides["sparse"] = lexical.retrieve(passages, asked, deep, settings.bm25_k1, settings.bm25_b)
    if len(names) > 1:
        sides = {n: materialize(x) for n, x in sides.items()}
    out = {}
    for name in names:
        hits = fusion.fuse(sides["dense"], sides["sparse"], depth, settings.fusion, settings.rrf_k, settings.alpha) if name == "hybrid" else sides[name].filter(F.col("rank") < depth)
        if settings.rerank:
            hits = rerank.rerank(hits, asked, passages, k, settings.rerank_candidates)
        out[name] = hits.select(*HITS)
    return out


def compare(passages: DataFrame, questions: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None, names: tuple[str, ...] = RETRIEVERS) -> DataFrame:
    """Hits of several retrievers side by side, with the retriever's name."""
    each = retrieve_each(tuple(names), passages, questions, settings, vectors)
    return reduce(DataFrame.unionByName, (each[n].withColumn("retriever", F.lit(n)) for n in names))
