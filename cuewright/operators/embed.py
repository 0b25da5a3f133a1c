"""Hashed embeddings: signed buckets of unigrams and bigrams, scaled to unit length; and the seam for real models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import EmbeddingProblem
from ..functions.tokens import hash_terms
from ..shipping import named, ship
from .dense import l2_normalize

DIM = 384
#: Terms of a text that reach a Python task in one row, and rows that it looks at in one step.
PIECE, ROWS = 256, 2048
#: From features and the width to the bucket and the sign of each.
Buckets = Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray]]
# What model families expect before a query and before a passage.
QUERY_PREFIX = {"bge": "Represent this sentence for searching relevant passages: ", "e5": "query: ", "gte": ""}
PASSAGE_PREFIX = {"bge": "", "e5": "passage: ", "gte": ""}


def family(model: str) -> str | None:
    return next((f for f in QUERY_PREFIX if f in model.lower()), None)


def with_prefix(text: Column, model: str, query: bool) -> Column:
    prefix = (QUERY_PREFIX if query else PASSAGE_PREFIX).get(family(model) or "", "")
    return F.concat(F.lit(prefix), text)


def model_id(embedder: str, dim: int = DIM, model: str = "", version: int = 1) -> str:
    """The key under which vectors are kept; it tells real models apart by name, and by whether they get prefixes."""
    if embedder != "model":
        return f"{embedder}-{dim}-v{version}"
    return f"model:{model}:{'prefixed' if QUERY_PREFIX.get(family(model) or '') or PASSAGE_PREFIX.get(family(model) or '') else 'plain'}-{dim}-v{version}"


def md5_buckets(feats: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each feature: the first four bytes of MD5, and the highest bit of the fifth, which is set for -1."""
    held = np.frombuffer(b"".join([hashlib.md5(f, usedforsecurity=False).digest() for f in feats]), np.uint8).reshape(-1, 16)
    return held[:, :4].copy().view(">u4").ravel().astype(np.int64) % dim, np.where(held[:, 4] >> 7, -1.0, 1.0)


def blake_buckets(feats: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each feature: eight bytes of BLAKE2b, whose highest bit is set for 1."""
    held = np.frombuffer(b"".join([hashlib.blake2b(f, digest_size=8).digest() for f in feats]), ">u8").astype(np.uint64)
    return (held % np.uint64(dim)).astype(np.int64), np.where(held >> np.uint64(63), 1.0, -1.0)


def _signs(left: np.ndarray, pieces: pa.ListArray, dim: int, buckets: Buckets) -> np.ndarray:
    """The sums of signs of each text that the pieces are of. Distinct features are hashed once."""
    terms, sizes = pieces.flatten(), np.diff(pieces.offsets.to_numpy())
    piece = np.repeat(np.arange(len(sizes)), sizes)
    own = np.ones(len(terms), bool)
    own[np.cumsum(sizes)[left] - 1] = False  # the term that the next piece begins with
    at = np.flatnonzero(piece[:-1] == piece[1:])
    pairs = pc.binary_join_element_wise(terms.take(pa.array(at)), terms.take(pa.array(at + 1)), "_")
    each = pa.concat_arrays([terms.filter(pa.array(own)), pairs]).dictionary_encode()
    _, ends, data = each.dictionary.buffers()
    edges, raw = np.frombuffer(ends, np.int32)[: len(each.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
    bucket, sign = buckets([raw[a:b] for a, b in zip(edges, edges[1:])], dim)
    which, text = each.indices.to_numpy(), np.cumsum(~left) - ~left
    place = text[np.concatenate((piece[own], piece[at]))] * dim + bucket[which]
    return np.bincount(place, sign[which], minlength=(text[-1] + 1) * dim).reshape(-1, dim).astype(np.float64)


def _folded(texts: DataFrame, dim: int, buckets: Buckets, name: str, element: T.DataType, close: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(passage_id, name) with what close makes of the sums of each text's signs.

    Terms are cut in the JVM and come in pieces of PIECE with the next piece's first term, one row after the other, so
    what a task looks at is bounded in bytes however long texts are; what a text adds up to so far passes on.
    """
    ship(texts.sparkSession)
    schema = T.StructType([T.StructField("passage_id", texts.schema["passage_id"].dataType), T.StructField(name, T.ArrayType(element))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.zeros(dim)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                left = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                sums = _signs(left, batch.column(2), dim, buckets)
                sums[0] += open_
                open_, done = (sums[-1], sums[:-1]) if left[-1] else (np.zeros(dim), sums)
                ids = batch.column(0).filter(pa.array(~left))
                flat = pa.array(close(done).ravel(), arrow.field(1).type.value_type)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(done) + 1, dtype=np.int32) * dim), flat)], names=["passage_id", name])

    # Columns of their own, and no plain explode: either would have the optimizer cut every text into terms several times.
    cut = texts.select("passage_id", hash_terms(F.col("text")).alias("t"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - 1, F.lit(0)), F.lit(PIECE))
    each = F.transform(starts, lambda i: F.struct((F.size("t") - i > PIECE).alias("left"), F.slice("t", i + 1, PIECE + 1).alias("piece")))
    return cut.select("passage_id", F.explode_outer(each).alias("p")).select("passage_id", "p.left", "p.piece").mapInArrow(run, schema)


def hash_embed_md5(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """(passage_id, vector) with buckets from MD5, in doubles; rows of one id are one text's."""
    parts = _folded(texts, dim, md5_buckets, "sums", T.IntegerType(), lambda sums: sums.astype(np.int32))
    lists = parts.groupBy("passage_id").agg(F.collect_list("sums").alias("lists"))
    added = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(1))), F.element_at("lists", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    whole = lists.select("passage_id", F.when(F.size("lists") == 1, F.element_at("lists", 1)).otherwise(added).alias("sums"))
    return whole.select("passage_id", l2_normalize(F.col("sums")).alias("vector"))


def hash_embed(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """(passage_id, vector) with buckets from BLAKE2b, in floats."""

    def unit(sums: np.ndarray) -> np.ndarray:
        x = sums.astype(np.float32)
        norms = np.array([np.linalg.norm(row) for row in x], np.float32).reshape(-1, 1)
        return x / np.where(norms > 0, norms, np.float32(1))

    return _folded(texts, dim, blake_buckets, "vector", T.FloatType(), unit)


def model_embed(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """(passage_id, vector) of any model: load() runs once in each task and gives the function from texts to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                x = np.asarray(encode([t or "" for t in part.column(1).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["passage_id", "vector"])

    ship(texts.sparkSession)
    return texts.select("passage_id", "text").mapInArrow(run, T.StructType([T.StructField("passage_id", texts.schema["passage_id"].dataType), T.StructField("vector", T.ArrayType(T.FloatType()))]))


def embed(texts: DataFrame, embedder: str, dim: int = DIM, model: str = "", load: str = "", query: bool = False) -> DataFrame:
    """(passage_id, vector) of texts(passage_id, text) by the embedder's name: hashing, hashing-md5 or model.

    model is the real model's name, which decides the prefix of queries and passages; load names the function that
    makes it in each task. Vectors of a real model are scaled to unit length.
    """
    if embedder == "hashing":
        return hash_embed(texts, dim)
    if embedder == "hashing-md5":
        return hash_embed_md5(texts, dim)
    if embedder != "model":
        raise EmbeddingProblem(f"unknown embedder: {embedder}")
    if not load or not model:
        raise EmbeddingProblem("the embedder `model` needs a model's name and its loader")
    told = model_embed(texts.withColumn("text", with_prefix(F.coalesce("text", F.lit("")), model, query)), named(load))
    return told.select("passage_id", l2_normalize(F.col("vector")).alias("vector"))
