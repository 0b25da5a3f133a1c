"""Dense retrieval: exact cosine top-k of a stated query set against all vectors, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine_confidence
from ..shared import materialize
from ..shipping import ship
from .lexical import DIGITS, ranked  # noqa: F401
from .tops import Best

#: Query vectors that tasks hold at once (as float64); a larger query set is answered in several passes.
BLOCK_BYTES = 16 << 20
#: Scores that a task computes in one step, whatever the number of queries.
CELLS = 1 << 20


def l2_normalize(vector: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    # An outer expression within a lambda is computed again for every element; an array of it is computed once.
    lengths = F.array_repeat(F.when(norm > 0, norm).otherwise(1.0), F.size(vector))
    return F.zip_with(vector, lengths, lambda x, n: x.cast("double") / n)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which rows of the batch have one; another width is an error."""
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    sizes = np.diff(column.offsets.to_numpy())[there]
    if (sizes != dim).any():
        raise ValueError(f"vectors have {sorted(set(sizes.tolist()))} numbers, queries have {dim}")
    flat = column.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(there), dim), there


def _one_pass(vectors: DataFrame, ids: list[int], block: np.ndarray, k: int) -> DataFrame:
    ship(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, _unit_rows(block)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        held = Best(len(names), k)
        for batch in batches:
            x, there = _matrix(batch.column(1), asked.shape[1])
            if not len(x):
                continue
            every = batch.column(0).to_numpy(zero_copy_only=False)[there]
            line = np.argsort(every, kind="stable")
            every, unit, step = every[line], _unit_rows(x[line]).T, max(1, CELLS // len(x))
            for at in range(0, len(names), step):
                held.offer(at, asked[at : at + step] @ unit, every)
        rows, own, near = held.hits()
        yield pa.RecordBatch.from_arrays([pa.array(np.array(names)[rows]), pa.array(own), pa.array(near)], names=["query_id", "passage_id", "score"])

    return vectors.select("passage_id", "vector").mapInArrow(best, "query_id long, passage_id long, score double")


def retrieve(vectors: DataFrame, queries: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, passage_id, score, rank, confidence) of the k nearest vectors of each query, negative ones too.

    vectors(passage_id, vector), queries(query_id, vector). A task keeps its best k for each query over all its
    batches, so what is shuffled grows with tasks and queries. Queries of up to block_bytes take one lazy pass; of
    a larger set each pass is run and written to the shared folder before the next block is read, so neither the
    driver nor a task ever holds more than a block. Null vectors are never hits; without queries or with k of 0 or
    less there are none.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, passage_id long, score double")
    hits, ids, block, held = [], [], [], 0
    if k > 0:
        for row in queries.filter(F.col("vector").isNotNull()).select("query_id", "vector").toLocalIterator():
            if held >= block_bytes:
                hits.append(materialize(ranked(_one_pass(vectors, ids, np.array(block), k), k, per=("query_id",)).drop("rank")))
                ids, block, held = [], [], 0
            ids.append(row[0])
            block.append(np.array(row[1], np.float64))
            held += 8 * len(block[-1])
        if ids:
            hits.append(_one_pass(vectors, ids, np.array(block), k))
    return ranked(reduce(DataFrame.union, hits, none), k, per=("query_id",)).withColumn("confidence", cosine_confidence(F.col("score")))
