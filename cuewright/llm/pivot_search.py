"""Exact inner-product top-k: a table of distances to pivots bounds every score, and candidates are evaluated in the order of their bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, prepare

#: Pivots, and the vectors from which they are chosen and with which every query starts; neither changes a result.
PIVOTS, SAMPLE = 32, 4096
#: Query vectors that tasks hold at once; a larger query set is answered in several passes.
BLOCK_BYTES = 16 << 20
#: Candidates of a batch that each query evaluates first, next, and then all that are left.
WAVES = (32, 256)
#: Numbers in one step of a task.
CELLS = 1 << 20
#: Squared lengths up to here add up exactly in doubles; longer vectors have no bounds and are multiplied as whole numbers.
EXACT = 1 << 50
LONG = (1 << 63) - 1


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): each component x as floor(scale * x). Null vectors, null or non-finite components and null ids take no part.

    What lies beyond a long is held at its ends.
    """
    wide = F.transform(vector_col, lambda x: F.lit(scale) * x.cast("double"))
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.transform(wide, lambda x: F.floor(x)).alias("v"))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of longs; a shorter one ends in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def squares(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(axis=1)


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows of whole numbers; under the root all is exact."""
    a, b = x.astype(np.float64), to.astype(np.float64)
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)))


def products(asked: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as longs: in doubles where these are exact, else in whole numbers of any size, held at the ends of a long."""
    if squares(asked).max(initial=0) <= EXACT and squares(x).max(initial=0) <= EXACT:
        return (asked.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(asked.astype(object) @ x.astype(object).T, -LONG - 1, LONG).astype(np.int64)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before; equal vectors give one pivot."""
    sample = np.unique(sample[squares(sample) <= EXACT], axis=0)
    if not len(sample):
        return sample
    chosen, near = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def pivot_table(whole: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """(id, v, far, cell) in the shared folder: whole parts of the distances to all pivots, and the nearest one.

    Rows lie in order of cell and distance, in partitions cut by id as well, so one vector that very many rows have is
    no hot partition. far is null for vectors too long for exact bounds.
    """
    prepare(whole)
    shared = whole.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), width)
            far, plain = np.zeros((len(x), len(shared.value)), np.int64), squares(x) <= EXACT
            if len(shared.value):
                far[plain] = np.floor(distances(x[plain], shared.value))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel()), mask=pa.array(~plain))
            cell = np.where(plain, far.argmin(axis=1), -1) if far.shape[1] else np.full(len(x), -1)
            depth = far[np.arange(len(x)), np.maximum(cell, 0)] if far.shape[1] else cell
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(cell.astype(np.int32)), pa.array(depth.astype(np.int64))], names=["id", "v", "far", "cell", "depth"])

    table = whole.mapInArrow(measure, "id long, v array<long>, far array<long>, cell int, depth long")
    parts = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(table.repartitionByRange(parts, "cell", "depth", "id").sortWithinPartitions("cell", "depth"), "pivots")


class Best:
    """The best k of each query so far, by score and then the smaller id; nothing below its floor comes in."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.scores, self.ids = np.full((len(floor), k), -LONG - 1), np.full((len(floor), k), LONG)
        self.full = np.zeros(len(floor), np.int64)

    def take(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, good: np.ndarray) -> None:
        """scores, ids and good: a row for each of `who`, which are unlike."""
        row, at = np.nonzero(good & (scores >= self.floor[who, None]))
        if not len(row):
            return
        touched = np.unique(who[row])
        held, place = np.nonzero(np.arange(self.k)[None] < self.full[touched, None])
        query = np.concatenate([who[row], touched[held]])
        score = np.concatenate([scores[row, at], self.scores[touched[held], place]])
        name = np.concatenate([ids[row, at], self.ids[touched[held], place]])
        order = np.lexsort((name, ~score, query))  # ~score falls as score rises, and never overflows
        query, score, name = query[order], score[order], name[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = rank < self.k
        self.scores[query[keep], rank[keep]], self.ids[query[keep], rank[keep]] = score[keep], name[keep]
        self.full[touched] = np.minimum(self.k, np.diff(np.append(first, len(query))))
        done = touched[self.full[touched] == self.k]
        self.floor[done] = np.maximum(self.floor[done], self.scores[done, -1])


class Block:
    """Some queries with their distances to the pivots, and the floors that the sample gives them."""

    def __init__(self, ids: np.ndarray, asked: np.ndarray, pivots: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int):
        self.ids, self.asked, self.k = ids, asked, k
        self.squares, self.plain = squares(asked), squares(asked) <= EXACT
        self.far = np.zeros((len(asked), len(pivots)))
        if len(pivots):
            self.far[self.plain] = distances(asked[self.plain], pivots)
        best = Best(np.full(len(ids), -LONG - 1), k)
        for at in range(0, len(ids), max(1, CELLS // max(1, len(sample_ids)))):
            who = np.arange(at, min(len(ids), at + max(1, CELLS // max(1, len(sample_ids)))))
            if len(sample_ids):
                best.take(who, products(asked[who], sample), np.broadcast_to(sample_ids, (len(who), len(sample_ids))), sample_ids[None] != ids[who, None])
        self.floor = best.floor

    def gap(self, who: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The largest lower bound that any pivot gives, of the distance from each query to each row of intervals."""
        out = np.zeros((len(who), len(low)))
        for p in range(low.shape[1]):
            d = self.far[who, p, None]
            np.maximum(out, low[None, :, p] - d, out=out)
            np.maximum(out, d - high[None, :, p], out=out)
        return out

    def search(self, batch_ids: np.ndarray, x: np.ndarray, far: np.ndarray, best: Best) -> None:
        """Hold a batch of vectors, all with bounds, against every query that has some."""
        length = squares(x)
        ceiling = lambda gap, longest, who: (self.squares[who, None] + longest - np.maximum(0, gap - 1e-6) ** 2) / 2
        all_plain = np.flatnonzero(self.plain)
        whole = ceiling(self.gap(all_plain, far.min(0)[None], far.max(0)[None] + 1.0), length.max(), all_plain)[:, 0]
        open_ = all_plain[whole >= best.floor[all_plain]]
        step = max(1, CELLS // len(x))
        for at in range(0, len(open_), step):
            who = open_[at : at + step]
            bound = ceiling(self.gap(who, far, far + 1.0), length[None], who)
            bound[batch_ids[None] == self.ids[who, None]] = -np.inf
            edges = [w for w in WAVES if w < len(x)]
            order = np.argpartition(-bound, edges, axis=1) if edges else np.broadcast_to(np.arange(len(x)), bound.shape)
            for low, high in zip([0, *edges], [*edges, len(x)]):
                pick = order[:, low:high]
                near = np.take_along_axis(bound, pick, 1)
                left = (near >= best.floor[who, None]).any(axis=1)  # waves go down in their bounds: a query without any left has stopped
                who, order, bound, pick, near = who[left], order[left], bound[left], pick[left], near[left]
                if not len(who):
                    break
                # One product for all queries of the wave; it is cheaper than gathering each query's own candidates.
                used = np.unique(pick[near >= best.floor[who, None]])
                score = np.full((len(who), len(x)), -LONG - 1)
                score[:, used] = products(self.asked[who], x[used])
                best.take(who, np.take_along_axis(score, pick, 1), batch_ids[pick], near >= best.floor[who, None])

    def search_all(self, batch_ids: np.ndarray, x: np.ndarray, who: np.ndarray, best: Best) -> None:
        """Without bounds, for vectors or queries that are too long for them."""
        step = max(1, CELLS // max(1, len(x)))
        for at in range(0, len(who), step):
            some = who[at : at + step]
            best.take(some, products(self.asked[some], x), np.broadcast_to(batch_ids, (len(some), len(x))), batch_ids[None] != self.ids[some, None])


def _one_pass(table: DataFrame, block: Block, width: int) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best, everyone, long = Best(own.floor, own.k), np.arange(len(own.ids)), np.flatnonzero(~own.plain)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), rows_of(batch.column(1), width)
            plain = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            if (~plain).any():
                own.search_all(ids[~plain], x[~plain], everyone, best)
            if plain.any():
                far = rows_of(batch.column(2).filter(pa.array(plain)), own.far.shape[1])
                own.search(ids[plain], x[plain], far, best)
                own.search_all(ids[plain], x[plain], long, best)
        rows, at = np.nonzero(np.arange(own.k)[None] < best.full[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(own.ids[rows]), pa.array(best.ids[rows, at]), pa.array(best.scores[rows, at])], names=["query_id", "vec_id", "score"])

    return table.select("id", "v", "far").mapInArrow(search, "query_id long, vec_id long, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    line = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest inner product with each query, all if there are fewer.

    Components are taken as floor(scale * x). Rows without an id, null vectors and vectors with a null or non-finite
    component take no part, neither as queries nor as hits; rows with the query's own id are never its hits. Missing
    components of shorter vectors count as zero. Repeated rows are hits of their own; a query id that several rows have
    is asked once, with the smallest vector. Ties go to the smaller id. Empty tables give no rows.

    The pivots come from a bounded sample (SAMPLE vectors, by a hash of the id), every vector is in the table. A score
    is at most (|q|^2 + |x|^2 - gap^2) / 2, where gap is the largest difference of the two distances to one pivot. The
    k-th best score in the sample is a query's first floor; whole batches, and then waves of candidates in the order
    of their bounds, are left out once their bound is below the floor, which rises with every wave.
    Queries come in blocks of block_bytes; each block is broadcast, is one pass over the table, and of several blocks
    each is written to the shared folder before the next is read.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = quantise(vectors, id_col, vector_col, scale)
    asked = quantise(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    width = whole.agg(F.max(F.size("v"))).first()[0]
    if k <= 0 or width is None:
        return none
    width = max(width, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    some = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    full = lambda lists: np.array([[*map(int, v), *[0] * (width - len(v))] for v in lists], np.int64).reshape(len(lists), width)
    sample_ids, sample = np.array([r.id for r in some], np.int64), full([r.v for r in some])
    chosen = choose_pivots(sample, pivots)
    table = pivot_table(whole, chosen, width)
    hits, ids, block = [], [], []

    def ask() -> DataFrame:
        return _ranked(_one_pass(table, Block(np.array(ids, np.int64), full(block), chosen, sample_ids, sample, k), width), k)

    for row in asked.toLocalIterator():
        if 8 * (width + len(chosen)) * len(ids) >= block_bytes:
            hits.append(materialize(ask(), "hits"))
            ids, block = [], []
        ids.append(row[0])
        block.append(row[1])
    if ids:
        hits.append(materialize(ask(), "hits"))
    discard(table)
    return reduce(DataFrame.union, hits, none)
