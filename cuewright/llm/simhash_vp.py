"""SimHash near-duplicates found through vantage-point trees.

Fingerprints are 64 bits from word shingles. The bits are cut into blocks; two fingerprints within `radius` bits of
each other lie within radius // blocks of each other in some block. Each block has a vantage-point tree: a node
holds a vantage point and the median Hamming distance to it. A fingerprint lives in the one leaf that it falls into
and visits every leaf that the triangle bound cannot exclude, so it meets the close ones beyond a boundary in
their own leaf. Exact distances over all 64 bits are then taken between a leaf's own fingerprints and its visitors.

BLOCKS = 3 leaves a distance of 1 within a block of 21 bits. One tree over all 64 bits is blocks=1; distances between
random 64-bit strings lie so close together that it visits nearly all leaves. With more blocks than radius bits,
each tree stands over all blocks but `radius` of them, on which some pair of leaves agrees fully; then nothing has
to be visited but the own leaf. README.md has figures for all three.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, materialize, prepare
from .components import connected_components

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Blocks of the bits; a tree stands over each.
BLOCKS = 3
#: Fingerprints that one leaf should hold, and that one side of a tile may hold.
SHARD, TILE = 1000, 2048
#: Fingerprints from which trees are built, and their greatest depth: both bound what the driver sends out.
SAMPLE, DEPTH = 32768, 13


def simhash(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one whole text; no words: 0; fewer words than width: the whole sequence is one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    pick = xxhash.xxh64_intdigest
    hashes = np.array([pick(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", width: int = SHINGLE_WORDS, out: str = "fp") -> DataFrame:
    """df with the fingerprint of each whole text as a long (null and wordless texts: 0)."""

    def setup():
        return lambda texts: [pa.array(np.array([simhash(t, width) for t in texts], np.uint64).view(np.int64))]

    return append_columns(df, text_col, [T.StructField(out, T.LongType())], setup)


def projections(blocks: int, radius: int) -> tuple[list[int], int]:
    """Masks of the projections, and the distance that some projection of each close pair keeps below."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    if blocks <= radius:
        return masks, radius // blocks
    return [sum(c) for c in combinations(masks, blocks - radius)], 0


class VantageTree:
    """A complete binary tree of vantage points over one projection, built from a sample."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int):
        self.mask, self.depth = np.uint64(mask), depth
        self.vantage = np.zeros(1 << depth, np.uint64)
        self.median = np.full(1 << depth, 32, np.int16)
        held = {1: sample & self.mask}
        for node in range(1, 1 << depth):
            points = held.pop(node)
            best = None
            for v in points[:: max(1, len(points) // 5)][:5]:
                d = np.bitwise_count(points ^ v)
                m = int(np.median(d))
                for cut in (m - 1, m):
                    inside = int((d <= cut).sum())
                    if best is None or abs(2 * inside - len(points)) < best[0]:
                        best = abs(2 * inside - len(points)), v, cut
            if best:
                self.vantage[node], self.median[node] = best[1], best[2]
            d = np.bitwise_count(points ^ self.vantage[node])
            held[2 * node], held[2 * node + 1] = points[d <= self.median[node]], points[d > self.median[node]]

    def shards(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of points and the leaves in which points within radius of them can lie; radius 0 gives each its own leaf."""
        rows, nodes = np.arange(len(points)), np.ones(len(points), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count((points[rows] & self.mask) ^ self.vantage[nodes]).astype(np.int16)
            inner, outer = d - radius <= self.median[nodes], d + radius > self.median[nodes]
            rows, nodes = np.concatenate((rows[inner], rows[outer])), np.concatenate((2 * nodes[inner], 2 * nodes[outer] + 1))
        return rows, nodes - (1 << self.depth)


def close_roots(own: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Points linked to others here, and the smallest point of their local component (spanning links, not all pairs)."""
    own, visitors = np.unique(own), np.unique(visitors)
    near = np.zeros((len(own), len(visitors)), bool)
    for at in range(0, len(own), 512):
        near[at : at + 512] = np.bitwise_count(own[at : at + 512, None] ^ visitors) <= radius
    points, place = np.unique(np.concatenate((own, visitors)), return_inverse=True)
    i, j = np.nonzero(near & (own[:, None] != visitors))
    rows, columns = np.unique(i), np.unique(j)
    near = near[np.ix_(rows, columns)]
    a, b = place[: len(own)][rows], place[len(own) :][columns]
    roots, worst = np.arange(len(points)), len(points)
    while len(rows):
        before = roots.copy()
        np.minimum.at(roots, a, np.where(near, roots[b], worst).min(axis=1))
        np.minimum.at(roots, b, np.where(near, roots[a][:, None], worst).min(axis=0))
        roots = roots[roots]
        if (roots == before).all():
            break
    other = roots != np.arange(len(points))
    return points[other], points[roots[other]]


def links(distinct: DataFrame, n: int, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Spanning links (a, b) between the n distinct fingerprints fp that lie within radius of each other."""
    prepare(distinct)
    masks, inner = projections(blocks, radius)
    depth = max(0, min(DEPTH, math.ceil(math.log2(max(1, n / SHARD)))))
    fine = 1 if inner else max(1, round(n / SHARD / (1 << depth)))  # only equal projections meet at distance zero
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [VantageTree(sample, m, depth) for m in masks]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, tree in enumerate(trees):
                for own, reach in ((True, 0), (False, inner)):
                    rows, leaves = tree.shards(fp, reach)
                    key = (k << depth) + leaves
                    if fine > 1:
                        mixed = (fp[rows] & tree.mask) * np.uint64(0x9E3779B97F4A7C15)
                        key = key * fine + ((mixed >> np.uint64(32)) % np.uint64(fine)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(rows), own)), pa.array(fp[rows].view(np.int64))], names=["shard", "own", "fp"])

    placed = distinct.select("fp").mapInArrow(shard, "shard long, own boolean, fp long")
    parts = lambda own: F.ceil(F.count_if(F.col("own") == own) / F.lit(TILE)).cast("int")
    tiles = placed.groupBy("shard").agg(parts(True).alias("rows"), parts(False).alias("columns"))
    # A leaf with too many fingerprints becomes a rectangle of tiles: its own stand along one side, visitors along the other.
    side = lambda n: F.pmod(F.xxhash64("fp"), F.greatest(F.col(n), F.lit(1))).cast("int")
    across = F.when(F.col("own"), F.greatest("columns", F.lit(1))).otherwise(F.greatest("rows", F.lit(1)))
    tiled = placed.join(tiles, "shard").select("shard", "own", "fp", F.when(F.col("own"), side("rows")).otherwise(side("columns")).alias("place"), F.explode(F.sequence(F.lit(0), across - 1)).alias("over"))
    tiled = tiled.select("shard", F.when(F.col("own"), F.col("place")).otherwise(F.col("over")).alias("i"), F.when(F.col("own"), F.col("over")).otherwise(F.col("place")).alias("j"), "own", "fp")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, own = group["fp"].to_numpy(np.int64).view(np.uint64), group["own"].to_numpy(bool)
        a, b = close_roots(fp[own], fp[~own], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return tiled.groupBy("shard", "i", "j").applyInPandas(compare, "a long, b long")


def _grouped(df: DataFrame, id_col: str, text_col: str, radius: int, width: int, blocks: int, *more: Column) -> DataFrame:
    """(id, fp, *more, root, component) for each row; root is the component's smallest fingerprint."""
    prints = fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more), "text", width).drop("text")
    prints = materialize(prints, "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(links(distinct, distinct.count(), radius, blocks))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "root", "component")
    return prints.join(named, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE_WORDS, blocks: int = BLOCKS) -> DataFrame:
    """(id_col, fp, component): component is the smallest id that can be reached over links of at most radius bits.

    One row per input row. Null texts count as empty and empty texts have fingerprint 0, which links like any
    other. Repeated ids are kept as they are; null ids get a component but never name one, unless all ids of a
    component are null. Other columns of df are not looked at. An empty table gives an empty result.
    """
    return _grouped(df, id_col, text_col, radius, width, blocks).select(F.col("id").alias(id_col), "fp", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE_WORDS, blocks: int = BLOCKS) -> DataFrame:
    """The rows of df without near duplicates: of each component the row of the smallest id (null ids last, then by text digest).

    All columns stay. Rows that agree in id and text are one row.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    found = _grouped(df, id_col, text_col, radius, width, blocks, digest.alias("digest"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("s"))
    own, kept_id, kept_digest = fresh(df, "own"), fresh(df, "kept_id"), fresh(df, "kept_digest")
    first = first.select(F.col("s.id").alias(kept_id), F.col("s.digest").alias(kept_digest))
    kept = df.withColumn(own, digest).join(first, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_digest)), "left_semi")
    return kept.dropDuplicates([id_col, own]).select(*df.columns)
