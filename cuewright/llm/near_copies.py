"""Near copies by word-shingle similarity: wide SimHash fingerprints gather texts, whole shingle sets link them.

Two texts are linked if the Jaccard similarity of their five-word shingles is at least LEAST. The vantage-point trees
of simhash_vp gather the closest copies, whose first 64 bits differ in a few bits. Fingerprints at LEAST, of BITS bits,
differ in about a seventh of the bits, which no tree over whole fingerprints can tell from chance (README.md has
figures). For those a tree is taken to its end: a projection of a few bits whose leaves hold equal points, and there
are enough projections for nearly every pair at LEAST to share one. Within a leaf exact distances are taken over all
bits. What either gathers makes clusters. Within a cluster every pair is then compared by its whole shingle sets, and
only those that are similar enough make links.

What a leaf or a cluster hands on are spanning links, so rows grow with texts and not with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, append_columns, discard, fresh, materialize, prepare, slices
from .components import connected_components
from .simhash_vp import links as vantage_links

WIDTH, LEAST, SEED = 5, 0.8, 42
WORDS = 4
BITS = 64 * WORDS
#: Fingerprints further apart are not gathered: three deviations above the mean at LEAST; likewise in their first 64 bits.
RADIUS, FIRST_RADIUS = 56, 21
#: Fingerprints that a leaf holds by chance, about; those that one side of a tile may hold; and texts of a cluster on one side.
LOAD, TILE, CLUSTER_TILE = 1024, 4096, 1024
#: Leaves, or clusters, that are cut into tiles: the fullest, so what is left whole has at most this share of all rows.
TILED = 1 << 16
#: Rows, and pairs of rows, that a task looks through at once; shingles of texts likewise.
CHUNK, PAIRS, SHINGLES = 1 << 16, 1 << 22, 1 << 22

_pick = np.random.default_rng(SEED)
_FACTORS, _SHIFTS = (_pick.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; no words: none; fewer words than WIDTH: the whole sequence is one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - WIDTH + 1)
    pick = xxhash.xxh64_intdigest
    return np.unique(np.array([pick(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64))


def form(text: bytes) -> int:
    """A hash of the text's words in small letters, as a signed long."""
    h = xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)
    return h - (1 << 64) if h >> 63 else h


def wide_simhash(held: np.ndarray) -> bytes:
    """BITS bits from the hashes of distinct shingles: each is set if it is in over half of their mixes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(held), 255 * 64):
        x = held[at : at + 255 * 64, None] * _FACTORS + _SHIFTS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # as many rows as a byte can count
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(held)).tobytes()


def projections(n: int) -> np.ndarray:
    """Bits of each projection for n fingerprints: a row of places each.

    A projection has the bits that leave LOAD fingerprints of n to a leaf; pairs at LEAST agree in one bit with
    chance p, so 5 / p^bits projections miss seven in a thousand of them, and fewer of closer ones.
    """
    bits = min(40, max(8, math.ceil(math.log2(max(1, n / LOAD)))))
    agree = 1 - math.acos(2 * LEAST / (1 + LEAST)) / math.pi
    count = math.ceil(5 / agree**bits)
    pick = np.random.default_rng(SEED)
    return np.stack([pick.choice(BITS, bits, replace=False) for _ in range(count)])


class Tiles:
    """How full groups are cut: a group of n rows has ceil(n / side) parts, and each two parts, or one with itself, are a tile."""

    def __init__(self, sizes: DataFrame, side: int):
        """sizes: (key, n). Only the TILED fullest of those with more than `side` rows reach the driver."""
        full = sorted((r.key, -(-r.n // side)) for r in sizes.filter(F.col("n") > side).orderBy(F.col("n").desc(), "key").limit(TILED).collect())
        self.keys = np.array([k for k, _ in full], np.int64)
        self.parts = np.array([n for _, n in full], np.int64)

    def place(self, keys: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tile, part) of each row in each of its tiles. part is -1 where all pairs of a tile count, else only pairs of different parts do."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        hot = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else np.zeros(0, np.int64)
        cold = np.setdiff1d(np.arange(len(keys)), hot, assume_unique=True)
        if not len(hot):
            return cold, keys, np.full(len(keys), -1)
        parts = self.parts[at[hot]]
        own = ((forms[hot].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) % parts
        rows = np.repeat(hot, parts)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
        own = np.repeat(own, parts)
        low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
        mixed = keys[rows].view(np.uint64) ^ ((low << np.uint64(24) | high) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return np.concatenate((cold, rows)), np.concatenate((keys[cold], mixed.view(np.int64))), np.concatenate((np.full(len(cold), -1), np.where(own == other, -1, own)))


def _whole_tiles(batches: Iterator[pa.RecordBatch], most: int, weight: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    """Whole tiles, as many as make a chunk by weight, of batches in order of their column tile."""
    held: list[pa.RecordBatch] = []
    full = 0
    for batch in batches:
        held.append(batch)
        full += weight(batch)
        if full >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            tile = table.column("tile").to_numpy()
            cut = int(np.searchsorted(tile, tile[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                full = sum(map(weight, held))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _spread(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower roots until rows that a pair connects share one."""
    while True:
        low = np.minimum(roots[a], roots[b])
        if (low == roots[a]).all() and (low == roots[b]).all():
            return
        np.minimum.at(roots, roots[a], low)
        np.minimum.at(roots, roots[b], low)
        while not (roots == (up := roots[roots])).all():
            roots[:] = up


def _links(forms: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    other = np.flatnonzero(forms != forms[roots])
    return pa.RecordBatch.from_arrays([pa.array(forms[other]), pa.array(forms[roots[other]])], names=["a", "b"])


def _projected(distinct: DataFrame, n: int, tiles: Tiles | None) -> DataFrame:
    """Each fingerprint in its leaf of each projection: (key) alone without tiles, else (tile, part, form, fp)."""
    places = projections(n)
    power = np.int64(1) << np.arange(places.shape[1], dtype=np.int64)
    prepare(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1)
            forms = batch.column(0).to_numpy()
            for k, own in enumerate(places):
                leaf = bits[:, own].astype(np.int64) @ power + (np.int64(k) << np.int64(40))
                if tiles is None:
                    yield pa.RecordBatch.from_arrays([pa.array(leaf)], names=["key"])
                    continue
                rows, tile, part = tiles.place(leaf, forms)
                yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(part.astype(np.int32)), pa.array(forms[rows]), batch.column(1).take(pa.array(rows))], names=["tile", "part", "form", "fp"])

    return distinct.select("form", "fp").filter("fp IS NOT NULL").mapInArrow(run, "key long" if tiles is None else "tile long, part int, form long, fp binary")


def _near(tile: np.ndarray, part: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one tile within RADIUS."""
    rows, step, first = np.arange(len(tile) - 1), 1, np.ascontiguousarray(fp[:, 0])
    while len(rows):
        rows = rows[tile[rows] == tile[rows + step]]
        able = rows[np.bitwise_count(first[rows] ^ first[rows + step]) <= FIRST_RADIUS]
        able = able[(part[able] < 0) | (part[able] != part[able + step])]
        near = able[np.bitwise_count(fp[able] ^ fp[able + step]).sum(axis=1, dtype=np.int64) <= RADIUS]
        yield near, near + step
        step += 1
        rows = rows[rows + step < len(tile)]


def close_links(distinct: DataFrame, n: int) -> DataFrame:
    """Spanning links (a, b) between the forms of n fingerprints that lie within RADIUS of each other and share a leaf."""
    sizes = _projected(distinct, n, None).groupBy("key").agg(F.count("*").alias("n"))
    # In order of forms, so that the root of what is close is the smallest form, in whatever leaf.
    placed = _projected(distinct, n, Tiles(sizes, TILE)).repartition("tile").sortWithinPartitions("tile", "form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tiles(batches, CHUNK, lambda b: b.num_rows):
            forms, part = table.column("form").to_numpy(), table.column("part").to_numpy()
            fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), "<u8").reshape(-1, WORDS)
            roots, held, full = np.arange(len(forms)), [], 0
            for pair in _near(table.column("tile").to_numpy(), part, fp):
                held.append(pair)
                full += len(pair[0])
                if full > PAIRS:
                    _spread(roots, *map(np.concatenate, zip(*held)))
                    held, full = [], 0
            if held:
                _spread(roots, *map(np.concatenate, zip(*held)))
            yield _links(forms, roots)

    return _to_the_smallest(placed.mapInArrow(run, "a long, b long"))


def tree_links(distinct: DataFrame) -> DataFrame:
    """Spanning links (a, b) between forms whose first 64 bits are equal or within simhash_vp's radius, found by its vantage-point trees."""
    first = F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long")
    own = distinct.filter("fp IS NOT NULL").select("form", first.alias("first"))
    points = materialize(own.groupBy("first").agg(F.min("form").alias("root")), "points")
    equal = own.join(points, "first").filter("form <> root").select(F.col("form").alias("a"), F.col("root").alias("b"))
    near = vantage_links(points.select(F.col("first").alias("fp")), points.count())
    side = lambda name: points.select(F.col("first").alias(f"{name}_first"), F.col("root").alias(name))
    near = near.select(F.col("a").alias("a_first"), F.col("b").alias("b_first")).join(side("a"), "a_first").join(side("b"), "b_first").select("a", "b")
    found = materialize(equal.union(near), "near")
    discard(points)
    return found


def _to_the_smallest(links: DataFrame) -> DataFrame:
    """Links that connect the same forms, but fewer: each form keeps the smallest of its roots, to which its other roots are linked.

    A form has at most a root for each of its leaves. Forms of one group have few roots in all, so most of the new links coincide.
    """
    roots = links.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs"))
    pairs = F.transform("bs", lambda b, i: F.when(i == 0, F.struct(F.col("a").alias("a"), b.alias("b"))).otherwise(F.struct(b.alias("a"), F.element_at("bs", 1).alias("b"))))
    return roots.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def similar_pairs(sets: list[np.ndarray], part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one tile's shingle sets with a similarity of LEAST or more, i below j."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]  # the owners of each shingle, in order
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    counts = np.diff(np.append(starts, len(flat)))
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), counts)  # of each set's shingles, set by set
    edges = np.concatenate(([0], np.cumsum(sizes)))
    left, right = [], []
    for i in range(len(sets) - 1):
        own = place[edges[i] : edges[i + 1]]
        own = own[counts[own] > 1]
        n = counts[own]
        shared = np.bincount(owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[own], n)], minlength=len(sets))
        good = shared >= LEAST * (sizes[i] + sizes - shared)
        good[: i + 1] = False
        if part[i] >= 0:
            good &= part != part[i]
        found = np.flatnonzero(good)
        left.append(np.full(len(found), i))
        right.append(found)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _compared(placed: DataFrame) -> DataFrame:
    """Spanning links (a, b) between similar sets of one tile: placed(tile, part, form, held); see similar_pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tiles(batches, SHINGLES, lambda b: b.column(3).nbytes // 8):
            tile, forms, part = (table.column(c).to_numpy() for c in ("tile", "form", "part"))
            sets = [np.frombuffer(x, np.uint64) for x in table.column("held").to_pylist()]
            roots = np.arange(len(forms))
            edges = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(tile)]):
                i, j = similar_pairs(sets[a:b], part[a:b])
                _spread(roots, i + a, j + a)
            yield _links(forms, roots)

    return placed.select("tile", "part", "form", "held").repartition("tile").sortWithinPartitions("tile", "form").mapInArrow(run, "a long, b long").distinct()


def similar_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Spanning links (a, b) of similar texts: members(form, cluster, digest), texts(digest, text).

    A cluster is cut into parts of about CLUSTER_TILE texts, and within a part all pairs are compared. Where a cluster
    has several parts, see _across.
    """
    parts = F.ceil(F.col("n") / CLUSTER_TILE).cast("int").alias("parts")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n")).select("cluster", parts)
    # A merge join whatever the size: texts are not to be shuffled only from some size on.
    held = members.join(sizes, "cluster")
    own = texts.join(held.hint("merge"), "digest").groupBy("form").agg(F.first("cluster").alias("cluster"), F.first("parts").alias("parts"), F.first("text").alias("text"))
    prepare(own)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts_ in slices(batch, 3):
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([shingles(t).tobytes() for t in texts_], pa.binary())], names=["form", "cluster", "parts", "held"])

    sets = own.select("form", "cluster", "parts", "text").mapInArrow(cut, "form long, cluster long, parts int, held binary")
    mixed = F.pmod(F.xxhash64("form", F.lit("part")), F.col("parts")).cast("int")
    sets = materialize(sets.select("form", "cluster", "parts", mixed.alias("own"), "held"), "sets")
    tile = F.when(F.col("parts") == 1, F.col("cluster")).otherwise(F.xxhash64("cluster", "own"))
    links = materialize(_compared(sets.select(tile.alias("tile"), F.lit(-1).alias("part"), "form", "held")), "links")
    full = sets.filter("parts > 1")
    if not full.isEmpty():
        links = _across(full, links)
    discard(sets)
    return links


def _across(full: DataFrame, links: DataFrame) -> DataFrame:
    """links and those between parts of one cluster, for full(form, cluster, parts, own, held).

    First the smallest text of each group that a part has formed is held against those of the other parts, which makes
    most of a cluster one group: what copies of one template are. Its texts need no more comparison among themselves.
    The others go to every part of their cluster, and are held against all texts there. So a text of the largest group
    is one row, whatever its cluster's size; the others are a row for each part, and no pair of two groups is left out.
    """
    groups = _groups(full, links)
    firsts = full.join(groups.filter("root = form").select("form"), "form", "left_semi")
    tiles = Tiles(groups.filter("root = form").groupBy(F.col("cluster").alias("key")).agg(F.count("*").alias("n")), CLUSTER_TILE)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, held = batch.column(0).to_numpy(), batch.column(2)
            rows, tile, part = tiles.place(batch.column(1).to_numpy(), forms)
            for at in range(0, len(rows), 64):  # a text may be in many tiles
                some = slice(at, at + 64)
                yield pa.RecordBatch.from_arrays([pa.array(tile[some]), pa.array(part[some].astype(np.int32)), pa.array(forms[rows[some]]), held.take(pa.array(rows[some]))], names=["tile", "part", "form", "held"])

    between = firsts.select("form", "cluster", "held").mapInArrow(spread, "tile long, part int, form long, held binary")
    more = materialize(links.union(_compared(between)), "links")
    discard(groups)
    groups = _groups(full, more)
    largest = groups.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    sided = full.join(groups.join(largest, "cluster").select("form", (F.col("root") != F.col("largest")).alias("minor")), "form")
    # Rows of part 0 are not compared with each other, those of part -1 with all.
    goes = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    placed = sided.select("form", "held", "cluster", F.when(F.col("minor"), -1).otherwise(0).alias("part"), F.explode(goes).alias("to"))
    whole = materialize(more.union(_compared(placed.select(F.xxhash64("cluster", "to").alias("tile"), "part", "form", "held"))), "links")
    for table in (links, more, groups):
        discard(table)
    return whole


def _groups(full: DataFrame, links: DataFrame) -> DataFrame:
    """(form, cluster, root) of the texts of full, by the links so far."""
    labels = connected_components(links.join(full.select(F.col("form").alias("a")), "a", "left_semi"))
    groups = materialize(full.select("form", "cluster").join(labels.withColumnRenamed("node", "form"), "form", "left").withColumn("root", F.coalesce("root", "form")), "groups")
    discard(labels)
    return groups


def _digest(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _sketched(df: DataFrame) -> DataFrame:
    def setup():
        def compute(texts: list[bytes]) -> list[pa.Array]:
            prints = [wide_simhash(s) if len(s := shingles(t)) else None for t in texts]
            return [pa.array([form(t) for t in texts], pa.int64()), pa.array(prints, pa.binary())]

        return compute

    return append_columns(df, "text", [T.StructField("form", T.LongType()), T.StructField("fp", T.BinaryType())], setup)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, root) for each row: rows of one root are near copies, directly or through others; digest is that of the text.

    Texts that differ in spaces and capitals of ASCII only are equal; null and wordless texts are equal to each
    other and near nothing else. Repeated rows and null ids are kept. Other columns are not looked at.
    """
    prints = materialize(_sketched(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _digest(text_col).alias("digest"))).drop("text"), "prints")
    distinct = materialize(prints.groupBy("form").agg(F.first("fp").alias("fp"), F.first("digest").alias("digest")), "distinct")
    near = tree_links(distinct)
    close = materialize(near.union(close_links(distinct, distinct.count())), "close")
    discard(near)
    clusters = connected_components(close)
    members = materialize(clusters.select(F.col("node").alias("form"), F.col("root").alias("cluster")).join(distinct.select("form", "digest"), "form"), "members")
    links = similar_links(members, df.select(_digest(text_col).alias("digest"), F.col(text_col).alias("text")))
    roots = connected_components(links)
    found = materialize(prints.select("id", "digest", "form").join(roots.withColumnRenamed("node", "form"), "form", "left").select("id", "digest", F.coalesce("root", "form").alias("root")), "classes")
    for table in (prints, distinct, close, clusters, members, links, roots):
        discard(table)
    return found


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near copies: of each class the row of the smallest id (null ids last, then by text digest).

    All columns stay, whatever their names. Rows that agree in id and text are one row. An empty table stays empty.
    """
    own = classes(df, id_col, text_col)
    first = materialize(own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("s")), "first")
    discard(own)
    # Both sides have the same three plain keys, so that the join and the last step share one shuffle.
    keys = [fresh(df, k) for k in ("key_null", "key_id", "key_digest")]
    keyed = lambda one, id_, digest: one.withColumns(dict(zip(keys, (id_.isNull(), F.coalesce(id_, F.lit(0).cast(df.schema[id_col].dataType)), digest))))
    kept = keyed(df, F.col(id_col), _digest(text_col)).join(keyed(first, F.col("s.id"), F.col("s.digest")).select(*keys), keys, "left_semi")
    return kept.dropDuplicates(keys).select(*df.columns)
