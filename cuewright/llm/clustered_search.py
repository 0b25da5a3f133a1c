"""Ranked lexical search: documents reordered by recursive graph bisection, an inverted index by clusters, exact top-k with early stopping."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bisection import Postings, Tree, order
from .common import batch_rows, discard, materialize, prepare, slices

#: Documents whose bisections make the tree, terms of each and of all that it looks at, and its levels. None changes a result.
SAMPLE, SAMPLE_TERMS, VOCABULARY, DEPTH = 4096, 256, 1 << 15, 6
#: Documents in a cluster of the index, and postings that a task reorders at once (a longer document is alone).
CLUSTER, GROUP_POSTINGS = 512, 1 << 19
#: Rows in an Arrow batch of clusters, each of which holds all the postings of a cluster that some item has.
BATCH_CLUSTERS = 16
#: Bytes of the terms of the items that are searched for at once.
BLOCK_BYTES = 1 << 20
#: How far the rounds of a search go down: these parts of the way from the best bound to the score that is to be beaten.
ROUNDS = (0.5, 0.75, 1.0)
#: What a byte becomes; letters are lower-cased, all that no term holds is a blank.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(raw: bytes) -> Counter[bytes]:
    return Counter(raw.translate(BYTES).split())


def fit_tree(docs: DataFrame, text_col: str, depth: int) -> tuple[dict[bytes, int], Tree]:
    """The vocabulary and the tree of a bounded sample, taken by a hash of where a row stands."""
    prepare(docs)
    every = max(1, docs.count() // SAMPLE)
    some = docs.select(text_col).withColumn("place", F.monotonically_increasing_id()).filter(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).select(F.coalesce(text_col, F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [b" ".join(sorted(terms_of(t.encode()), key=hash_of)[:SAMPLE_TERMS]) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held)], names=["terms"])

    rows = [bytes(r.terms).split() for r in some.mapInArrow(cut, "terms binary").limit(2 * SAMPLE).collect()]
    counts = Counter(chain.from_iterable(rows))
    known = sorted((t for t, n in counts.items() if n > 1), key=lambda t: (-counts[t], t))[:VOCABULARY]
    number = {t: i for i, t in enumerate(known)}
    lists = [[number[t] for t in r if t in number] for r in rows]
    start = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return number, Tree(Postings(start, np.array(list(chain.from_iterable(lists)), np.int64), max(1, len(known))), depth)


def hash_of(term: bytes) -> int:
    return int.from_bytes(term[-8:], "little") * 0x9E3779B97F4A7C15 & (1 << 64) - 1


@dataclass
class Index:
    """Rows (cluster, term, df, top, places, impacts) by cluster and term, and one with the empty term and the cluster's doc ids."""

    table: DataFrame
    documents: int
    terms: int

    def drop(self) -> None:
        discard(self.table)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cluster: int = CLUSTER) -> Index:
    """Index every document that has a term; null and wordless texts are in no cluster, repeated rows each stand for themselves.

    A tree of bisections, made from a sample, says in which leaf a document lies; a leaf with many documents is dealt
    out to several tasks. A task bisects its documents to the size of a cluster; clusters are runs of that order.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("slot", F.xxhash64(F.monotonically_increasing_id()))
    vocabulary, tree = fit_tree(docs, "text", DEPTH)
    model = docs.sparkSession.sparkContext.broadcast((vocabulary, tree))

    def cut_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, fitted = model.value
        for batch in batches:
            for part, texts in slices(batch, 1):
                counted = [terms_of(t) for t in texts]
                sizes = np.array([len(c) for c in counted], np.int64)
                flat = list(chain.from_iterable(counted))
                known = np.fromiter((number.get(t, -1) for t in flat), np.int64, len(flat))
                owner = np.repeat(np.arange(len(texts)), sizes)
                leaf = fitted.leaves(known[known >= 0], owner[known >= 0], len(texts))
                times = np.fromiter(chain.from_iterable(c.values() for c in counted), np.int32, len(flat))
                length = np.bincount(owner, weights=times, minlength=len(texts)).astype(np.int64)
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(flat, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(times))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(leaf.astype(np.int32)), pa.array(length), *lists], names=["doc_id", "slot", "leaf", "n", "terms", "times"])

    cut = docs.select("doc_id", "text", "slot").mapInArrow(cut_terms, "doc_id long, slot long, leaf int, n long, terms array<string>, times array<int>")
    cut = materialize(cut.filter("n > 0"), "forward")
    n_docs, n_terms = cut.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut.repartitionByRange(parts, "leaf", "slot").sortWithinPartitions("leaf", "slot").select("doc_id", "n", "terms", "times")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, size = 0, [], 0
        for batch in chain(batches, [None]):
            for part in [batch.slice(i, 64) for i in range(0, batch.num_rows, 64)] if batch is not None else [None]:
                more = part.column(2).flatten() if part is not None else ()
                if held and (part is None or size + len(more) > GROUP_POSTINGS):
                    rows, made = clusters(pa.Table.from_batches(held).combine_chunks(), n_docs, n_terms, cluster, (TaskContext.get().partitionId() << 32) + count)
                    count, held, size = count + made, [], 0
                    yield from rows.to_batches(max_chunksize=1 << 14)
                if part is not None:
                    held.append(part)
                    size += len(more)

    index = Index(materialize(laid.mapInArrow(write, "cluster long, term string, df int, top int, places array<int>, impacts array<int>, docs array<long>"), "index"), n_docs, n_terms)
    discard(cut)
    return index


def clusters(group: pa.Table, n_docs: int, n_terms: int, size: int, first: int) -> tuple[pa.Table, int]:
    """The index rows of some documents (doc_id, n, terms, times), and the number of clusters they make."""
    column = lambda i: group.column(i).combine_chunks()
    terms = column(2)
    start = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))]).astype(np.int64)
    coded = terms.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    times = column(3).flatten().to_numpy().astype(np.int64)
    line = order(Postings(start, codes, len(names)), np.arange(group.num_rows), size)
    place = np.empty(len(line), np.int64)
    place[line] = np.arange(len(line))
    # Whole numbers of any size: a very long document in a very large table goes beyond a long here.
    damped = np.array([10 + 90 * n * n_docs // n_terms for n in column(1).to_pylist()], np.int64)
    owner = np.repeat(np.arange(len(line)), np.diff(start))
    impact = 1_000_000_000 * times // (1000 * times + 8 * damped[owner])
    alphabet = pc.sort_indices(names).to_numpy().astype(np.int64)
    turn = np.empty(len(names), np.int64)
    turn[alphabet] = np.arange(len(names))
    sort = np.lexsort((place[owner], turn[codes], place[owner] // size))
    owner, codes, impact = owner[sort], codes[sort], impact[sort]
    where = place[owner] // size
    begin = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (codes[1:] != codes[:-1])])) if len(codes) else np.zeros(0, np.int64)
    made = (len(line) + size - 1) // size
    ends = pa.array(np.append(begin, len(codes)).astype(np.int32))
    tops = np.maximum.reduceat(impact, begin) if len(begin) else begin
    lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32)))
    posted = [pa.array(first + where[begin]), names.take(pa.array(codes[begin])), pa.array(np.diff(np.append(begin, len(codes))).astype(np.int32)), pa.array(tops.astype(np.int32)), lists(place[owner] % size), lists(impact), pa.nulls(len(begin), pa.list_(pa.int64()))]
    cuts = pa.array(np.append(np.arange(made) * size, len(line)).astype(np.int32))
    none = pa.nulls(made, pa.list_(pa.int32()))
    told = [pa.array(first + np.arange(made)), pa.array([""] * made), pa.nulls(made, pa.int32()), pa.nulls(made, pa.int32()), none, none, pa.ListArray.from_arrays(cuts, column(0).take(pa.array(line)))]
    columns = ["cluster", "term", "df", "top", "places", "impacts", "docs"]
    return pa.concat_tables([pa.Table.from_arrays(told, names=columns), pa.Table.from_arrays(posted, names=columns)]), made


class Asked:
    """A block of items: terms as numbers with their weights, and what is known of each item so far."""

    def __init__(self, items: list[list[int]], weight: np.ndarray, k: int):
        self.k, self.weight = k, weight
        self.terms = np.array(list(chain.from_iterable(items)), np.int64)
        self.owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
        self.items = [np.array(x, np.int64) for x in items]
        #: The best bound and its cluster, the score to beat (0: none yet), and how far down bounds have been visited.
        self.best, self.cluster = np.zeros(len(items), np.int64), np.full(len(items), -1)
        self.floor, self.seen = np.zeros(len(items), np.int64), np.full(len(items), np.iinfo(np.int64).max)

    def bounds(self, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """For each item the highest score that a document of a cluster with these terms and highest impacts can have."""
        top = np.zeros(len(self.weight), np.int64)
        top[terms] = tops
        out = np.zeros(len(self.items), np.int64)
        np.add.at(out, self.owner, (top * self.weight)[self.terms])
        return out


def _rows(packed: DataFrame, asked: Asked, visit: np.ndarray | None) -> DataFrame:
    """Of every cluster: its bounds (visit None), or hits of the items that visit it, as their bounds lie between visit and asked.seen."""
    shared = packed.sparkSession.sparkContext.broadcast((asked, visit))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, down = shared.value
        best, where = np.zeros(len(own.items), np.int64), np.full(len(own.items), -1)
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                terms, tops, sizes, places, impacts = (batch.column(c)[i].values.to_numpy() for c in range(1, 6))
                bound = own.bounds(terms, tops)
                if down is None:
                    more = (bound > best) | ((bound == best) & (bound > 0) & (name < where))
                    best[more], where[more] = bound[more], name
                    continue
                go = np.flatnonzero((bound > 0) & ((own.cluster == name) if down.size == 0 else (bound >= down) & (bound < own.seen) & (own.cluster != name)))
                if not len(go):
                    continue
                docs = batch.column(6)[i].values
                ids = docs.fill_null(np.iinfo(np.int64).max).to_numpy()
                at = np.full(len(own.weight), -1)
                at[terms] = np.arange(len(terms))
                ends = np.cumsum(sizes)
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for q in go:
                    score = np.zeros(len(ids), np.int64)
                    for t in own.items[q]:
                        if (j := at[t]) >= 0:
                            score[places[ends[j] - sizes[j] : ends[j]]] += own.weight[t] * impacts[ends[j] - sizes[j] : ends[j]].astype(np.int64)
                    hit = np.flatnonzero((score > 0) & (score >= own.floor[q]))
                    hit = hit[np.lexsort((ids[hit], -score[hit]))[: own.k]]
                    found.append((np.full(len(hit), q), hit, score[hit]))
                q, hit, score = (np.concatenate(x) for x in zip(*found))
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), docs.take(pa.array(hit)), pa.array(score)], names=["q", "doc_id", "score"])
        if down is None:
            q = np.flatnonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(where[q]), pa.array(best[q])], names=["q", "doc_id", "score"])

    return packed.mapInArrow(look, "q long, doc_id long, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    line = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)


def _one_block(index: Index, names: list, items: list[set[bytes]], k: int, item_type: T.DataType, item_col: str) -> DataFrame:
    spark = index.table.sparkSession
    number = {t: i for i, t in enumerate(sorted(set().union(*items)))}
    wanted = spark.createDataFrame([(t.decode(), i) for t, i in number.items()], "term string, t int")
    # The terms of a block are bounded, and the index is then looked through where it lies.
    posted = index.table.filter("term <> ''").join(F.broadcast(wanted), "term").select("cluster", "t", "df", "top", "places", "impacts")
    held = F.collect_list(F.struct("t", "top", F.size("places").alias("size"), "places", "impacts"))
    packed = posted.groupBy("cluster").agg(held.alias("s")).join(index.table.filter("term = ''").select("cluster", "docs"), "cluster")
    packed = materialize(packed.select("cluster", "s.t", "s.top", "s.size", F.flatten("s.places").alias("places"), F.flatten("s.impacts").alias("impacts"), "docs"), "packed")
    counted = packed.select(F.explode(F.arrays_zip("t", "size")).alias("e")).groupBy("e.t").agg(F.sum("e.size").alias("df"))
    weight = np.zeros(len(number), np.int64)
    for r in counted.collect():
        weight[r.t] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r.df + 1)))
    asked = Asked([[number[t] for t in sorted(x)] for x in items], weight, k)
    first = _rows(packed, asked, None).groupBy("q").agg(F.max(F.struct("score", -F.col("doc_id"))).alias("top")).select("q", "top.*")
    with batch_rows(spark, BATCH_CLUSTERS):
        found = first.collect()
    for r in found:
        asked.best[r[0]], asked.cluster[r[0]] = r[1], -r[2]
    hits = None
    # Each item's best cluster first; then all clusters down to a bound, lower with each round, until none is left that can reach the floor.
    for down in (np.zeros(0, np.int64), *ROUNDS):
        visit = down if isinstance(down, np.ndarray) else np.maximum(asked.floor, (asked.best - down * (asked.best - asked.floor)).astype(np.int64))
        if len(visit) == 0 or (visit < asked.seen).any():
            new = _rows(packed, asked, visit)
            with batch_rows(spark, BATCH_CLUSTERS):
                before, hits = hits, materialize(_ranked(new if hits is None else new.union(hits.select("q", "doc_id", "score")), k), "hits")
            if before is not None:
                discard(before)
        if len(visit):
            asked.seen = np.minimum(asked.seen, visit)
        for r in hits.filter(F.col("rank") == k).select("q", "score").collect():
            asked.floor[r[0]] = r[1]
    discard(packed)
    labels = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("q", T.LongType()), T.StructField(item_col, item_type)]))
    out = materialize(hits.join(labels, "q").select(item_col, "rank", "doc_id", "score"), "ranked")
    discard(hits)
    return out


def search(index: Index, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents for each item, fewer if fewer have a score above 0.

    Ties go to the smaller doc_id, null ids last. Items without a term have no rows; a repeated item is ranked each
    time for itself. A cluster is visited by an item only if the sum of its weights and the cluster's highest impacts
    reaches the k-th best score found so far, so the result is that of visiting all.
    Items come in blocks of block_bytes of terms, each answered and written before the next is read.
    """
    spark = items.sparkSession
    kind = items.schema[item_col].dataType
    none = spark.createDataFrame([], T.StructType([T.StructField(item_col, kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    answers, names, block, held = [], [], [], 0
    if k > 0 and index.documents:
        for row in items.select(item_col, text_col).toLocalIterator():
            if terms := set(terms_of((row[1] or "").encode())):
                if held >= block_bytes:
                    answers.append(_one_block(index, names, block, k, kind, item_col))
                    names, block, held = [], [], 0
                names.append(row[0])
                block.append(terms)
                held += sum(map(len, terms)) + 8 * len(terms)
        if names:
            answers.append(_one_block(index, names, block, k, kind, item_col))
    return reduce(DataFrame.union, answers, none)
