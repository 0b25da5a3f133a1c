"""A kept index for lexical search (BM25): postings in parts of the term, in blocks with their own bounds, appended batch by batch.

The passages of a batch are dealt to cells of about CELL passages of one scope. A block is what one term has in one
cell: its postings, and the highest frequency and the least length among them. From these two follows the most that
any passage of the cell can get for the term, whatever the averages of the scope have become since. A question reads
the bounds of its own terms' blocks, and postings only of cells that can still reach its best k.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import lexical_confidence
from ..functions.tokens import search_terms
from ..operators.lexical import B, DIGITS, K1, best_of_tile, idf, query_terms, ranked
from ..shared import materialize
from ..shipping import ship
from .snapshots import Change, Snapshots

SCHEMAS = {
    "blocks": ("scope string, term string, cell long, n int, max_tf int, min_len int, ids array<long>, tfs array<int>, lens array<int>", "term"),
    "totals": ("scope string, n_docs long, sum_len long", "scope"),
}
#: Parts that terms are dealt to, and passages of a cell.
PARTS, CELL = 64, 256
#: Terms that a task looks at in one step when blocks are made, about; those of one cell at least.
BLOCK_TERMS = 1 << 20


class PostingIndex:
    """An index below a folder. Batches are added in one step each; the passages themselves are not kept."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS, cell: int = CELL) -> None:
        self.spark, self.cell, self.files = spark, cell, Snapshots(spark, folder, SCHEMAS, parts)

    def add(self, passages: DataFrame) -> int:
        """Index passages(scope, passage_id, text), whose ids are new; the number of the version that has them.

        Passages without terms count for the averages. Only new files are written. A scope that most passages have is
        many cells; a null scope is a scope of its own.
        """
        ship(self.spark)
        batch = uuid.uuid4().hex
        own = passages.select(F.col("scope").cast("string").alias("scope"), F.col("passage_id").cast("long").alias("passage_id"), "text")
        # Written, so that Spark knows how small it is: joined by scope alone, the texts of one scope would all go to one task.
        sizes = materialize(own.groupBy("scope").agg(F.ceil(F.count("*") / self.cell).alias("cells")))
        rows = _same_scope(own, sizes, F.lit(True)).select("l.*", "cells")
        dealt = rows.select("scope", F.xxhash64(F.lit(batch), "scope", F.pmod(F.xxhash64("passage_id"), F.col("cells"))).alias("cell"), "passage_id", "text")
        line = dealt.repartition("cell").sortWithinPartitions("cell", "passage_id")
        # The empty term, which no text has, stands for the passage itself.
        held = materialize(line.select("scope", "cell", "passage_id", search_terms(F.col("text")).alias("terms")).mapInArrow(_blocks, SCHEMAS["blocks"][0]))
        blocks = held.filter("term <> ''")
        each = held.filter("term = ''").select("scope", F.explode(F.arrays_zip("tfs", "lens")).alias("p"))
        totals = each.groupBy("scope").agg(F.sum("p.tfs").alias("n_docs"), F.sum(F.col("p.lens").cast("long") * F.col("p.tfs")).alias("sum_len"))

        def change(c: Change) -> None:
            c.append("blocks", blocks)
            c.append("totals", totals)

        return self.files.commit(change)

    def top_k(self, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, scope, passage_id, score, rank, confidence), as lexical.retrieve has them for all passages added so far.

        Queries(query_id, text) go to every scope unless they have a column scope. The best cell of each query and
        scope is scored first; its k-th best score is the floor, and of the other cells only those are read whose
        bound reaches it. All of it sees one version of the index.
        """
        ship(self.spark)
        words = materialize(query_terms(queries))
        at = self.files.version()
        # A number stands for a term; written once, so that it stays the same.
        numbers = materialize(words.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
        asked = materialize(words.join(numbers, "term").select("query_id", "t", "qf"))
        held = materialize(self.files.read("blocks", at, self.files.parts_of("blocks", words)).join(numbers, "term").drop("term"))
        stats = materialize(self.files.read("totals", at).groupBy("scope").agg(F.sum("n_docs").alias("n_docs"), (F.sum("sum_len") / F.sum("n_docs")).alias("avg_len")))
        share = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avg_len")))
        counted = held.groupBy("scope", "t").agg(F.sum("n").alias("df"))
        weights = materialize(_same_scope(counted, stats, F.lit(True)).select("l.scope", "t", idf("n_docs", "df").alias("idf"), "avg_len"))
        most = _same_scope(held, weights, F.col("l.t") == F.col("r.t")).select("l.scope", "l.cell", "l.t", (F.col("idf") * share(F.col("max_tf"), F.col("min_len"))).alias("w"))
        # Scores are rounded before they are ranked, so a bound has to allow for that.
        bounds = most.join(asked, "t").groupBy("query_id", "scope", "cell").agg((F.sum(F.col("qf") * F.col("w")) + 10.0**-DIGITS).alias("bound"))
        if "scope" in queries.columns:
            wanted = queries.select("query_id", F.col("scope").cast("string").alias("scope"))
            bounds = bounds.alias("l").join(wanted.alias("r"), (F.col("l.query_id") == F.col("r.query_id")) & F.col("l.scope").eqNullSafe(F.col("r.scope")), "left_semi")
        bounds = materialize(bounds)
        packed = materialize(weights.join(asked, "t").groupBy("query_id", "scope").agg(F.collect_list("t").alias("ts"), F.collect_list(F.col("qf") * F.col("idf")).alias("xs")))
        told = T.StructType([queries.schema["query_id"], T.StructField("scope", T.StringType()), T.StructField("passage_id", T.LongType()), T.StructField("score", T.DoubleType())])

        def scored(visits: DataFrame) -> DataFrame:
            """The best k hits in each cell of visits(query_id, scope, cell): a task has the postings of a cell and all that is asked of it."""
            cells = _same_scope(held.join(visits.select("cell").distinct(), "cell", "left_semi"), stats, F.lit(True)).select("cell", "l.scope", "t", "ids", "tfs", "lens", "avg_len")
            same = (F.col("l.query_id") == F.col("r.query_id")) & F.col("l.scope").eqNullSafe(F.col("r.scope"))
            each = visits.alias("l").join(packed.alias("r"), same).select("l.cell", "l.query_id", "ts", "xs")
            return cells.groupBy("cell").cogroup(each.groupBy("cell")).applyInArrow(_best_of_cell(told, k, k1, b), told)

        # Equal bounds (copies) leave the choice to the cell's number: what is scored first is left out below, so both have to see the same cell.
        first = materialize(bounds.groupBy("query_id", "scope").agg(F.max_by("cell", F.struct("bound", "cell")).alias("cell")))
        early = materialize(ranked(scored(first), k))
        floors = early.filter(F.col("rank") == k - 1).select("query_id", "scope", F.col("score").alias("floor"))
        keys = (F.col("b.query_id") == F.col("f.query_id")) & F.col("b.scope").eqNullSafe(F.col("f.scope"))
        left = bounds.alias("p").join(first.alias("v"), _same_cell("p", "v"), "left_anti")
        more = left.alias("b").join(floors.alias("f"), keys, "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).select("b.query_id", "b.scope", "b.cell")
        hits = early.select("query_id", "scope", "passage_id", "score").union(scored(materialize(more)))
        return ranked(hits, k).withColumn("confidence", lexical_confidence(F.col("score")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (scope, cell, passage_id, terms) in order of cells; whole cells with about BLOCK_TERMS terms are looked at in one step."""
    open_: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.RecordBatch]:
        if open_:
            yield _blocks_of(pa.Table.from_batches(open_).combine_chunks())
            open_.clear()

    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, sizes = batch.column(1).to_numpy(), np.cumsum(pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1), batch.num_rows]
        if last is not None and cell[0] != last and held >= BLOCK_TERMS:
            yield from whole()
            held = 0
        at = 0
        for edge in edges[1:]:
            held += int(sizes[edge - 1]) - (int(sizes[at - 1]) if at else 0)
            open_.append(batch.slice(at, edge - at))
            at = edge
            if edge < batch.num_rows and held >= BLOCK_TERMS:
                yield from whole()
                held = 0
        last = cell[-1]
    yield from whole()


def _blocks_of(rows: pa.Table) -> pa.RecordBatch:
    column = lambda name: rows.column(name).chunk(0)
    scope, cell, ids, terms = (column(n) for n in ("scope", "cell", "passage_id", "terms"))
    lens = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    cells, first, place = np.unique(cell.to_numpy(), return_index=True, return_inverse=True)
    # Rows of one passage with as many terms are one; a null id comes first.
    there, known = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    line = np.lexsort((lens, known, there, place))
    same = (np.diff(place[line]) == 0) & (np.diff(known[line]) == 0) & (np.diff(there[line].astype(int)) == 0) & (np.diff(lens[line]) == 0)
    unit = np.empty(len(line), np.int64)
    unit[line] = np.concatenate(([0], np.cumsum(~same)))
    row_of = line[np.concatenate(([True], ~same))]
    coded = terms.flatten().dictionary_encode()
    words, row = len(coded.dictionary) + 1, np.repeat(np.arange(len(lens)), lens)
    code = np.concatenate((coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.full(len(lens), words - 1)))
    row = np.concatenate((row, np.arange(len(lens))))
    key, tf = np.unique((place[row] * words + code) * len(row_of) + unit[row], return_counts=True)
    block, row = key // len(row_of), row_of[key % len(row_of)]
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    place, code = block[starts] // words, block[starts] % words
    dictionary = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])])
    edges = pa.array(np.append(starts, len(key)).astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(edges, values)
    small, n = lambda x: pa.array(x.astype(np.int32)), np.diff(np.append(starts, len(key)))
    columns = [
        scope.take(pa.array(first[place])), dictionary.take(pa.array(code)), pa.array(cells[place]), small(n), small(np.maximum.reduceat(tf, starts)), small(np.minimum.reduceat(lens[row], starts)),
        lists(ids.take(pa.array(row))), lists(small(tf)), lists(small(lens[row])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["scope", "term", "cell", "n", "max_tf", "min_len", "ids", "tfs", "lens"])


def _best_of_cell(schema: T.StructType, k: int, k1: float, b: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From a cell's blocks (cell, scope, t, ids, tfs, lens, avg_len) and what is asked of it (cell, query_id, ts, xs) to each query's best k."""
    arrow = to_arrow_schema(schema)

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not (blocks.num_rows and asked.num_rows and k > 0):
            return arrow.empty_table()
        blocks, asked = blocks.combine_chunks(), asked.combine_chunks()
        flat = lambda one, name: one.column(name).chunk(0).flatten()
        numbers = lambda one, name: flat(one, name).to_numpy(zero_copy_only=False)
        sizes = lambda one, name: pc.list_value_length(one.column(name).chunk(0)).to_numpy(zero_copy_only=False)
        own, names = flat(blocks, "ids"), asked.column("query_id").chunk(0)
        ids = pc.unique(own)
        ids = ids.take(pc.sort_indices(ids, null_placement="at_start"))
        place = pc.index_in(own, ids).to_numpy(zero_copy_only=False).astype(np.int64)
        tf, term = numbers(blocks, "tfs"), np.repeat(blocks.column("t").to_numpy(), sizes(blocks, "ids"))
        w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * numbers(blocks, "lens") / blocks.column("avg_len")[0].as_py()))
        query = np.repeat(np.arange(len(names)), sizes(asked, "ts"))
        row, near, score = best_of_tile((place, term, w), (query, numbers(asked, "ts"), numbers(asked, "xs")), len(ids), len(names), k).hits()
        columns = [names.take(pa.array(row)), pa.repeat(blocks.column("scope")[0], len(row)), ids.take(pa.array(near)), pa.array(score)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return run


def _same_scope(left: DataFrame, right: DataFrame, also: Column) -> DataFrame:
    """An inner join in which null scopes are equal too; the sides are l and r."""
    return left.alias("l").join(right.alias("r"), F.col("l.scope").eqNullSafe(F.col("r.scope")) & also)


def _same_cell(left: str, right: str) -> Column:
    same = lambda c: F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return (F.col(f"{left}.query_id") == F.col(f"{right}.query_id")) & (F.col(f"{left}.cell") == F.col(f"{right}.cell")) & same("scope")
