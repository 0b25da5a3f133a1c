"""Lexical retrieval (BM25) as joins on terms; statistics are those of a scope, such as one video."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import lexical_confidence
from ..functions.tokens import search_terms
from ..shared import materialize
from ..shipping import ship
from .tops import DIGITS, Best

K1, B = 1.5, 0.75
#: Pairs of a posting and a query with its term that a task weighs, about.
PAIRS = 1 << 21
#: What a tile of passages and queries holds at most, about: passages, their postings, queries, and their terms; and the tiles that there should be at least.
PASSAGES, POSTINGS, QUERIES, TERMS, TILES = 16384, 1 << 21, 1 << 15, 1 << 20, 16
#: Parts that tiles are dealt to at most.
MOST_PARTS = 2048
#: Scores, and pairs of a posting and a query, that a tile works out in one step.
CELLS = 1 << 20
#: Terms that a tile multiplies as matrices at most, and cells that this takes for the time of one pair that is looked up.
HEAVY, PAIR_COST = 128, 256


def scope_stats(passages: DataFrame) -> DataFrame:
    """(scope, n_docs, avg_len): over all passages, those without terms included."""
    return passages.groupBy("scope").agg(F.count("*").alias("n_docs"), F.avg(F.size(search_terms(F.col("text")))).alias("avg_len"))


def postings(passages: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(scope, passage_id, len, term, tf); with terms(term) only theirs, filtered before anything is shuffled."""
    rows = passages.select("scope", "passage_id", search_terms(F.col("text")).alias("terms"))
    # A plain explode would have the optimizer test the array's size below it, which cuts every text into terms twice.
    each = rows.select("scope", "passage_id", F.size("terms").alias("len"), F.explode_outer("terms").alias("term")).filter("term IS NOT NULL")
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term", "left_semi")
    return each.groupBy("scope", "passage_id", "len", "term").agg(F.count("*").alias("tf"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("scope", "term").agg(F.count("*").alias("df"))


def idf(n_docs: str, df: str) -> Column:
    return F.log(1 + (F.col(n_docs) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qf); a term counts as often as the query has it."""
    return queries.select("query_id", F.explode(search_terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def _terms(passages: DataFrame) -> DataFrame:
    """(scope, passage_id, len, term): a row for each term of a passage, and one with the empty term, which no text has and stands for the passage."""
    rows = passages.select("scope", "passage_id", search_terms(F.col("text")).alias("terms"))
    # A plain explode would have the optimizer test the array's size below it, which cuts every text into terms twice.
    return rows.select("scope", "passage_id", F.size("terms").alias("len"), F.explode_outer(F.concat(F.array(F.lit("")), "terms")).alias("term"))


def _prepared(passages: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms of queries; (scope, passage_id, len, term, tf) of what some query has, and (scope, n_docs, avg_len): passages are read once."""
    asked = materialize(query_terms(queries))
    # The empty term, which no text has, stands for the passage itself, so that passages without a hit count too.
    wanted = asked.select("term").distinct().union(asked.sparkSession.createDataFrame([("",)], "term string"))
    held = materialize(_terms(passages).join(wanted, "term", "left_semi").groupBy("scope", "passage_id", "len", "term").agg(F.count("*").alias("tf")))
    posted = held.filter("term <> ''")
    stats = held.filter("term = ''").groupBy("scope").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    return asked, posted, stats


def score(passages: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, scope, passage_id, score) of all passages with a term of the query in common.

    Queries go to every scope unless they have a column scope. Passages are read once: what is kept of each is a
    row with its length and a row for each term that some query has, written to the shared folder; frequencies,
    average lengths and scores come from that. Postings are dealt out by passage, so a task adds up its passages'
    scores itself: hits, of which there are queries times passages, are not shuffled before they are ranked, unless
    the queries' terms are too many for Spark to broadcast them.
    """
    asked, posted, stats = _prepared(passages, queries)
    weights = document_frequencies(posted).join(stats, "scope").select("scope", "term", "df", idf("n_docs", "df").alias("idf"), "avg_len").join(asked, "term")
    if "scope" in queries.columns:
        weights = weights.join(queries.select("query_id", "scope"), ["query_id", "scope"], "left_semi")
    weights = materialize(weights)
    pairs = weights.agg(F.sum("df")).first()[0] or 0
    dealt = posted.repartition(-(-pairs // PAIRS) or 1, "scope", "passage_id")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    weighed = dealt.join(weights, ["scope", "term"]).select("query_id", "scope", "passage_id", (F.col("qf") * (F.col("idf") * F.col("tf") * (k1 + 1) / norm)).alias("w"))
    return weighed.groupBy("query_id", "scope", "passage_id").agg(F.round(F.sum("w"), DIGITS).alias("score")).filter("score > 0")


def ranked(hits: DataFrame, k: int, by: str = "score", tie: str = "passage_id", per: tuple[str, ...] = ("query_id", "scope")) -> DataFrame:
    """The best k hits of each query and scope with their 0-based rank; ties go to the smaller id."""
    line = Window.partitionBy(*per).orderBy(F.col(by).desc(), tie)
    return hits.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def best_of_tile(passage: tuple[np.ndarray, ...], query: tuple[np.ndarray, ...], passages: int, queries: int, k: int) -> Best:
    """The best k passages of each query of a tile, from postings (passage, term, w) and (query, term, x), passages and queries by number.

    Terms with pairs in many cells are multiplied as matrices, the pairs of all others are looked up.
    """
    (p, term, w), (q, asked, x) = passage, query
    known, asked = np.unique(asked, return_inverse=True)
    at = np.minimum(np.searchsorted(known, term), len(known) - 1)
    there = known[at] == term
    p, term, w = p[there], at[there], w[there]
    pairs = np.bincount(term, minlength=len(known)) * np.bincount(asked, minlength=len(known))
    heavy = np.argsort(-pairs, kind="stable")[:HEAVY]
    heavy = heavy[pairs[heavy] * PAIR_COST > passages * queries]
    place = np.full(len(known), -1)
    place[heavy] = np.arange(len(heavy))
    own = place[term] >= 0
    right = np.bincount(place[term[own]] * passages + p[own], w[own], minlength=len(heavy) * passages).reshape(len(heavy), passages)
    p, term, w = p[~own], term[~own], w[~own]
    own = place[asked] >= 0
    left = np.zeros((queries, len(heavy)))
    left[q[own], place[asked[own]]] = x[own]
    q, asked, x = q[~own], asked[~own], x[~own]
    line = np.argsort(term, kind="stable")
    p, term, w = p[line], term[line], w[line]
    line = np.argsort(q, kind="stable")
    q, asked, x = q[line], asked[line], x[line]
    low = np.searchsorted(term, asked)
    n = np.searchsorted(term, asked, "right") - low
    sums, best, step = np.concatenate(([0], np.cumsum(n))), Best(queries, k, positive=True), max(1, CELLS // passages)
    for first in range(0, queries, step):
        scores = left[first : first + step] @ right
        begin, stop = np.searchsorted(q, (first, first + step))
        while begin < stop:  # with so many pairs at once, those of one term at least
            end = min(stop, max(begin + 1, int(np.searchsorted(sums, sums[begin] + CELLS, "right")) - 1))
            own = n[begin:end]
            post = np.arange(own.sum()) + np.repeat(low[begin:end] - sums[begin:end] + sums[begin], own)
            cell = np.repeat((q[begin:end] - first) * passages, own) + p[post]
            scores += np.bincount(cell, np.repeat(x[begin:end], own) * w[post], minlength=scores.size).reshape(scores.shape)
            begin = end
        best.offer(first, scores, np.arange(passages))
    return best


def best(passages: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, scope, passage_id, score): the best k hits of each query in each tile, which the best k of all are among.

    Scores are those of `score`. Passages of a scope and queries are dealt into tiles of bounded size, each passage
    with its postings as one row for every block of queries, each query with its terms as one for every block of
    passages. A task adds up the scores of a tile as one array and hands on the best, so no pair of a passage and a
    query is ever a row. The work grows with the pairs of a passage and a query, which is what ranking all of them takes.
    """
    spark = passages.sparkSession
    ship(spark)
    asked = materialize(query_terms(queries))
    # A number stands for a term, written once, so that it stays the same; -1 for the empty term, which no text has and each passage gets.
    numbers = materialize(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    wanted = numbers.union(spark.createDataFrame([("", -1)], "term string, t long"))
    each = _terms(passages).join(wanted, "term").repartition("scope", "passage_id").groupBy("scope", "passage_id", "len", "t").agg(F.count("*").alias("tf"))
    found = lambda c: F.collect_list(F.when(F.col("t") >= 0, F.col(c)))
    held = materialize(each.groupBy("scope", "passage_id", "len").agg(F.max(F.when(F.col("t") < 0, F.col("tf"))).alias("n"), found("t").alias("ts"), found("tf").alias("tfs")))
    sizes = held.groupBy("scope").agg(F.sum("n").alias("n_docs"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("avg_len"), F.sum(F.size("ts")).alias("n_posted"))
    most = F.greatest(F.ceil(F.col("n_docs") / PASSAGES), F.ceil(F.col("n_posted") / POSTINGS), F.least(F.lit(TILES), F.ceil(F.col("n_docs") * TILES / PASSAGES)))
    # Written, so that Spark knows how small it is: joined by scope alone, passages of one scope would all go to one task.
    stats = materialize(sizes.withColumn("blocks", F.greatest(most, F.lit(1)).cast("int")))
    n = asked.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("terms")).first()
    sides = max(1, -(-n.queries // QUERIES), -(-n.terms // TERMS))
    spread = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    weigh = lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    left = held.join(stats, "scope").select("scope", F.pmod(F.xxhash64("passage_id"), F.col("blocks")).cast("int").alias("i"), spread(F.lit(sides)).alias("j"), "passage_id", "ts", F.transform("tfs", weigh).alias("ws"))
    freq = held.select("scope", F.explode("ts").alias("t")).groupBy("scope", "t").agg(F.count("*").alias("df"))
    weights = freq.join(numbers, "t").join(asked, "term").join(stats, "scope")
    if "scope" in queries.columns:
        weights = weights.join(queries.select("query_id", "scope"), ["query_id", "scope"], "left_semi")
    weights = weights.groupBy("scope", "query_id", "blocks").agg(F.collect_list("t").alias("ts"), F.collect_list(F.col("qf") * idf("n_docs", "df")).alias("xs"))
    right = weights.select(F.col("scope").alias("scope"), spread(F.col("blocks")).alias("i"), F.pmod(F.xxhash64("query_id"), F.lit(sides)).cast("int").alias("j"), "query_id", "ts", "xs")
    schema = T.StructType([queries.schema["query_id"], passages.schema["scope"], passages.schema["passage_id"], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(posted_: pa.Table, asked_: pa.Table) -> pa.Table:
        if not (posted_.num_rows and asked_.num_rows and k > 0):
            return arrow.empty_table()
        posted_, asked_ = posted_.combine_chunks(), asked_.combine_chunks()
        ids, names = pc.unique(posted_.column("passage_id").chunk(0)), asked_.column("query_id").chunk(0)
        ids = ids.take(pc.sort_indices(ids, null_placement="at_start"))

        def spread_out(one: pa.Table, number: np.ndarray, values: str) -> tuple[np.ndarray, ...]:
            lists = one.column("ts").chunk(0)
            flat = lambda name: one.column(name).chunk(0).flatten().to_numpy(zero_copy_only=False)
            return np.repeat(number, np.diff(lists.offsets.to_numpy())), flat("ts"), flat(values)

        place = pc.index_in(posted_.column("passage_id").chunk(0), ids).to_numpy(zero_copy_only=False).astype(np.int64)
        row, own, told = best_of_tile(spread_out(posted_, place, "ws"), spread_out(asked_, np.arange(len(names)), "xs"), len(ids), len(names), k).hits()
        scope = pa.repeat(posted_.column("scope")[0], len(row))
        columns = [names.take(pa.array(row)), scope, ids.take(pa.array(own)), pa.array(told)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    # Tiles take much time for few bytes, so Spark is told into how many parts they go: joined by bytes, some tasks would have many.
    parts = min(MOST_PARTS, 2 * sides * (stats.agg(F.sum("blocks")).first()[0] or 1))
    dealt = [one.repartition(parts, "scope", "i", "j").groupBy("scope", "i", "j") for one in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(run, schema)


def retrieve(passages: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, scope, passage_id, score, rank, confidence)."""
    return ranked(best(passages, queries, k, k1, b), k).withColumn("confidence", lexical_confidence(F.col("score")))
