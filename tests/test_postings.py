"""The kept index against search over the passages themselves."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from cuewright.operators import lexical
from cuewright.plans import fixtures as fx
from cuewright.shared import scratch_folder
from cuewright.sources import postings
from cuewright.sources.postings import PostingIndex
from compare import FOLDER

PASSAGES = "scope string, passage_id long, text string"


def some(n, seed, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(rng.choice(["hot", "hot", "hot", "small", None]), first + i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.select("query_id", "scope", "passage_id", "score", "rank").collect()), key=repr)


def test_batches_add_up(spark):
    first, second = some(400, 1) + [("hot", 9000, None), ("empty", 9001, "")], some(300, 2, 1000) + [("late", 9002, "w1 w2 w1")]
    own = PostingIndex(spark, scratch_folder(spark), 4, 16)
    queries = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w59"), (3, "nothing of it"), (4, None), (5, " ".join(f"w{i}" for i in range(60)))], "query_id long, text string")
    assert own.top_k(queries, 3).count() == 0
    seen = []
    for batch in (first, second):
        before = own.files.version()
        own.add(spark.createDataFrame(batch, PASSAGES))
        after = own.files.version()
        assert all(after.of(name)[piece] == parts for name in before.tables for piece, parts in before.of(name).items())  # nothing old is written anew
        seen += batch
        for k in (1, 3, 1000):
            named = [(s or "none", i, t) for s, i, t in seen]
            want = lexical.retrieve(spark.createDataFrame(named, PASSAGES), queries, k)
            got = own.top_k(queries, k).withColumn("scope", F.coalesce("scope", F.lit("none")))
            assert rows(got) == rows(want)
    bound = spark.createDataFrame([(1, "w1 w2", "hot"), (2, "w1", "late")], "query_id long, text string, scope string")
    assert rows(own.top_k(bound, 5)) == rows(lexical.retrieve(spark.createDataFrame(seen, PASSAGES).filter("scope IS NOT NULL"), bound, 5))


def test_cells_with_equal_bounds(spark, monkeypatch):
    """Copies give cells one bound; which of them is scored first must not depend on the order of rows, which no reading keeps."""
    copies = spark.createDataFrame([("hot", i, "w1 w2 w3") for i in range(300)], PASSAGES)
    own = PostingIndex(spark, scratch_folder(spark), 4, 8)
    own.add(copies)
    queries = spark.createDataFrame([(i, "w1 w2") for i in range(12)], "query_id long, text string")
    whole = postings.materialize

    def mixed(batches):
        for batch in batches:
            yield batch.take(random.sample(range(batch.num_rows), batch.num_rows))

    monkeypatch.setattr(postings, "materialize", lambda df: whole(df).mapInArrow(mixed, df.schema))
    assert rows(own.top_k(queries, 5)) == rows(lexical.retrieve(copies, queries, 5))


def test_documents_are_not_read_at_query_time(spark):
    own = PostingIndex(spark, scratch_folder(spark))
    own.add(fx.passages(spark, FOLDER))
    plan = own.top_k(fx.questions(spark, FOLDER), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "text" not in plan


def test_texts_are_dealt_by_cell_and_not_by_scope(spark, monkeypatch):
    """Texts of one scope would all go to one task; they go once, to the task of their cell, and no row of a term is shuffled before its block is made."""
    plans, whole = [], postings.materialize
    monkeypatch.setattr(postings, "materialize", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), whole(df))[1])
    PostingIndex(spark, scratch_folder(spark)).add(spark.createDataFrame(some(300, 4), PASSAGES))
    made = [p for p in plans if "regexp_extract_all" in p]
    assert len(made) == 1 and made[0].count("hashpartitioning(") == 1 and "hashpartitioning(cell" in made[0]


def test_blocks_of_batches_cut_anywhere(monkeypatch):
    rng, words = random.Random(5), [f"w{i}" for i in range(9)]
    lines = [(c, None if n == 0 else n // 2, [rng.choice(words) for _ in range(rng.randrange(6))]) for c in range(7) for n in range(40)]
    want = Counter()
    for cell, passage, terms in lines:
        for term in ["", *terms]:
            want[cell, term, passage, len(terms)] += 1
    schema = pa.schema([("scope", pa.string()), ("cell", pa.int64()), ("passage_id", pa.int64()), ("terms", pa.list_(pa.string()))])
    table = pa.Table.from_pylist([{"scope": f"s{c}" if c else None, "cell": c, "passage_id": p, "terms": t} for c, p, t in lines], schema)
    for size, most in ((7, 1), (1000, 1), (11, 150), (1000, 1 << 20)):
        monkeypatch.setattr(postings, "BLOCK_TERMS", most)
        blocks = [r for b in postings._blocks(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert len({(r["cell"], r["term"]) for r in blocks}) == len(blocks)
        assert {(r["cell"], r["term"], i, n): f for r in blocks for i, f, n in zip(r["ids"], r["tfs"], r["lens"])} == want
        assert all(r["n"] == len(r["ids"]) and r["max_tf"] == max(r["tfs"]) and r["min_len"] == min(r["lens"]) and r["scope"] == (f"s{r['cell']}" if r["cell"] else None) for r in blocks)
