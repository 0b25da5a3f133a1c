"""Clustered search, fill-in-the-middle and pivot search against plain statements of their rules, on odd rows and small sizes."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import bisection, clustered_search, fim, pivot_search
from cuewright.llm.queries import QUERIES
from test_operators import ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def best_documents(docs, items, k):
    held = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for d, t in held:
            m = 10 + 90 * len(t) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in set(terms(text)) & set(t))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def some_texts(n, seed):
    rng = random.Random(seed)
    topics = [[f"{w}{i}" for i in range(40)] for w in ("sea", "Stern", "été", "日本")]
    return [(i, " ".join(rng.choice(rng.choice(topics) if rng.random() < 0.2 else topics[i % 4]) for _ in range(rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("cluster,block", [(4, 1 << 20), (512, 1 << 20), (16, 1)])
def test_clustered_search(spark, cluster, block):
    docs = some_texts(300, 1) + ODD + [(7, "sea1 sea2 sea3"), (8, "sea1 sea2 sea3"), (None, "sea1 sea2 sea3")] * 3
    items = [(1, "sea1 SEA2, sea3!"), (2, "stern4 hello World"), (3, None), (4, "..."), (None, "日本1 日本2 sea1"), (6, "words that nobody has"), (1, "Lange sea1 Rede"), (7, "f0 é ﬁ")]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, terms string, leaf int").repartition(5)
    index = clustered_search.build(frame, cluster=cluster)
    found = clustered_search.search(index, spark.createDataFrame(items, "item_id long, text string"), 10, block_bytes=block)
    key = repr
    assert sorted(map(tuple, found.collect()), key=key) == sorted(best_documents(docs, items, 10), key=key)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_clustered_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert clustered_search.search(clustered_search.build(none), items).count() == 0
    assert clustered_search.search(clustered_search.build(some), items.limit(0)).count() == 0
    assert clustered_search.search(clustered_search.build(some), items, 0).count() == 0
    assert [tuple(r) for r in clustered_search.search(clustered_search.build(some), items).collect()] == best_documents([(1, "a b")], [(1, "a")], 10)


def test_bisection_keeps_topics_together():
    rng = np.random.default_rng(0)
    topic = rng.permutation(np.arange(256) % 4)
    lists = [rng.choice(50, 12, replace=False) + 50 * t for t in topic]
    held = bisection.Postings(np.arange(257) * 12, np.concatenate(lists), 200)
    line = bisection.order(held, np.arange(256), 64)
    assert sorted(line.tolist()) == list(range(256))
    assert all((np.bincount(topic[line[i : i + 64]]) / 64).max() > 0.9 for i in range(0, 256, 64))
    tree = bisection.Tree(held, 2)
    leaves = tree.leaves(held.terms, np.repeat(np.arange(256), 12), 256)
    assert sum(np.bincount(topic[leaves == x]).max() for x in np.unique(leaves)) > 0.9 * 256


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(3)
    docs = [*ODD, *ODD[:3], (70, "a <P> b"), (71, "<S>"), (72, "x<M>"), (73, "< P> <P <S M>")]
    docs += [(100 + i, "".join(rng.choice(["a", " ", "\t", "\n", "<", "P>", "S>", "<M", "é", "😀", " ", "\x1f"]) for _ in range(rng.randrange(40)))) for i in range(300)]
    frame = spark.createDataFrame([(d, t, 1, "o") for d, t in docs], "doc_id long, text string, n int, output string")
    made = fim.rearrange(frame)
    found = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(((d, t, *plain_fim(d, t), t or "") for d, t in docs), key=repr)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.rearrange(frame.limit(0)).count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def nearest(rows, queries, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(x)) for x in v]

    held = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    asked = {}
    for i, v in queries:
        if i is not None and (w := whole(v)) is not None:
            asked[i] = min(asked.get(i, w), w)
    out = []
    for q, w in asked.items():
        best = sorted((-sum(a * b for a, b in zip(w, x)), i) for i, x in held if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block,rows", [(1 << 24, 1200), (600, 300)])
def test_pivot_search(spark, block, rows, monkeypatch):
    monkeypatch.setattr(pivot_search, "SAMPLE", 100)
    monkeypatch.setattr(pivot_search, "WAVES", (2, 8))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    data = [(i, (centres[i % 12] + rng.normal(size=8) * 0.05).tolist()) for i in range(rows)]
    data += [(5000 + i, data[0][1]) for i in range(200)] + [(50, data[50][1])] * 2  # one vector of very many rows, a repeated row
    data += [(2001, None), (2002, [None] * 8), (2003, [float("nan")] + [0.0] * 7), (2004, [float("inf")] * 8), (None, [1.0] * 8), (2006, []), (2007, [1.0]), (2008, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, None) for i, v in data], "vec_id long, embedding array<double>, far int, cell int").repartition(3)
    found = pivot_search.exact_top_k(frame, frame.filter("vec_id % 50 = 0"), 5, block_bytes=block)
    assert sorted(map(tuple, found.collect())) == nearest(data, [x for x in data if x[0] is not None and x[0] % 50 == 0], 5)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_pivot_search_of_long_vectors_and_nothing(spark):
    data = [(i, [float(10 ** (i % 7)) * (-1) ** (i // 7), 3.0, 123456.789 * i]) for i in range(60)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = pivot_search.exact_top_k(frame, frame.filter("vec_id % 5 = 0"), 3)
    assert sorted(map(tuple, found.collect())) == nearest(data, [x for x in data if x[0] % 5 == 0], 3)
    assert pivot_search.exact_top_k(frame.limit(0), frame, 3).count() == 0
    assert pivot_search.exact_top_k(frame, frame.limit(0), 3).count() == 0
    assert pivot_search.exact_top_k(frame, frame, 0).count() == 0
    assert pivot_search.exact_top_k(frame.limit(1), frame.limit(1), 3).count() == 0


def test_bounds_leave_out_far_clusters():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 32)) * 4
    x = np.floor(256 * np.concatenate([c + rng.normal(size=(64, 32)) * 0.01 for c in centres])).astype(np.int64)
    pivots = pivot_search.choose_pivots(x[::8], 32)
    own = pivot_search.Block(np.arange(0, len(x), 64), x[::64], pivots, np.arange(0, len(x), 3), x[::3], 5)
    best = pivot_search.Best(own.floor, 5)
    looked = []
    products = pivot_search.products
    pivot_search.products = lambda a, b: looked.append(len(a) * len(b)) or products(a, b)
    try:
        far = np.floor(pivot_search.distances(x, pivots)).astype(np.int64)
        for i in range(0, len(x), 64):
            own.search(np.arange(i, i + 64), x[i : i + 64], far[i : i + 64], best)
    finally:
        pivot_search.products = products
    assert sum(looked) < 0.25 * 16 * len(x)


@pytest.mark.parametrize("name", ["op11_clustered_search", "op12_fill_in_middle", "op13_pivot_search"])
def test_names(name):
    assert name in QUERIES
