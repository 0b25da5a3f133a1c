"""Clusters of more texts than a tile holds: every link is found, and a text is not a row for every part of its cluster."""

import random

import pytest

from cuewright.llm import near_copies

DOCS = "doc_id long, text string"


def variants(n, edits, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        own = base[:]
        for k in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"x{i}y{k}"
        out.append(" ".join(own))
    return out


def plain_classes(texts):
    sets = [frozenset(" ".join(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("tile", [6, 20])
def test_clusters_of_several_parts(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "CLUSTER_TILE", tile)
    texts = variants(70, 4, 1) + variants(40, 1, 2) + [f"alone {i} " * 20 for i in range(10)]
    want = plain_classes(texts)
    rows = near_copies.classes(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    by = {r.id: r.root for r in rows}
    assert len(set(want)) > 10 and len(rows) == len(texts)
    pairs = lambda of: {(i, j) for i in range(len(texts)) for j in range(i) if of[i] == of[j]}
    found, true = pairs(by), pairs(want)
    assert found <= true and len(found) >= 0.99 * len(true)  # what wide fingerprints do not gather is not compared


def test_rows_of_one_template_grow_with_its_texts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CLUSTER_TILE", 16)
    compared, seen = near_copies._compared, []
    monkeypatch.setattr(near_copies, "_compared", lambda placed: seen.append(placed.count()) or compared(placed))
    share = []
    for n in (64, 512):
        seen.clear()
        rows = near_copies.classes(spark.createDataFrame(list(enumerate(variants(n, 1, n))), DOCS)).collect()
        assert len({r.root for r in rows}) == 1
        share.append(sum(seen) / n)
    assert max(share) <= 3


def test_vantage_trees_gather_close_copies(spark, monkeypatch):
    """The trees alone find what differs in a word of many; shingle sets decide, whatever has gathered two texts."""
    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts + [t + " end" for t in texts])), DOCS)
    monkeypatch.setattr(near_copies, "close_links", lambda distinct, n: spark.createDataFrame([], "a long, b long"))
    by = {}
    for r in near_copies.classes(docs).collect():
        by.setdefault(r.root, set()).add(r.id)
    pairs = [ids for ids in by.values() if len(ids) > 1]
    assert len(pairs) >= 27 and all(ids == {min(ids), min(ids) + 30} for ids in pairs)
