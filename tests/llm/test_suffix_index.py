"""Suffix-array deduplication against counting every 200-byte string."""

import hashlib
import random
from collections import Counter

import pytest

from cuewright.llm import suffix_index
from cuewright.llm.suffixes import WINDOW


def brute(texts):
    """(n_removed, spans, kept) of each text, by looking at every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + WINDOW] for r in raw for i in range(len(r) - WINDOW + 1))
    out = []
    for r in raw:
        marks = bytearray(len(r))
        for i in range(len(r) - WINDOW + 1):
            if seen[r[i : i + WINDOW]] > 1:
                marks[i : i + WINDOW] = b"\1" * WINDOW
        spans, i = 0, 0
        spans = sum(1 for i, m in enumerate(marks) if m and not (i and marks[i - 1]))
        out.append((len(r), sum(marks), spans, hashlib.sha256(bytes(b for b, m in zip(r, marks) if not m)).hexdigest()))
    return out


def run(spark, texts, **more):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    got = suffix_index.remove_repeats(docs, "n_bytes", removed.alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("k"), **more)
    return [tuple(r)[1:] for r in sorted(got.collect())]


def corpus(seed, n=60):
    pick = random.Random(seed)
    line = lambda size: "".join(pick.choice("abcdefgé ") for _ in range(size))
    shared = [line(s) for s in (199, 200, 201, 260, 700, 3000)]
    texts = []
    for _ in range(n):
        parts = [pick.choice(shared)[pick.randrange(60) : None] if pick.random() < 0.5 else line(pick.randrange(300)) for _ in range(pick.randrange(5))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_matches_counting_all_windows(spark, batches):
    texts = [*corpus(batches), None, "", "x" * 1000, "ab" * 300, "x" * 150]
    texts += [texts[0], texts[5], texts[5]]
    assert run(spark, texts, batches=batches) == brute(texts)


def test_many_surroundings_of_one_passage(spark):
    pick = random.Random(4)
    passage = "".join(pick.choice("abcdefgh") for _ in range(260))
    texts = ["".join(pick.choice("uvwxyz") for _ in range(250)) + passage[k % 40 :] + "".join(pick.choice("uvwxyz") for _ in range(250)) for k in range(3 * suffix_index.GROUP)]
    assert run(spark, texts) == brute(texts)


def test_empty_table_and_extra_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_index.remove_repeats(none).collect() == []
    odd = spark.createDataFrame([(None, "q" * 300, "z", 1), (None, "q" * 300, "y", 2)], "doc_id long, text string, blob string, n int")
    got = suffix_index.remove_repeats(odd).collect()
    assert [(r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got] == [(300, [(0, 300)], b"")] * 2


def test_registered_query_on_documents(spark):
    from compare import FOLDER

    from cuewright.llm.queries import QUERIES

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in QUERIES["op1_suffix_dedup"](spark, FOLDER).collect())
    assert got == [(d, *b) for (d, _), b in zip(rows, brute([t for _, t in rows]))]


def folder_of(spark):
    from pathlib import Path

    return Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))


def test_no_table_but_the_result_is_left(spark):
    before, tables = set(folder_of(spark).iterdir()), spark.catalog.listTables()
    texts = corpus(8)
    run(spark, texts)
    left = {p.name.split("-")[0] for p in set(folder_of(spark).iterdir()) - before}
    assert left == {"cut"} and spark.catalog.listTables() == tables


def test_live_index_tells_what_a_new_batch_repeats(spark):
    pick = random.Random(11)
    line = lambda size: "".join(pick.choice("abcdefgh ") for _ in range(size))
    shared, index = line(600), suffix_index.SuffixIndex()
    frame = lambda texts: suffix_index.blobs_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    batches = [[line(500) + shared], [line(900)], [shared + line(300), line(400)], [line(700)], [shared[100:400]]]
    found = [index.add(frame(b)).select("blob").distinct().count() for b in batches]
    assert found == [0, 0, 1, 0, 1] and [size for size, _ in index.levels] == [2, 0]
    index.close()


def test_long_unbroken_texts(spark):
    texts = ["ab" * 150_000, "".join(chr(97 + (i * i * 7 + i // 9) % 26) for i in range(3000)), "x" * 200_000]
    got = run(spark, texts)
    assert [g[1:3] for g in (got[0], got[2])] == [(300_000, 1), (200_000, 1)] and got[1] == brute(texts[1:2])[0]
