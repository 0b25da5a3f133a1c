"""op7 and op10 against the same fitted models applied text by text in plain Python; what op3 and the pipeline leave behind; op4's recall and memory."""

import math
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
import zstandard
from compare import FOLDER
from pyspark.sql import functions as F

from cuewright.llm import decontaminate, langid, quality, queries
from test_leaks_everywhere import align, words

SPLIT = lambda i, n: zlib.crc32(str(i).encode()) % n


def rows(spark, name, *columns):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()


def plain_features(text):
    line = [c if c >= 128 else c | 32 if chr(c).isalpha() else 32 for c in b" " + text.encode() + b" "]
    counts = {}
    for a, b, c in zip(line, line[1:], line[2:]):
        if (a, b) != (32, 32):
            bucket = ((a << 16 | b << 8 | c) * 0x9E3779B1 % (1 << 32)) >> 21
            counts[bucket] = counts.get(bucket, 0) + 1
    total = sum(counts.values())
    return {k: math.sqrt(n / total) for k, n in counts.items()}


def test_language_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs.filter(queries.bucket_of("doc_id", 4) != 2))
    families = max(model.family.values()) + 1
    margin = lambda f, k: sum(v * float(model.weights[b, k]) for b, v in f.items()) + float(model.weights[-1, k])
    logistic = lambda x: 1 / (1 + math.exp(-3 * x))
    got = {r.doc_id: r for r in queries.QUERIES["op7_language_identification"](spark, FOLDER).collect()}
    agreed = 0
    for doc_id, text in rows(spark, "documents", "doc_id", "text"):
        assert got[doc_id].held_out == (SPLIT(doc_id, 4) == 2)
        if not text or not any(c.isalpha() for c in text):
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
            continue
        f = plain_features(text)
        own = [margin(f, k) for k in range(families)]
        family = max(range(families), key=own.__getitem__)
        votes = {lang: [0, 0.0] for lang in model.languages if model.family[lang] == family}
        duels = []
        for k, (a, b) in enumerate(model.pairs):
            if model.family[a] == family:
                m = margin(f, families + k)
                votes[a if m > 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
                duels.append((a, b, m))
        best = max(votes, key=votes.get)
        close = min((m if a == best else -m for a, b, m in duels if best in (a, b)), default=9.0)
        want = (logistic(own[family]) if families > 1 else 1.0) * logistic(close)
        agreed += got[doc_id].lang_pred == best and abs(got[doc_id].score - want) < 1e-4
    assert agreed == sum(bool(r.text) and any(c.isalpha() for c in r.text) for r in rows(spark, "documents", "text"))


def test_quality_one_by_one(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    learn = queries.bucket_of("doc_id", 5) != 0
    model = quality.fit(docs.select("doc_id", "text").filter(learn), labels.filter(learn))
    got = {r.doc_id: r for r in queries.QUERIES["op10_compression_quality"](spark, FOLDER).collect()}

    def size(raw, text):
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(packer.compress(text[i : i + 4096])) for i in range(0, len(text), 4096))

    for doc_id, text in rows(spark, "documents", "doc_id", "text"):
        raw = (text or "").encode()
        good, bad = size(model.good, raw), size(model.bad, raw)
        x = (bad - good) / (bad + good) if good + bad else 0.0
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x / model.scale + model.offset))))
        assert got[doc_id].score == pytest.approx(want, abs=1e-9)
        assert got[doc_id].predicted == int(want >= 0.3) and got[doc_id].held_out == (SPLIT(doc_id, 5) == 0)


def test_every_alignment_of_every_pair_is_found(spark):
    """Recall without the rule that three words in a row are shared: every document aligned with every item."""
    items = [(r.item_id, words(r.text)) for r in rows(spark, "benchmark", "item_id", "text")]
    held = [(r.doc_id, words(r.text)) for r in rows(spark, "documents", "doc_id", "text")]
    want = {(d, i) for d, w in held for i, v in items if v and len(set(v) & set(w)) >= 0.2 * len(set(v)) and align(v, w) >= decontaminate.LEAK}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_benchmark_leaks"](spark, FOLDER).collect()}
    assert want == got


def test_a_seed_of_many_items_and_places_takes_little_memory():
    texts = [decontaminate.words_of([f"one of the item{i} a{i} b{i} c{i} d{i} e{i}".encode()])[0] for i in range(5000)]
    items = decontaminate.Items.of(list(range(5000)), texts, 3)
    text = decontaminate.words_of([b"one of the x " * 5000 + b"one of the item7 a7 b7 c7 d7 e7"])[0]
    tracemalloc.start()
    found = items.leaks(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[:2] for x in found] == [(7, 1.0)] and peak < 64 << 20


def left_by(spark, run):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    run()
    return sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before)


def test_what_secret_scans_leave(spark):
    assert left_by(spark, lambda: queries.QUERIES["op3_secret_ledger"](spark, FOLDER).count()) == ["findings"]


def test_what_the_pipeline_leaves(spark):
    import corpus_pipeline

    assert left_by(spark, lambda: corpus_pipeline.run(spark, FOLDER).count()) == ["first", "personal_data"]
