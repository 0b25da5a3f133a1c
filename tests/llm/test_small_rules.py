"""Rules of single operators: rule versions of the ledger, validators of revisits, bounds of samples and memories."""

import random
from dataclasses import replace

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cuewright.llm import bpe, langid, quality, revisits, secret_scan

DOCS = "doc_id long, text string"
CAPTURES = "capture_id long, url string, time long, kind string, etag string, last_modified string, headers map<string,string>"


def spans(paths):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in paths.collect()}


def test_newer_rule_versions_replace_findings(spark):
    rows = spark.createDataFrame([(1, "a AKIA" + "B" * 16), (2, "ghp_" + "z" * 36 + " AKIA" + "B" * 16)], DOCS)
    _, known, ledger = secret_scan.scan_versions(rows)
    rules = secret_scan.RULES
    newer = (secret_scan.Rule("extra", "(a )", 1), *(replace(r, version=2) if r.kind == "access" else r for r in rules))
    assert secret_scan.unseen(rows.select("doc_id", secret_scan.content_address(F.col("text")).alias("blob"), "text"), ledger, newer).filter("size(todo) <> 2").count() == 0
    paths, findings, after = secret_scan.scan_versions(rows, ledger, known, newer)
    assert spans(paths) == {1: [("extra", 0, 2), ("access", 2, 22)], 2: [("github", 0, 40), ("access", 41, 61)]}
    assert findings.count() == 4 and {r.rule for r in findings.collect()} == {"extra/1", "access/2", "github/1"}
    again, _, _ = secret_scan.scan_versions(rows, after, findings, newer)
    assert spans(again) == spans(paths)


def test_generations_equal_one_scan(spark):
    pick = random.Random(2)
    parts = ["AKIA" + "Q" * 16, "token: abcdefghij", "0123456789abcdef" * 2, "plain words", "xoxb-1234567890", ""]
    rows = spark.createDataFrame([(i, " ".join(pick.choice(parts) for _ in range(pick.randrange(6)))) for i in range(60)] + [(None, None)], DOCS)
    one, _, _ = secret_scan.scan_versions(rows)
    assert spans(secret_scan.scan_generations([rows.filter("doc_id % 3 = 0"), rows.filter("doc_id % 2 = 0"), rows])) == spans(one)


def test_etags_come_before_dates_and_compare_weakly(spark):
    rows = [(1, "a.com", 1, "response", 'W/"x"', "m1", {}), (2, "a.com", 2, "revisit", '"x"', "m2", {}), (3, "a.com", 3, "revisit", '"y"', "m1", {}), (4, "a.com", 4, "revisit", None, "m1", {}), (5, "a.com", 5, "revisit", None, "m2", {}), (6, "a.com", 6, "revisit", None, None, {})]
    got = {r.capture_id: r.verdict for r in revisits.resolve(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert got == {2: "match", 3: "changed", 4: "match", 5: "changed", 6: "unproven"}


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_revisits_against_looking_at_every_response(spark, ranges):
    pick = random.Random(ranges)
    rows = [(k, pick.choice(["a.com", "b.com/x", "https://www.a.com/", None]), pick.choice([None, *range(30)]) if k % 3 else 7, pick.choice(["response", "revisit"]), pick.choice(["e", "f", None]), None, {"k": str(k)}) for k in range(400)]
    rows += rows[:20]
    frame = spark.createDataFrame(rows, CAPTURES).withColumns({"part": F.lit("x"), "at": F.lit(1), "near": F.lit(2), "canonical_url": F.lit("clash")})
    host = lambda u: u and u.replace("https://www.", "").rstrip("/")
    want = []
    for k, url, time, kind, *_ in rows:
        if kind == "revisit":
            held = [(t, i) for i, u, t, c, *_ in rows if c == "response" and u and host(u) == host(url) and t is not None and time is not None and t < time]
            want.append((k, max(held)[1] if held else None))
    got = [(r.capture_id, r.refers_to) for r in revisits.resolve(frame, ranges).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_labelled_texts_teach_by_blocks_from_all_over(spark):
    pick = random.Random(6)
    words = [["".join(pick.choice(letters) for _ in range(6)) for _ in range(300)] for letters in ("qzxkvjwy", "aeioumnrst")]
    say = lambda y, n: " ".join(pick.choice(words[y]) for _ in range(n))
    docs = spark.createDataFrame([(i, "." * 40_000 + say(i % 2, 20_000)) for i in range(24)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    probe = spark.createDataFrame([(1, say(1, 200)), (2, say(0, 200))], DOCS)
    score = {r.doc_id: r.quality_score for r in quality.score_quality(probe, model).collect()}
    assert score[1] > score[2]


def test_samples_stay_bounded_when_ids_are_null(spark):
    rows = spark.createDataFrame([(None, f"text number {i}", "en" if i % 2 else "de") for i in range(2000)], DOCS + ", lang string")
    drawn, counts = langid._draw(rows, ["doc_id", "text"], "lang", 50)
    assert 40 <= drawn.count() <= 200 and counts == {"en": 1000, "de": 1000}


def test_long_pieces_are_not_remembered():
    codec, memo = bpe.load_codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), bpe.Memo()
    ids, counts = codec.encode(["qz" * 5000 + " zxqv"], memo)
    raw, _ = codec.decode(ids, counts)
    assert bytes(raw) == b"qz" * 5000 + b" zxqv" and set(memo.young) == {" zxqv"}
    with pytest.raises(ValueError, match="2\\^20"):
        bpe.Codec({bytes([b]): b for b in range(256)} | {b"ab": 1 << 20}, P.PATTERN)


def test_svm_separates():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(400, 8)).astype(np.float32)
    y = np.where(x[:, 0] + x[:, 1] > 0, 1, -1)
    w = langid.fit_svm(x, y, np.ones(400))
    assert w.dtype == np.float32 and (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.95
