"""Cleaning, rolling duplicates and packing against plain Python statements of what they mean."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuewright.functions import text as tx
from cuewright.operators import cues, passages, timeline


def cue_rows(seed, videos=4, n=25, words="so we go on. and then? it goes! on and on".split()):
    pick, rows = random.Random(seed), []
    for v in range(videos):
        at = 0.0
        for i in range(n):
            text = " ".join(pick.choice(words) for _ in range(pick.randrange(1, 14)))
            last = pick.choice([0.0, 1.5, 3.25])
            rows.append((f"v{v}", i, at, at + last, text))
            at += last + pick.choice([0, 0.5])
    return rows


def overlap(sizes, first, last, budget):
    """Where the passage after units first..last may begin: with the most last units that fit the budget, or a single one of under twice it."""
    begin = min((k for k in range(first, last + 1) if sum(sizes[k : last + 1]) <= budget), default=last + 1)
    return last if begin > last and budget and sizes[last] <= 2 * budget else begin if budget else last + 1


def check_packing(sizes, runs, p):
    """Whether runs of units (first, last) are what the packing's rules allow: full, overlapping as far as they may, the last no runt."""
    length = lambda a, b: sum(sizes[a : b + 1]) + b - a
    full = lambda a, b: length(a, b) + sizes[b + 1] + 1 > p.max_chars
    fits = lambda a, b, new: length(a, b) <= p.max_chars or new == b
    new = 0  # the first unit that no passage before had
    for k, (a, b) in enumerate(runs[:-1]):
        assert a <= new <= b and full(a, b) and fits(a, b, new)
        assert runs[k + 1][0] == overlap(sizes, a, b, p.overlap_chars)
        new = b + 1
    a, b = runs[-1]
    assert b == len(sizes) - 1 and a <= new <= b
    alone = fits(a, b, new) and (len(runs) == 1 or sum(sizes[a:]) >= p.min_chars)
    joined = [m for m in range(new, b) if full(a, m) and fits(a, m, new) and sum(sizes[overlap(sizes, a, m, p.overlap_chars) :]) < p.min_chars]
    assert alone != bool(joined) or (alone and not any(full(a, m) for m in range(new, b)))


def plain_units(text, packing):
    """(start, end) of the units of a text: sentences or windows of words, cut at words where they are too long."""
    words, at = [], 0
    for w in text.split(" "):
        words.append((at, at + len(w), w))
        at += len(w) + 1
    words = [w for w in words if w[2]]
    dense = sum(text.count(c) for c in ".!?") / len(text) >= packing.punctuation_density_threshold
    ends = [k for k, w in enumerate(words) if (re.search(passages.SENTENCE_END, w[2]) if dense else k % packing.words_per_window == packing.words_per_window - 1)]
    flat = []
    for first, last in zip([0, *(e + 1 for e in ends)], [*ends, len(words) - 1]):
        piece = words[first : last + 1]
        while piece:
            fit = [w for w in piece if w[1] - piece[0][0] <= packing.max_chars] or piece[:1]
            flat.append((fit[0][0], fit[-1][1]))
            piece = piece[len(fit) :]
    return flat


@pytest.mark.parametrize("packing", [passages.Packing(160, 40, 40), passages.Packing(60, 0, 30), passages.Packing(80, 30, 70, 5, 2.0), passages.Packing(30, 20, 10, 28, 0.0)])
def test_packs_keep_the_rules(spark, packing):
    rows = cue_rows(packing.max_chars)
    line = timeline.spans(spark.createDataFrame(rows, cues.CUES))
    got = {}
    for r in passages.pack(line, packing).orderBy("video_id", "idx").collect():
        got.setdefault(r.video_id, []).append(r)
    texts = {}
    for v, _, _, _, text in rows:
        texts[v] = f"{texts[v]} {text}" if v in texts else text
    for v, text in texts.items():
        flat = plain_units(text, packing)
        begins, ends = {u[0]: k for k, u in enumerate(flat)}, {u[1]: k for k, u in enumerate(flat)}
        check_packing([b - a for a, b in flat], [(begins[r.char_start], ends[r.char_end]) for r in got[v]], packing)
        assert all(r.text == text[r.char_start : r.char_end] for r in got[v])
        assert [r.idx for r in got[v]] == list(range(len(got[v])))
        assert all(x.start_s <= x.end_s for x in got[v])
        assert all(x.start_s <= y.start_s + timeline.INSTANT for x, y in zip(got[v], got[v][1:]))


def test_fingerprint_follows_every_setting():
    base = passages.Packing()
    assert base.fingerprint() == passages.Packing().fingerprint() and len(base.fingerprint()) == 16
    assert base.fingerprint() != passages.Packing(overlap_chars=1).fingerprint()


def test_rolling_duplicates_compare_with_what_survived(spark):
    texts = ["a b c", "b c d", "d", "c d e", "E f", "x"]
    rows = [("v", i, float(i), i + 1.0, t) for i, t in enumerate(texts)] + [("w", 0, 5.0, 4.0, "x y")]
    got = sorted(tuple(r) for r in cues.drop_rolling(spark.createDataFrame(rows, cues.CUES)).collect())
    assert got == [("v", 0, 0.0, 1.0, "a b c"), ("v", 1, 1.0, 2.0, "d"), ("v", 2, 3.0, 4.0, "c d e"), ("v", 3, 4.0, 5.0, "f"), ("v", 4, 5.0, 6.0, "x"), ("w", 0, 5.0, 5.0, "x y")]


def test_clean_text(spark):
    cases = {
        ">> JOHN SMITH: hello  there": "hello there", "[Music] so (APPLAUSE)": "so", "<i>x</i> ﬁne​ now": "x fine now",
        "- - >> hi": "hi", "ＡＢ": "AB", "[music": "[music", "\n": "", "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string").select("want", tx.clean_text(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_overlap_column(spark):
    cases = [(None, "a b", "a b"), ("x a b", "A B c", "c"), ("a", "a", ""), ("", "a", "a"), ("a b", "c", "c"), (" ".join("abcdefghijklmn"), " ".join("abcdefghijklmn"), " ".join("abcdefghijklmn"))]
    df = spark.createDataFrame(cases, "b string, t string, want string").select("want", tx.without_overlap(F.col("b"), F.col("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], cues.CUES)
    assert cues.clean_transcript(none).count() == 0 and passages.passages_of(none).count() == 0


def test_new_words_against_every_overlap():
    pick = random.Random(4)
    for _ in range(3000):
        before, text = (" ".join(pick.choice("abAB") for _ in range(pick.randrange(16))) for _ in range(2))
        low, words = before.lower().split(), text.split()
        longest = max(n for n in range(13) if n <= min(len(low), len(words)) and low[len(low) - n :] == [w.lower() for w in words[:n]])
        assert cues.new_words(before, text) == (" ".join(words[longest:]) if longest else text)


def test_a_scan_holds_few_rows_as_objects(spark, monkeypatch):
    from cuewright.operators import scan

    line = [("v", i, 2.0 * i, 2.0 * i + 2, f"sentence number {i} ends here.") for i in range(300)]
    timeline_ = timeline.spans(spark.createDataFrame(line, "video_id string, idx int, start_s double, end_s double, text string"))
    want = sorted(passages.pack(timeline_).collect())
    monkeypatch.setattr(scan, "ROWS", 7)
    assert sorted(passages.pack(timeline_).collect()) == want and len(want) > 5


def test_composing_runs_python_once(spark):
    from cuewright.operators import cues

    told = spark.createDataFrame([("v", 0, 0.0, 1.0, "ﬁne ²"), ("v", 1, 1.0, 2.0, "plain"), ("v", 2, 2.0, 3.0, None), ("v", 3, 3.0, 4.0, " ")], cues.CUES)
    got = cues.clean(told)
    assert [(r.idx, r.text) for r in got.orderBy("idx").collect()] == [(0, "fine 2"), (1, "plain")]
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
