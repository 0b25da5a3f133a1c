"""op4 against aligning every document with every item, passes, scripts and repetitions."""

import random
import re
import unicodedata

import numpy as np
import pytest
from compare import FOLDER
from pyspark.sql import functions as F

from cuewright.llm import decontaminate
from cuewright.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def align(a, b):
    """Score of the best local alignment, cell by cell along diagonals' rows."""
    known = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([known[w] for w in a]), np.array([known[w] for w in b])
    best, row, far = 0, np.zeros(len(y) + 1, int), np.arange(len(y) + 1)
    for w in x:
        new = np.maximum(0, np.maximum(np.append(0, row[:-1] + np.where(y == w, 2, -1)), row - 1))
        row = np.maximum(new, np.maximum.accumulate(new + far) - far)
        best = max(best, int(row.max()))
    return best / (2 * max(1, len(a)))


def words(text):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text or "").lower())


def grams(w, n=3):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def every_pair(docs, items):
    """Pairs that share words in a row, aligned over the whole text."""
    held = {i: (w, min(3, len(w)), grams(w, min(3, len(w)))) for i, t in items if (w := words(t))}
    out = {}
    for d, t in docs:
        w = words(t)
        own = {n: grams(w, n) for n in (1, 2, 3)}
        for i, (v, n, g) in held.items():
            if g & own[n] and (s := align(v, w)) >= decontaminate.LEAK:
                out[d, i] = s
    return out


def test_query_against_every_pair(spark):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(key, "text").collect()]
    want = every_pair(read("documents", "doc_id"), read("benchmark", "item_id"))
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op4_benchmark_leaks"](spark, FOLDER).collect()}
    assert want and got == pytest.approx(want)


@pytest.mark.parametrize("pass_words", [10, 60, 10**6])
def test_passes_and_random_edits_against_every_pair(spark, pass_words):
    pick = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    say = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(pick.choice([1, 2, 3, 8, 25])))) for i in range(25)]

    def edited(w):
        return [x for y in w for x in ([] if pick.random() < 0.12 else [y] if pick.random() < 0.8 else [y, *say(pick.randrange(3))])]

    docs = [(d, " ".join(say(pick.randrange(30)) + edited(pick.choice(items)[1].split()) + say(pick.randrange(30)))) for d in range(80)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"leaks": F.lit("clash"), "item_id": F.lit("clash")})
    found = decontaminate.find_leaks(df, spark.createDataFrame(items + [(77, None), (78, "!")], "item_id long, text string"), pass_words=pass_words)
    assert found.columns == ["doc_id", "text", "item_id", "leaks"] and found.count() == len(docs)
    assert {(r.doc_id, x.item_id): x.score for r in found.collect() for x in r.leaks} == pytest.approx(every_pair(docs, items))


def test_scripts_cases_and_quotes(spark):
    items = [(1, "“Ποιος είναι ο νέος άνθρωπος εδώ”"), (2, "Где находится новый большой город"), (3, "l’été était très chaud à Paris"), (4, "naïve café über alles im Land")]
    docs = [(1, "x ΠΟΙΟΣ ΕΊΝΑΙ Ο ΝΈΟΣ ΆΝΘΡΩΠΟΣ ΕΔΏ y"), (2, "‘ГДЕ НАХОДИТСЯ НОВЫЙ’ большой «город»…"), (3, "L'ÉTÉ ÉTAIT TRÈS CHAUD À PARIS"), (4, "NAÏVE CAFÉ ÜBER ALLES IM LAND"), (5, "nothing of the kind")]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, x.item_id) for r in found.collect() for x in r.leaks if x.score > 0.8} == {(k, k) for k in (1, 2, 3, 4)}


def test_no_items_and_repetitive_items(spark):
    df = spark.createDataFrame([(1, "a " * 60_000), (2, "b c " * 10_000 + "a a a")], DOCS)
    none = decontaminate.find_leaks(df, spark.createDataFrame([], "item_id long, text string"))
    assert [r.leaks for r in none.collect()] == [[], []]
    found = decontaminate.find_leaks(df, spark.createDataFrame([(1, "a " * 400)], "item_id long, text string"))
    assert {r.doc_id: [x.score for x in r.leaks] for r in found.collect()} == {1: [1.0], 2: []}
