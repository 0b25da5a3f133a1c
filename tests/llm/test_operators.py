"""The other operators against brute force, SQL, a reference encoder or held-out labels; and on nulls, empty texts, ties and empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from compare import FOLDER, assert_same
from pyspark.sql import functions as F

from cuewright.llm import bpe, decontaminate, langid, merkle, near_copies, pii, quality, revisits, secret_scan, simhash_vp
from cuewright.llm.queries import ORACLES, QUERIES
from test_leaks_everywhere import every_pair

DOCS = "doc_id long, text string"
LONG = "Die lange Rede ist kurz. " * 20_000
ODD = [(1, None), (2, ""), (3, "\n \t"), (4, "é"), (5, "Hello world again and again my friend"), (6, "Hello world again and again my friend"), (None, "mail me: a.b@c.org or +1 (202) 555-0100"), (7, "😀 4111 1111 1111 1111 ﬁ"), (8, LONG), (90, "f0" * 100_000 + "@."), (91, "漢字" * 40_000), (92, "1." * 20_000 + "\x00\x01 ;.")]


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in table(spark, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), ORACLES[name])


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def components(prints):
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in prints}


def test_simhash_links_all_close_pairs(spark):
    prints = {d: fingerprint(t) for d, t in texts_of(spark).items()}
    near = components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op6_simhash_near_duplicates"](spark, FOLDER).collect()}
    assert got == {d: (prints[d], near[d]) for d in prints}


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 5, 6])
def test_vantage_trees_prune_no_pair(spark, blocks, monkeypatch):
    monkeypatch.setattr(simhash_vp, "SHARD", 20)
    monkeypatch.setattr(simhash_vp, "TILE", 40)
    pick = random.Random(blocks)
    base = [pick.getrandbits(64) for _ in range(120)]
    points = {b ^ sum(1 << k for k in pick.sample(range(64), pick.randrange(7))) for b in base for _ in range(4)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash_vp.links(spark.createDataFrame([(signed(p),) for p in points], "fp long"), len(points), blocks=blocks).collect()
    root = {signed(p): signed(p) for p in points}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in found:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = components({signed(p): p for p in points})
    # The same partition: neither a lost link nor one between points that no chain of close ones connects.
    own, true = {}, {}
    for p in root:
        own.setdefault(find(p), set()).add(p)
        true.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, true.values()))


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_trees_send_visitors_to_the_leaves_of_close_points(radius):
    pick = np.random.default_rng(radius)
    points = pick.integers(0, 1 << 63, 4000, np.uint64)
    tree = simhash_vp.VantageTree(points[:2000], (1 << 21) - 1, 6)
    home = dict(zip(*map(np.ndarray.tolist, tree.shards(points, 0))))
    assert len(home) == len(points) and len(set(home.values())) > 32
    near = points.copy()
    for _ in range(radius):
        near ^= np.uint64(1) << pick.integers(0, 21, len(points), np.uint64)
    rows, leaves = tree.shards(near, radius)
    assert set(home.items()) <= set(zip(rows.tolist(), leaves.tolist()))
    assert len(rows) < len(points) * 64 * (0.02, 0.25, 0.5)[radius]


def test_wide_fingerprints_find_similar_texts():
    """Of random pairs at a similarity of 0.8 to 1 at least nine in ten share a leaf within the radius, for a small and a large corpus."""
    pick, agreed = random.Random(9), {n: 0 for n in (1000, 10**6, 10**8)}
    for _ in range(200):
        words = [f"w{pick.randrange(10**6)}" for _ in range(pick.randrange(60, 400))]
        other = list(words)
        while True:
            edited = list(other)
            edited[pick.randrange(len(edited))] = f"e{pick.random()}"
            a, b = (near_copies.shingles(" ".join(w).encode()) for w in (words, edited))
            if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.8 or pick.random() < 0.03:
                break
            other = edited
        a, b = (np.unpackbits(np.frombuffer(near_copies.wide_simhash(near_copies.shingles(" ".join(w).encode())), np.uint8)) for w in (words, other))
        for n in agreed:
            agreed[n] += bool((a != b).sum() <= near_copies.RADIUS and any((a[p] == b[p]).all() for p in near_copies.projections(n)))
    assert min(agreed.values()) >= 180


def test_keep_one_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "other words stand here now"), (None, "lonely"), (4, None), (5, "")]
    got = simhash_vp.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "lonely"), (1, "a b c d e f"), (2, "other words stand here now"), (4, "")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_pii(text):
    spans = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    for i, (kind, pattern, good) in enumerate(rules):
        spans += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if good(m[0])]
    return [s[2] for s in sorted(spans)]


def test_personal_data_base_spans(spark):
    texts = texts_of(spark)
    for r in QUERIES["op8_personal_data"](spark, FOLDER).collect():
        want = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in ("email", "ip", "card", "phone")]


def test_personal_data_checks_and_context():
    kinds = lambda t: [(k, s) for k, _, _, s, _ in pii.find(t)]
    assert [k for k, _ in kinds("IBAN GB82 WEST 1234 5698 7654 32 ok")] == ["iban"] and not kinds("XX82 WEST 1234 5698 7654 32")
    assert kinds("4111 1111 1111 1112") == [] and kinds("visa 4111 1111 1111 1111")[0][1] > kinds("4111 1111 1111 1111")[0][1]
    assert pii.redact("x a@b.co y") == "x <email> y"


@pytest.mark.parametrize("after", [" BIC COBADEFFXXX", " 00 EUR 50", " 12 May", " EUR 50", " AB12", " ABTEILUNG KONTO NUMMER EINS ZWEI", ". End"])
def test_account_numbers_before_other_capitals_and_digits(after):
    for number in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606", "GB82 WEST 1234 5698 7654 32"):
        assert [(k, a, b) for k, a, b, _, _ in pii.find(f"IBAN {number}{after}") if k == "iban"] == [("iban", 5, 5 + len(number))]
    two = "AB12 CDEF 3456 7890 DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32"
    assert pii.redact(two) == "AB12 CDEF 3456 7890 <iban> <iban>"


def test_bpe_agrees_with_the_reference_encoder(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = texts_of(spark)
    for r in QUERIES["op9_byte_bpe"](spark, FOLDER).collect():
        ids = known.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    codec = bpe.load_codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    odd = ["", " ", " \u0085x", "<|endoftext|>", "zq" * 5000, "😀é" * 50, "a\n\n  b"]
    ids, counts = codec.encode(odd)
    at = 0
    for text, n in zip(odd, counts):
        assert ids[at : at + n].tolist() == known.encode_ordinary(text)
        at += n
    assert sorted(codec.hash.slots(list(ranks)).tolist()) == list(range(len(ranks)))


def crc(d, n):
    return zlib.crc32(str(d).encode()) % n


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in table(spark, "documents").select("doc_id", "lang").collect()}
    got = QUERIES["op7_language_identification"](spark, FOLDER).collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got) and len(got) == len(lang)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) > 0.95


def test_quality_on_held_out_documents(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")  # the smallest table has three bad documents held out
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op10_compression_quality"](spark, folder).collect()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.85


def align(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, max(new)), new
    return best / (2 * max(1, len(a)))


def test_leaks_of_exact_edited_and_short_copies(spark):
    pick = random.Random(3)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    say = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    items = {i: say(30) for i in range(8)} | {8: ["only"], 9: []}
    edited = lambda w: [pick.choice(vocabulary) if k % 7 == 3 else x for k, x in enumerate(w)]
    docs = {0: say(50) + items[0] + say(50), 1: say(20) + edited(items[1]) + say(20), 2: say(200), 3: items[2], 4: ["it", "is", "only", "so"], 5: items[3][:15] + say(4) + items[3][15:] + say(30)}
    held = spark.createDataFrame([(d, " ".join(w).capitalize() + ".") for d, w in docs.items()] + [(6, None), (7, "")], DOCS)
    found = decontaminate.find_leaks(held, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(10, None)], "item_id long, text string"))
    got = {(r.doc_id, x.item_id): x.score for r in found.collect() for x in r.leaks}
    want = {(d, i): s for d, w in docs.items() for i, v in items.items() if v and (s := align(v, w)) >= decontaminate.LEAK}
    assert got == pytest.approx(want)
    assert {(0, 0), (1, 1), (3, 2), (4, 8), (5, 3)} == set(got)


@pytest.mark.parametrize("copies", [9, 100, 1000])
def test_leaks_of_edited_copies_in_many_documents(spark, copies):
    pick = random.Random(4)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    say = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    item = say(36)
    edited = lambda at: [pick.choice(vocabulary) if k % 7 == at else x for k, x in enumerate(item)]
    often, cut, seldom = edited(3), item[:18], edited(0)
    docs = {d: often for d in range(copies)} | {copies + d: say(10) + cut + say(10) for d in range(copies)} | {2 * copies: seldom, 2 * copies + 1: item, 2 * copies + 2: say(100)}
    held = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], DOCS)
    found = decontaminate.find_leaks(held, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id for r in found.filter(F.size("leaks") > 0).collect()} == set(docs) - {2 * copies + 2}


def test_leaks_of_items_cut_at_the_start_or_end_of_a_text(spark):
    item, other = [f"w{k}" for k in range(36)], [f"v{k}" for k in range(30)]
    docs = {1: item[1:], 2: item[1:] + other, 3: item[9:], 4: item[9:] + other, 5: other + item[:-9], 6: item[30:] + other}
    held = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], DOCS)
    found = decontaminate.find_leaks(held, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    got = {r.doc_id: (x.score, x.start, x.end) for r in found.collect() for x in r.leaks}
    assert got == {1: (35 / 36, 0, 35), 2: (35 / 36, 0, 35), 3: (0.75, 0, 27), 4: (0.75, 0, 27), 5: (0.75, 30, 57)}


def test_ledger_scans_nothing_twice(spark):
    first = spark.createDataFrame([(1, "key AKIA" + "B" * 16), (2, "key AKIA" + "B" * 16), (3, "nothing")], DOCS)
    _, findings, ledger = secret_scan.scan_versions(first)
    second = spark.createDataFrame([(4, "nothing"), (5, "password = hunter2hunter2"), (1, "key AKIA" + "B" * 16)], DOCS)
    rows = second.select("doc_id", secret_scan.content_address(F.col("text")).alias("blob"), "text")
    assert secret_scan.unseen(rows, ledger, secret_scan.RULES).count() == 1
    paths, every, _ = secret_scan.scan_versions(second, ledger, findings)
    got = {r.doc_id: [s.kind for s in r.spans] for r in paths.collect()}
    assert got == {4: [], 5: ["assign"], 1: ["access"]} and every.count() == 2


def test_revisits(spark):
    schema = "capture_id long, url string, time long, kind string, etag string, last_modified string, headers map<string,string>"
    rows = [
        (1, "http://www.A.com/x/?b=2&a=1", 1, "response", "e1", None, {"content-type": "t", "date": "d1"}), (2, "https://a.com/x?a=1&b=2#f", 5, "revisit", "e1", None, {"date": "d2", "content-type": "no"}),
        (3, "a.com/x?a=1&b=2", 6, "revisit", "e9", None, {}), (4, "a.com/x?a=1&b=2", 1, "revisit", "e1", None, None), (5, None, 7, "revisit", None, None, {}), (6, "a.com/x?a=1&b=2&utm_source=q", 9, "revisit", None, "m", {}),
    ]
    got = {r.capture_id: (r.refers_to, r.verdict, r.headers) for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: (1, "match", {"content-type": "t", "date": "d2"}), 3: (1, "changed", {}), 4: (None, "missing", {}), 5: (None, "missing", {}), 6: (1, "unproven", {})}
    assert revisits.resolve(spark.createDataFrame([], schema)).count() == 0


def operators(spark):
    items = spark.createDataFrame([(1, "hello world again and again")], "item_id long, text string")
    known = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["the cat sat", "a dog ran"])] + [(9, "der hund und die katze", "de"), (10, None, "de"), (11, "x", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (9, None)], "doc_id long, quality int")
    lang, good = langid.fit(known), quality.fit(known, labels)
    return {
        "decontaminate": lambda d: decontaminate.find_leaks(d, items), "langid": lambda d: langid.identify(d, lang), "pii": pii.find_pii, "redact": pii.redact_pii, "quality": lambda d: quality.score_quality(d, good),
        "bpe": lambda d: bpe.encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), "simhash": simhash_vp.near_duplicates, "merkle": merkle.compare_edits, "secrets": lambda d: secret_scan.scan_versions(d)[0],
    }


def test_nulls_empty_long_texts_ties_and_clashing_columns(spark):
    clash = ["n_chars int", "blob string", "fp string", "spans string", "leaks string", "ids string", "lang_pred string", "root int", "score int", "edited int", "_text int", "_was_null int"]
    odd = spark.createDataFrame(ODD, DOCS)
    for c in clash:
        odd = odd.withColumn(c.split()[0], F.lit(None).cast(c.split()[1]))
    for name, apply in operators(spark).items():
        plain = apply(odd.select("doc_id", "text")).collect()
        assert len(plain) == len(ODD), name
        assert apply(odd).count() == len(ODD), name
        assert apply(odd.limit(0)).count() == 0, name


def test_models_without_anything_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    got = langid.identify(spark.createDataFrame(ODD, DOCS), langid.fit(none)).collect()
    assert {(r.lang_pred, r.lang_score) for r in got} == {("und", 0.0)}
    model = quality.fit(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.quality_score for r in quality.score_quality(spark.createDataFrame(ODD, DOCS), model).collect()} == {0.5}


def similar_components(texts):
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(texts), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in texts}


def test_near_dedup_stage_against_all_pairs(spark):
    import corpus_pipeline

    pick = random.Random(5)
    texts = {d: t for d, t in texts_of(spark).items()}
    for d in range(40):  # long chains and stars of edited copies around a similarity of 0.8, and texts that share a passage only
        words = [f"{d}w{k}" for k in range(120)]
        for n in range(8):
            texts[1000 + 10 * d + n] = " ".join(words)
            for _ in range(pick.randrange(4)):
                words = list(words)
                words[pick.randrange(120)] = f"e{d}x{n}"
            if d % 2:
                words = [f"{d}w{k}" for k in range(120)]
                for k in pick.sample(range(120), 3):
                    words[k] = f"e{d}y{n}y{k}"
    for d in range(60):
        texts[3000 + d] = " ".join([f"p{k}" for k in range(60)] + [f"{d}q{k}" for k in range(40)])
    want = sorted(set(similar_components(texts).values()))
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect())
    assert got == want
    assert got != sorted(r.doc_id for r in simhash_vp.keep_one(docs).collect())


def test_near_copies_keep_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d  e f"), (1, "A b c d  e f"), (2, "other words stand here now"), (None, "lonely"), (4, None), (5, "")]
    got = near_copies.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "lonely"), (1, "A b c d  e f"), (2, "other words stand here now"), (4, "")]
    assert near_copies.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    docs, texts = table(spark, "documents"), texts_of(spark)
    columns = docs.columns
    kept = corpus_pipeline.language(spark, docs, FOLDER).cache()
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} >= {d for d, t in texts.items() if len(re.findall(r"\w+", t)) > 20}
    near = similar_components({r.doc_id: texts[r.doc_id] for r in kept.collect()})
    single = corpus_pipeline.near_dedup(spark, kept, FOLDER).cache()
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(set(near.values()))
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    clean = corpus_pipeline.decontamination(spark, single, FOLDER).cache()
    gone = {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and gone == {d for d, _ in every_pair([(r.doc_id, r.text) for r in single.collect()], items)}
    redacted = corpus_pipeline.personal_data(spark, clean, FOLDER)
    assert redacted.columns == columns
    for r in redacted.collect():
        assert r.n_chars == len(r.text) and not plain_pii(r.text)
    last = corpus_pipeline.tokens(spark, redacted, FOLDER)
    assert last.count() == clean.count() and last.filter("NOT lossless").count() == 0


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    rows = [*ODD, ODD[4], (None, None), (9, "x" * 300_000), (10, "@." * 100_000)]
    docs = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("root", "form", "digest", "leaks", "ids", "decoded", "spans", "_lang", "_held", "_kept_id", "_of", "fp"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    for name, stage in corpus_pipeline.STAGES:
        kept, none = stage(spark, docs, FOLDER), stage(spark, docs.limit(0), FOLDER)
        assert none.count() == 0, name
        got = kept.collect()
        assert name == "tokens" or kept.columns == docs.columns, name
        want = {"near_dedup": len(rows) - 5, "language": None}.get(name, len(rows))
        assert want is None or len(got) == want, name
