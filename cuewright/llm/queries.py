"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustered_search, decontaminate, fim, langid, merkle, pii, pivot_search, quality, revisits, secret_scan, simhash_vp, suffix_index
from .common import span_list, table

#: Rank file of the tokenizer; None takes the installed public one.
BPE_PATH: str | None = None


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return suffix_index.remove_repeats(documents(spark, sf_dir), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.compare_edits(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations: half of the texts first, then all, of which only the others' blobs are scanned."""
    docs = documents(spark, sf_dir)
    early = docs.filter(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)) == 0)
    paths = secret_scan.scan_generations([early, docs])
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    counts = [secret_scan.count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return paths.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list("spans").alias("spans"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pair of a document and a test item that it holds."""
    found = decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures_of_pages(table(spark, sf_dir, "pages")))
    headers = F.concat_ws("; ", F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))))
    return found.select(F.expr("(capture_id - 1) div 2").alias("page_id"), "canonical_url", F.expr("refers_to div 2").alias("refers_to_page"), "verdict", headers.alias("headers"))


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vp.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def bucket_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op7_language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang")
    model = langid.fit(docs.filter(bucket_of("doc_id", 4) != 2))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir)).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["base"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(span_list(base), 256).alias("base_sha256"), span_list("spans").alias("spans"), score)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = BPE_PATH or public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    learn = bucket_of("doc_id", 5) != 0
    model = quality.fit(docs.filter(learn), labels.filter(learn))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op11_clustered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = clustered_search.build(documents(spark, sf_dir))
    found = clustered_search.search(index, table(spark, sf_dir, "benchmark"), 10)
    index.drop()
    return found


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.rearrange(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pivot_search.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_merkle_fingerprints, op3_secret_ledger, op4_benchmark_leaks, op5_revisit_resolution, op6_simhash_near_duplicates, op7_language_identification, op8_personal_data, op9_byte_bpe, op10_compression_quality, op11_clustered_search, op12_fill_in_middle, op13_pivot_search)}

#: crc32 has no counterpart in DuckDB, so the oracle of op5 computes it bit by bit from the polynomial.
_CRC32 = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(page_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
  lambda h, b: list_reduce(list_prepend(xor(h, b), [0::UBIGINT for i in range(8)]), lambda c, i: xor(c >> 1, (c & 1) * 3988292384::UBIGINT)))"""

_CUTS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rule, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {r.group}) AS held, string_split_regex(text, '{p}') AS gaps FROM d"
    for i, r in enumerate(secret_scan.RULES)
    for p in [r.pattern.replace("'", "''")]
)

ORACLES: dict[str, str] = {
    "op2_merkle_fingerprints": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d),
e AS (SELECT doc_id, text, nxt, length(text) AS n_chars, substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) AS edited FROM n),
v AS (SELECT doc_id, n_chars, edited, unnest([{'k': 0, 't': text}, {'k': 1, 't': edited}, {'k': 2, 't': nxt}]) AS s FROM e),
l AS (SELECT doc_id, n_chars, edited, s.k AS k, regexp_extract_all(s.t, '[^\n]*\n|[^\n]+') AS lines FROM v),
f AS (SELECT doc_id, n_chars, edited, k,
  sha256(array_to_string(list_transform(list_filter(string_split(regexp_replace(array_to_string(list_transform(lines, lambda p: sha256(p)), '.') || '.', '\b(0[0-9a-f]*)\.', '\1;', 'g'), ';'), lambda s: s <> ''), lambda s: sha256(s)), '')) AS root,
  CASE WHEN len(lines) = 0 THEN '' ELSE regexp_replace(array_to_string(list_transform(lines, lambda p: substr(sha256(p), 1, 8) || array_to_string(list_transform(regexp_extract_all(p, '(?s).{1,80}?(?:[.!?;:,|]+[ \t]+|\n)|.{80}|.+'), lambda c: substr(md5(c), 1, 8)), '')), '.') || '.', '\b(0[0-9a-f]*)\.', '\1;', 'g') END AS tree FROM l),
g AS (SELECT a.doc_id, a.n_chars, a.edited, z.k, a.root AS r0, z.root AS r1, a.tree AS t0, z.tree AS t1, list_filter(string_split(a.tree, ';'), lambda x: x <> '') AS sa, list_filter(string_split(z.tree, ';'), lambda x: x <> '') AS sb FROM f a JOIN f z ON a.doc_id = z.doc_id AND z.k > 0 WHERE a.k = 0),
p AS (SELECT *, list_distinct(flatten(list_transform(list_filter(sa, lambda s: list_contains(sb, s)), lambda s: list_filter(string_split(s, '.'), lambda y: y <> '')))) AS pc,
  list_distinct(flatten(list_transform(list_filter(sa, lambda s: NOT list_contains(sb, s)), lambda s: list_filter(string_split(s, '.'), lambda y: y <> '')))) AS pa,
  list_distinct(flatten(list_transform(list_filter(sb, lambda s: NOT list_contains(sa, s)), lambda s: list_filter(string_split(s, '.'), lambda y: y <> '')))) AS pb FROM g),
q AS (SELECT *, list_distinct(flatten(list_transform(list_filter(pa, lambda x: NOT list_contains(pb, x)), lambda x: regexp_extract_all(substr(x, 9), '.{8}')))) AS la,
  list_distinct(flatten(list_transform(list_filter(pb, lambda x: NOT list_contains(pa, x)), lambda x: regexp_extract_all(substr(x, 9), '.{8}')))) AS lb,
  coalesce(list_sum(list_transform(list_concat(pc, list_filter(pa, lambda x: list_contains(pb, x))), lambda x: length(x) // 8 - 1)), 0) AS held FROM p),
h AS (SELECT *, len(list_intersect(la, lb)) AS m FROM q),
w AS (SELECT doc_id, n_chars, edited, k, r0, r1, t0, t1, CASE WHEN r0 = r1 THEN 1.0::DOUBLE WHEN held + len(la) + len(lb) = 0 THEN 0.0 ELSE 2.0::DOUBLE * (held + m) / (2.0::DOUBLE * (held + m) + len(la) + len(lb) - 2 * m) END AS near FROM h)
SELECT a.doc_id, a.n_chars, sha256(a.edited) AS edited_sha256, a.r0 || ':' || a.t0 AS fingerprint, a.r1 || ':' || a.t1 AS edited_fingerprint, a.near AS near_edited, b.near AS near_next FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.k = 1 AND b.k = 2""",
    "op3_secret_ledger": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cuts AS ({_CUTS}),
m AS (SELECT doc_id, rule, kind, least, unnest(range(1, len(hits) + 1)) AS i, hits, held, gaps FROM cuts WHERE len(hits) > 0),
p AS (SELECT doc_id, rule, kind, least, length(hits[i]) AS hit, length(held[i]) AS held, sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, rule ORDER BY i) AS stop FROM m),
f AS (SELECT doc_id, rule, kind, (stop - hit)::BIGINT AS start, stop::BIGINT AS stop FROM p WHERE held >= least),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) FILTER (rule < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON d.doc_id IS NOT DISTINCT FROM s.doc_id""",
    "op5_revisit_resolution": rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, {_CRC32} AS raw, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages),
q AS (SELECT page_id, xor(raw, 4294967295::UBIGINT)::BIGINT AS crc, md5(html) AS etag, strlen(html) AS size, rest,
  regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^(www[0-9]*|m)\.', ''), ':(80|443)$', '') AS host, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)'))) AS query FROM p),
u AS (SELECT *, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical_url, 'day-' || (page_id // 7) AS modified FROM q),
r AS (SELECT a.page_id, a.canonical_url, a.crc, CASE WHEN a.crc % 7 = 0 THEN NULL WHEN a.crc % 5 = 0 THEN md5(a.etag) ELSE a.etag END AS etag, CASE WHEN a.crc % 7 = 0 THEN NULL ELSE a.modified END AS modified,
  max(b.page_id) AS refers_to_page FROM u a LEFT JOIN u b ON a.canonical_url = b.canonical_url AND 2 * b.page_id < 2 * (a.page_id + 1 + a.crc % 50) + 1 GROUP BY ALL),
v AS (SELECT r.*, b.size, CASE WHEN b.page_id IS NULL THEN 'missing' WHEN coalesce(r.etag = b.etag, r.modified = b.modified) THEN 'match' WHEN NOT coalesce(r.etag = b.etag, r.modified = b.modified) THEN 'changed' ELSE 'unproven' END AS verdict
  FROM r LEFT JOIN u b ON r.refers_to_page = b.page_id)
SELECT page_id, canonical_url, refers_to_page, verdict, 'cache-control: max-age=300; content-length: ' || CASE WHEN verdict = 'match' THEN size ELSE 0 END || CASE WHEN verdict = 'match' THEN '; content-type: text/html' ELSE '' END || '; date: visit-' || page_id AS headers FROM v""",
    "op11_clustered_search": r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
m AS (SELECT doc_id, 10 + (90 * n * docs) // words AS m FROM d, c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
c AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in range(4)] AS x FROM d),
e AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
f AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM f""",
    "op13_pivot_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
}
