"""The registered queries in DuckDB's SQL, written from what they mean and not from the Spark code."""

from __future__ import annotations

from ..functions.text import ANNOTATIONS
from ..functions.tokens import STOPWORDS
from ..operators.answers import CONTINUATION, REFERENTIAL

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _terms(text: str) -> str:
    found = f"regexp_extract_all(lower({text}), '[a-z0-9]+(?:[''-][a-z0-9]+)*')"
    spread = f"flatten(list_transform({found}, lambda w: CASE WHEN regexp_matches(w, '[''-]') THEN list_concat([w], regexp_split_to_array(w, '[''-]')) ELSE [w] END))"
    return f"list_filter({spread}, lambda w: NOT list_contains({_STOP}, w))"


_CUES = """cues AS (SELECT conv_id::VARCHAR AS video_id, turn::INT AS idx, (sum(length(text)) OVER w - length(text))::DOUBLE / 15 AS start_s, (sum(length(text)) OVER w)::DOUBLE / 15 AS end_s, text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""
_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_ANNOTATION = r"(?i)[\[\(](?:" + "|".join(ANNOTATIONS) + r")[^\])]*[\]\)]"
_SPEAKER = r"^\s*(?:>>+|-\s|[A-Z][A-Z .''-]{1,24}:)\s*"
_MARKED = _CUES + """, marked AS (SELECT video_id, idx, CASE idx % 3 WHEN 0 THEN '>> JOHN SMITH: ' || text WHEN 1 THEN '[Music playing] <i>' || text || '</i>' ELSE '- ' || text || ' (APPLAUSE)' END AS text FROM cues)"""


def _without_marks(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '</?[^>]{{1,20}}>', ' ', 'g'), '{_ANNOTATION}', ' ', 'g')"


def _without_speakers(text: str) -> str:
    for _ in range(3):
        text = f"regexp_replace({text}, '{_SPEAKER}', '')"
    return text


def _cleaned(text: str) -> str:
    return _SQUEEZE.format(_without_speakers(_without_marks(text)))


_ROLLING = _CUES + rf""", worded AS (SELECT *, string_split({_SQUEEZE.format('lag(text) OVER (PARTITION BY video_id ORDER BY idx)')}, ' ') AS w FROM cues),
lasted AS (SELECT *, array_to_string(w[greatest(len(w) - 2, 1):], ' ') AS last FROM worded),
rolled AS (SELECT video_id, idx, start_s, end_s, CASE WHEN idx % 5 = 4 THEN last WHEN idx % 2 = 1 THEN last || ' ' || text ELSE text END AS text FROM lasted)"""
_OVERLAP = "coalesce(list_max(list_filter(range(1, least(12, len(a), len(b))::BIGINT + 1), lambda n: list_transform(a[len(a) - n + 1:], lambda x: lower(x)) = list_transform(b[:n], lambda x: lower(x)))), 0)"
_DEDUP = (
    "WITH RECURSIVE "
    + _ROLLING
    + rf""", ready AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS rn, start_s, end_s, {_cleaned('text')} AS text FROM rolled WHERE {_cleaned('text')} <> ''),
fold AS (SELECT video_id, 0::BIGINT AS rn, 0::BIGINT AS n, 0.0::DOUBLE AS start_s, 0.0::DOUBLE AS end_s, ''::VARCHAR AS before, ''::VARCHAR AS text FROM (SELECT DISTINCT video_id FROM ready)
  UNION ALL
  SELECT video_id, rn, n + (text <> '')::BIGINT, start_s, end_s, CASE WHEN text <> '' THEN text ELSE before END, text FROM (
    SELECT video_id, rn, n, start_s, end_s, before, array_to_string(b[{_OVERLAP} + 1:], ' ') AS text FROM (
      SELECT f.video_id, r.rn, f.n, r.start_s, r.end_s, f.before, list_filter(string_split(f.before, ' '), lambda x: x <> '') AS a, string_split(r.text, ' ') AS b FROM fold f JOIN ready r ON f.video_id = r.video_id AND r.rn = f.rn + 1)))
SELECT video_id, (n - 1)::INT AS idx, round(start_s, 6) AS start_s, round(start_s + greatest(0, end_s - start_s), 6) AS end_s, text FROM fold WHERE rn > 0 AND text <> ''"""
)

_TIMELINE = _CUES + rf""", ready AS (SELECT video_id, idx, start_s, end_s, {_cleaned('text')} AS text FROM cues WHERE {_cleaned('text')} <> ''),
line AS (SELECT video_id, idx AS seg_index, (sum(length(text) + 1) OVER w - 1 - length(text))::INT AS char_start, (sum(length(text) + 1) OVER w - 1)::INT AS char_end, start_s AS t_start,
  CASE WHEN end_s > start_s THEN end_s ELSE start_s + 0.001 END AS t_end, text FROM ready WINDOW w AS (PARTITION BY video_id ORDER BY idx ROWS UNBOUNDED PRECEDING))"""
_WORDS = _TIMELINE + """, whole AS (SELECT video_id, string_agg(text, ' ' ORDER BY seg_index) AS text FROM line GROUP BY video_id),
each AS (SELECT video_id, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM whole),
placed AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY video_id ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS e FROM each)"""

_BM25 = f"""docs AS (SELECT {{scope}} AS scope, doc_id AS passage_id, {_terms('text')} AS terms FROM documents),
stats AS (SELECT scope, count(*) AS n_docs, avg(len(terms)) AS avg_len FROM docs GROUP BY scope),
post AS (SELECT scope, passage_id, n AS len, term, count(*) AS tf FROM (SELECT scope, passage_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL),
freq AS (SELECT scope, term, count(*) AS df FROM post GROUP BY ALL),
asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, p.scope, passage_id, round(sum(qf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
  FROM asked a JOIN post p ON a.term = p.term JOIN freq f ON f.scope = p.scope AND f.term = p.term JOIN stats s ON s.scope = p.scope GROUP BY ALL),
lexical AS (SELECT query_id, scope, passage_id, score, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, passage_id) - 1 AS rank FROM scored WHERE score > 0)"""
_BY_LANG, _IN_ALL = _BM25.format(scope="lang"), _BM25.format(scope="'all'")


def _dense(which: str) -> str:
    return f"""near AS (SELECT q.vec_id AS query_id, v.vec_id AS passage_id, round(list_inner_product(q.x, v.x) / (sqrt(list_inner_product(q.x, q.x)) * sqrt(list_inner_product(v.x, v.x))), 6) AS score
  FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE {which}) q, (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) v),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) - 1 AS rank, greatest(0, least(1, score)) AS confidence FROM near)"""


_PROBES, _ASKED = _dense("vec_id % 100 = 0"), _dense("vec_id IN (SELECT item_id FROM benchmark)")
_BOTH = f"""{_ASKED}, {_IN_ALL}, d AS (SELECT * FROM dense WHERE rank < 30), l AS (SELECT *, 1 - exp(-score / 8) AS confidence FROM lexical WHERE rank < 30),
both_ AS (SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.passage_id, l.passage_id) AS passage_id, d.score AS dense_score, d.rank AS dense_rank, d.confidence AS dense_confidence, l.score AS lexical_score, l.rank AS lexical_rank, l.confidence AS lexical_confidence
  FROM d FULL JOIN l ON d.query_id = l.query_id AND d.passage_id = l.passage_id),
fused AS (SELECT *, round(coalesce(1 / (61.0::DOUBLE + dense_rank), 0) + coalesce(1 / (61.0::DOUBLE + lexical_rank), 0), 6) AS score, coalesce(dense_confidence, 0) + 0.15::DOUBLE * coalesce(lexical_confidence, 0) * (1 - coalesce(dense_confidence, 0)) AS confidence FROM both_),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) - 1 AS rank FROM fused)"""


def _scaled(c: str) -> str:
    low, high = f"min({c}) OVER (PARTITION BY query_id)", f"max({c}) OVER (PARTITION BY query_id)"
    return f"CASE WHEN {c} IS NULL THEN 0 WHEN {high} - {low} < 1e-12 THEN ({high} > 0)::INT ELSE ({c} - {low}) / ({high} - {low}) END"


_WORDSET = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: length(w) > 2))"
_RERANK = f"""{_IN_ALL}, pool AS (SELECT l.*, {_WORDSET.format('b.text')} AS a, {_WORDSET.format('d.text')} AS b FROM lexical l JOIN benchmark b ON b.item_id = l.query_id JOIN documents d ON d.doc_id = l.passage_id WHERE rank < 30),
logits AS (SELECT query_id, passage_id, score AS base_score, rank AS base_rank, round(CASE WHEN len(a) + len(b) = 0 THEN -6.0::DOUBLE ELSE 12.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) - 6 END, 6) AS logit FROM pool),
again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, base_rank) - 1 AS rank FROM logits)"""

_JUDGED = f"""{_PROBES}, judged AS (SELECT query_id AS case_id, rank, a.label = b.label AS relevant FROM dense JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = passage_id WHERE rank < 10)"""
_RANKED = """scores AS (SELECT c.case_id, coalesce(avg(relevant::INT) FILTER (rank < {k}), 0) AS precision_at_k, coalesce(max(CASE WHEN relevant THEN 1.0::DOUBLE / (rank + 1) END), 0) AS mrr,
  coalesce(sum(CASE WHEN relevant AND rank < {k} THEN 1 / log2(rank + 2) END) / list_sum(list_transform(range(count(*) FILTER (relevant AND rank < {k})), lambda i: 1 / log2(i + 2))), 0) AS ndcg_at_k
  FROM asked_cases c LEFT JOIN judged j ON j.case_id = c.case_id GROUP BY c.case_id)"""
_GOLD = _CUES + """, gold AS (SELECT video_id AS case_id, start_s + 5 AS gold_start, start_s + 25 AS gold_end FROM cues WHERE idx % 3 = 0),
hits AS (SELECT video_id AS case_id, row_number() OVER (PARTITION BY video_id ORDER BY end_s - start_s DESC, idx) - 1 AS rank, start_s, end_s FROM cues),
pairs AS (SELECT case_id, rank, gold_start, gold_end, greatest(0, least(end_s, gold_end) - greatest(start_s, gold_start)) AS shared, end_s - start_s AS a, gold_end - gold_start AS b, greatest(end_s, gold_end) - least(start_s, gold_start) AS outer_ FROM hits JOIN gold USING (case_id)),
rated AS (SELECT *, CASE WHEN least(a, b) > 0 THEN shared / least(a, b) ELSE 0 END AS coverage, CASE WHEN shared > 0 THEN shared / outer_ ELSE 0 END AS iou FROM pairs),
asked_cases AS (SELECT DISTINCT conv_id::VARCHAR AS case_id FROM conversations),
judged AS (SELECT h.case_id, h.rank, coalesce(bool_or(coverage >= 0.3), false) AS relevant FROM hits h LEFT JOIN rated r ON r.case_id = h.case_id AND r.rank = h.rank GROUP BY ALL),
found AS (SELECT case_id, gold_start, gold_end, bool_or(coverage >= 0.3 AND rank < 2) AS found FROM rated GROUP BY ALL),
recall AS (SELECT c.case_id, coalesce(avg(found::INT), 0) AS recall_at_k FROM asked_cases c LEFT JOIN found f ON f.case_id = c.case_id GROUP BY ALL)"""
_RESULTS = """results AS (SELECT source AS retriever, doc_id AS case_id, quality = 1 AS answerable, toxic = 1 AS refused, doc_id % 9 <> 0 AS has_answer, (doc_id % 5) / 5.0::DOUBLE AS recall_at_k, (doc_id % 7) / 7.0::DOUBLE AS precision_at_k, (doc_id % 4) / 4.0::DOUBLE AS mrr,
  (doc_id % 8) / 8.0::DOUBLE AS ndcg_at_k, (doc_id % 3) / 3.0::DOUBLE AS citation_precision, (doc_id % 2) / 2.0::DOUBLE AS citation_hit_rate, least(1, n_chars / 4000.0::DOUBLE) AS top_confidence, (doc_id % 6) / 6.0::DOUBLE AS faithfulness, (doc_id % 11) / 11.0::DOUBLE AS answer_relevance,
  (doc_id % 12) / 12.0::DOUBLE AS context_relevance, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS correctness, n_chars FROM labels JOIN documents USING (doc_id))"""
_SWEEP = f"""{_RESULTS}, sweep AS (SELECT t / 20.0::DOUBLE AS threshold, coalesce(avg((top_confidence < t / 20.0::DOUBLE)::INT) FILTER (NOT answerable), 0) AS correct_refusal_rate, coalesce(avg((top_confidence < t / 20.0::DOUBLE)::INT) FILTER (answerable), 0) AS false_refusal_rate FROM results, range(21) r(t) GROUP BY t)"""
_FAILED = f"""{_RESULTS}, failed AS (SELECT retriever, case_id, CASE WHEN answerable AND refused THEN 'FALSE REFUSAL' WHEN answerable AND recall_at_k = 0 THEN 'RETRIEVAL MISS' WHEN NOT answerable AND NOT refused THEN 'MISSED REFUSAL' END AS failure, recall_at_k > 0 AS retrieved FROM results)"""
_QUESTIONS = """asked AS (SELECT conv_id || '-' || CASE WHEN turn % 6 = 4 THEN 2 ELSE turn END AS case_id, conv_id % 3 <> 0 AS answerable, turn % 3 AS n_spans, CASE WHEN turn > 1 THEN conv_id || '-' || (turn - 2) END AS followup_to FROM conversations WHERE role = 'user')"""
def _at(seconds: str) -> str:
    s = f"({seconds})"
    return f"(CASE WHEN {s} >= 3600 THEN printf('%d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) ELSE printf('%d:%02d', {s} // 60, {s} % 60) END)"


_whole = lambda x: f"greatest(floor({x}), 0)::BIGINT"
_CHAT = _CUES + f""", chat AS (SELECT video_id::BIGINT AS question_id, idx AS rank, video_id::BIGINT * 100 + idx AS passage_id, video_id, start_s, end_s, text, (video_id::BIGINT * 37 % 100) / 100.0::DOUBLE * (1 - idx / 20.0::DOUBLE) AS confidence FROM cues),
blocks AS (SELECT *, '[' || (rank + 1) || '] (' || {_at(_whole('start_s'))} || ' - ' || {_at(_whole('end_s'))} || ')' || chr(10) || text AS block FROM chat),
used AS (SELECT * FROM (SELECT *, sum(length(block)) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS held FROM blocks) WHERE rank = 0 OR held <= 1500),
counts AS (SELECT question_id, count(*) AS n_used FROM used GROUP BY ALL),
replies AS (SELECT conv_id AS question_id, CASE conv_id % 6 WHEN 0 THEN 'It is so [1], and  so [2][1] .' WHEN 1 THEN 'As said [9] , it is [2].' WHEN 2 THEN 'INSUFFICIENT_CONTEXT' WHEN 3 THEN 'Plainly so.' WHEN 4 THEN 'Only [77] knows.' ELSE 'First [3], then [1].' END AS text FROM conversations WHERE turn = 0),
marked AS (SELECT r.question_id, text, n_used, list_transform(regexp_extract_all(text, '\\[([0-9]{{1,2}})\\]', 1), lambda m: m::INT) AS m FROM replies r JOIN counts USING (question_id)),
bad AS (SELECT *, list_filter(m, lambda x: x < 1 OR x > n_used) AS invalid FROM marked),
cut AS (SELECT *, list_reduce(list_prepend(text, list_transform(invalid, lambda x: '[' || x || ']')), lambda t, x: replace(t, x, '')) AS rest FROM bad),
tidy AS (SELECT question_id, n_used, CASE WHEN len(invalid) > 0 THEN trim(regexp_replace(regexp_replace(rest, '[ \\t]{{2,}}', ' ', 'g'), '\\s+([.,;:!?])', '\\1', 'g')) ELSE text END AS cleaned, invalid FROM cut),
cited AS (SELECT question_id, marker, min(p) AS p FROM (SELECT question_id, n_used, unnest(list_transform(regexp_extract_all(cleaned, '\\[([0-9]{{1,2}})\\]', 1), lambda x: x::INT)) AS marker, unnest(range(len(regexp_extract_all(cleaned, '\\[([0-9]{{1,2}})\\]')))) AS p FROM tidy) GROUP BY ALL),
conf AS (SELECT question_id, greatest(0, max(confidence)) AS confidence FROM chat GROUP BY ALL),
layered AS (SELECT c.question_id, confidence, CASE WHEN confidence < 0.28 THEN 'A' WHEN cleaned LIKE '%INSUFFICIENT_CONTEXT%' OR trim(cleaned) = '' THEN 'B' WHEN c.question_id NOT IN (SELECT question_id FROM cited) THEN 'C' WHEN len(invalid) > 0 THEN 'C:partial' END AS layer, cleaned FROM conf c JOIN tidy USING (question_id))"""
_QUOTE = "CASE WHEN length({0}) <= 160 THEN {0} ELSE rtrim(substr({0}, 1, 159)) || '…' END"
_LOCATORS = """ids AS (SELECT page_id, url, lpad(page_id::VARCHAR, 6, '0') || '-_aBc' AS vid FROM pages)"""
_KIND = "(['manual', 'generated', 'translated', 'unknown'])[(turn * 7 % 4 + 1)::INT]"
_TRACKS = f"""tracks AS (SELECT conv_id::VARCHAR AS video_id, (['en-GB', 'de', 'en'])[(turn % 3 + 1)::INT] AS language, {_KIND} AS kind, turn FROM conversations WHERE turn > 0)"""

ORACLES: dict[str, str] = {
    "bm25_topk": f"WITH {_BY_LANG} SELECT * FROM lexical WHERE rank < 5",
    "bm25_confidence": f"WITH {_BY_LANG} SELECT item_id AS query_id, round(coalesce(max(1 - exp(-score / 8)), 0), 6) AS confidence FROM benchmark LEFT JOIN (SELECT * FROM lexical WHERE rank < 5) l ON l.query_id = item_id GROUP BY item_id",
    "idf_stats": f"WITH {_BY_LANG} SELECT scope, term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM freq JOIN stats USING (scope)",
    "doc_length_stats": f"WITH {_BY_LANG} SELECT scope, n_docs, round(avg_len, 6) AS avg_len FROM stats",
    "tokenize_compound_terms": "SELECT doc_id AS passage_id, array_to_string(" + _terms("text || ' It''s state-of-the-art, the x-ray isn''t.'") + ", ' ') AS terms FROM documents",
    "hash_features": "WITH t AS (SELECT doc_id AS passage_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents) SELECT passage_id, array_to_string(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])), ' ') AS features FROM t",
    "dense_topk": f"WITH {_PROBES} SELECT query_id, passage_id, score, rank FROM dense WHERE rank < 10",
    "cosine_confidence": f"WITH {_PROBES} SELECT query_id, max(confidence) AS confidence FROM dense GROUP BY query_id",
    "l2_normalize": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS x FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(x, x)) AS n FROM v) SELECT vec_id AS passage_id, unnest(range(len(x))) AS place, unnest(list_transform(x, lambda y: round(CASE WHEN n > 0 THEN y / n ELSE y END, 6) + 0)) AS x FROM n",
    "candidate_union": f"WITH {_BOTH} SELECT query_id, passage_id, dense_score, dense_rank, lexical_score, lexical_rank FROM both_",
    "hybrid_rrf": f"WITH {_BOTH} SELECT query_id, passage_id, score, rank FROM hybrid WHERE rank < 5",
    "hybrid_weighted": f"WITH {_BOTH}, w AS (SELECT query_id, passage_id, round(0.5::DOUBLE * ({_scaled('dense_score')}) + 0.5::DOUBLE * ({_scaled('lexical_score')}), 6) AS score FROM both_), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) - 1 AS rank FROM w) SELECT * FROM r WHERE rank < 5",
    "fusion_confidence": f"WITH {_BOTH} SELECT item_id AS query_id, round(coalesce(max(confidence), 0), 6) AS confidence FROM benchmark LEFT JOIN (SELECT * FROM hybrid WHERE rank < 5) h ON h.query_id = item_id GROUP BY item_id",
    "rerank_jaccard": f"WITH {_RERANK} SELECT * FROM again WHERE rank < 5",
    "rerank_sigmoid": f"WITH {_RERANK} SELECT query_id, rank, round(1 / (1 + exp(-logit)), 6) AS confidence FROM again WHERE rank < 5",
    "compare_retrievers": f"WITH {_BOTH} SELECT 'dense' AS retriever, query_id, passage_id, score, rank FROM dense WHERE rank < 5 UNION ALL SELECT 'sparse', query_id, passage_id, score, rank FROM lexical WHERE rank < 5 UNION ALL SELECT 'hybrid', query_id, passage_id, score, rank FROM hybrid WHERE rank < 5",
    "ranking_scores": f"WITH {_JUDGED}, asked_cases AS (SELECT vec_id AS case_id FROM embeddings WHERE vec_id % 100 = 0), {_RANKED.format(k=5)} SELECT case_id, round(precision_at_k, 6) AS precision_at_k, round(mrr, 6) AS mrr, round(ndcg_at_k, 6) AS ndcg_at_k FROM scores",
    "mean_scores": f"WITH {_JUDGED}, asked_cases AS (SELECT vec_id AS case_id FROM embeddings WHERE vec_id % 100 = 0), {_RANKED.format(k=5)} SELECT round(coalesce(avg(precision_at_k), 0), 6) AS precision_at_k, round(coalesce(avg(mrr), 0), 6) AS mrr, round(coalesce(avg(ndcg_at_k), 0), 6) AS ndcg_at_k FROM scores WHERE case_id % 300 <> 0",
    "span_overlaps": f"WITH {_GOLD} SELECT case_id, rank, round(gold_start, 6) AS gold_start, round(coverage, 6) AS coverage, round(iou, 6) AS iou FROM rated",
    "span_recall": f"WITH {_GOLD} SELECT case_id, round(recall_at_k, 6) AS recall_at_k FROM recall",
    "span_retrieval_scores": f"WITH {_GOLD}, {_RANKED.format(k=2)} SELECT case_id, round(recall_at_k, 6) AS recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(mrr, 6) AS mrr, round(ndcg_at_k, 6) AS ndcg_at_k FROM scores JOIN recall USING (case_id)",
    "citation_scores": f"WITH {_GOLD}, best AS (SELECT h.case_id, h.rank, coalesce(max(iou), 0) AS iou FROM hits h LEFT JOIN rated r ON r.case_id = h.case_id AND r.rank = h.rank WHERE h.rank < 3 GROUP BY ALL) SELECT c.case_id, round(coalesce(avg(iou), 0), 6) AS citation_precision, round(coalesce(avg((iou >= 0.1)::INT), 0), 6) AS citation_hit_rate FROM asked_cases c LEFT JOIN best b ON b.case_id = c.case_id GROUP BY ALL",
    "time_coverage_union": f"""WITH {_GOLD}, r AS (SELECT video_id, start_s, end_s FROM cues WHERE idx % 2 = 0 UNION ALL SELECT case_id, gold_start, gold_end FROM gold),
edges AS (SELECT video_id, t, lead(t) OVER (PARTITION BY video_id ORDER BY t) AS u FROM (SELECT video_id, start_s AS t FROM r UNION SELECT video_id, end_s FROM r)),
lit AS (SELECT DISTINCT e.video_id, t, u FROM edges e JOIN r ON r.video_id = e.video_id AND r.start_s <= e.t AND r.end_s >= e.u WHERE u IS NOT NULL)
SELECT video_id, round(sum(u - t), 6) AS covered_s FROM lit GROUP BY video_id""",
    "threshold_sweep": f"WITH {_SWEEP} SELECT round(threshold, 6) AS threshold, round(correct_refusal_rate, 6) AS correct_refusal_rate, round(false_refusal_rate, 6) AS false_refusal_rate, round(correct_refusal_rate - false_refusal_rate, 6) AS youden_j FROM sweep",
    "best_threshold": f"WITH {_SWEEP}, j AS (SELECT *, correct_refusal_rate - false_refusal_rate AS youden_j, false_refusal_rate <= 0.15 AS fine FROM sweep) SELECT round(threshold, 6) AS threshold, round(correct_refusal_rate, 6) AS correct_refusal_rate, round(false_refusal_rate, 6) AS false_refusal_rate, round(youden_j, 6) AS youden_j FROM j ORDER BY fine DESC, CASE WHEN fine THEN correct_refusal_rate ELSE youden_j END DESC, threshold LIMIT 1",
    "pooled_summary": f"""WITH {_RESULTS} SELECT retriever, count(*) AS cases, {', '.join(f'round(coalesce(avg({c}) FILTER (answerable), 0), 6) AS {c}' for c in ('recall_at_k', 'precision_at_k', 'mrr', 'ndcg_at_k'))},
  round(coalesce(avg(citation_precision) FILTER (answerable AND has_answer AND NOT refused), 0), 6) AS citation_precision, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('faithfulness', 'answer_relevance', 'correctness'))},
  round(coalesce(avg(refused::INT) FILTER (NOT answerable AND has_answer), 0), 6) AS correct_refusal_rate, round(coalesce(avg(refused::INT) FILTER (answerable AND has_answer), 0), 6) AS false_refusal_rate FROM results GROUP BY retriever""",
    "failure_classification": f"WITH {_FAILED} SELECT * FROM failed WHERE failure IS NOT NULL",
    "failure_digest": f"WITH {_FAILED} SELECT retriever, case_id, failure, retrieved FROM (SELECT *, row_number() OVER (PARTITION BY retriever ORDER BY case_id) AS n FROM failed WHERE failure IS NOT NULL) WHERE n <= 8",
    "csv_report": f"WITH {_RESULTS} SELECT retriever, case_id, answerable::INT::VARCHAR AS answerable, retriever || '|t' AS tags, {', '.join(f'''printf('%.4f', {c}) AS {c}''' for c in ('recall_at_k', 'precision_at_k', 'mrr', 'ndcg_at_k', 'citation_precision', 'citation_hit_rate', 'top_confidence', 'faithfulness', 'answer_relevance', 'context_relevance'))}, refused::INT::VARCHAR AS refused, coalesce(printf('%.4f', correctness), '') AS correctness, printf('%.1f', n_chars::DOUBLE) AS latency_ms FROM results",
    "case_validation": f"WITH {_QUESTIONS} SELECT case_id, 'duplicate id' AS problem FROM asked GROUP BY case_id HAVING count(*) > 1 UNION ALL SELECT case_id, 'answerable without spans' FROM asked WHERE answerable AND n_spans = 0 UNION ALL SELECT case_id, 'unanswerable with spans' FROM asked WHERE NOT answerable AND n_spans > 0 UNION ALL SELECT case_id, 'unknown follow-up' FROM asked WHERE followup_to IS NOT NULL AND followup_to NOT IN (SELECT case_id FROM asked)",
    "conversation_order": "WITH RECURSIVE c AS (SELECT conv_id || '-' || turn AS case_id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS f FROM conversations), r AS (SELECT case_id, 0 AS depth FROM c WHERE f IS NULL UNION ALL SELECT c.case_id, depth + 1 FROM c JOIN r ON c.f = r.case_id) SELECT c.case_id, depth FROM c LEFT JOIN r ON r.case_id = c.case_id",
    "answerable_split": f"WITH {_QUESTIONS} SELECT count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS unanswerable FROM asked",
    "strip_annotations": f"WITH {_MARKED} SELECT video_id, idx, {_without_marks('text')} AS text FROM marked",
    "strip_speakers": "WITH " + _MARKED + " SELECT video_id, idx, " + _without_speakers("('>> ' || text)") + " AS text FROM marked",
    "clean_text": f"WITH {_MARKED} SELECT video_id, idx, {_cleaned('text')} AS text FROM marked WHERE {_cleaned('text')} <> ''",
    "rolling_overlap": f"WITH {_ROLLING}, s AS (SELECT video_id, idx, {_SQUEEZE.format('text')} AS text FROM rolled), p AS (SELECT *, string_split(lag(text) OVER (PARTITION BY video_id ORDER BY idx), ' ') AS a, string_split(text, ' ') AS b FROM s) SELECT video_id, idx, CASE WHEN a IS NULL THEN text ELSE array_to_string(b[{_OVERLAP} + 1:], ' ') END AS text FROM p",
    "rolling_dedup": _DEDUP,
    "cue_stream": _DEDUP,
    "normalise_rows": f"WITH {_CUES}, raw AS (SELECT video_id, idx, CASE WHEN idx % 4 <> 3 THEN start_s ELSE 0 END AS s, CASE WHEN idx % 4 <> 2 THEN end_s - start_s ELSE 0 END AS d, {_SQUEEZE.format('text')} AS text FROM cues WHERE idx % 5 <> 1) SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1)::INT AS idx, round(s, 6) AS start_s, round(s + d, 6) AS end_s, text FROM raw WHERE text <> ''",
    "timeline_offsets": f"WITH {_TIMELINE} SELECT video_id, seg_index, char_start, char_end, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM line",
    "time_at": f"WITH {_TIMELINE}, q AS (SELECT video_id, idx, greatest(idx * 173 - 20, 0) AS pos FROM cues) SELECT q.video_id, q.idx, seg_index, round(CASE WHEN pos <= char_start THEN t_start WHEN pos >= char_end THEN t_end ELSE t_start + (pos - char_start) / (char_end - char_start)::DOUBLE * (t_end - t_start) END, 6) AS time_s FROM q ASOF JOIN line l ON q.video_id = l.video_id AND q.pos >= l.char_start",
    "punctuation_density": "SELECT doc_id AS passage_id, round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[.!?]')) / length(text)::DOUBLE ELSE 0 END, 9) AS density FROM documents",
    "sentence_units": f"""WITH {_WORDS}, n AS (SELECT *, coalesce(sum(regexp_matches(word, '[.!?]+["'')\\]]*$')::INT) OVER (PARTITION BY video_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS unit FROM placed) SELECT video_id, unit, min(e - length(word))::INT AS char_start, max(e)::INT AS char_end FROM n GROUP BY ALL""",
    "word_windows": f"WITH {_WORDS} SELECT video_id, ((k - 1) // 28)::INT AS unit, min(e - length(word))::INT AS char_start, max(e)::INT AS char_end FROM placed GROUP BY ALL",
    "unit_strategy": f"WITH {_WORDS} SELECT video_id, CASE WHEN len(regexp_extract_all(text, '[.!?]')) / length(text)::DOUBLE >= 0.012 THEN 'sentences' ELSE 'windows' END AS strategy FROM whole",
    "hash_embed_md5": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), f AS (SELECT doc_id, md5(unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])))) AS h FROM t),
s AS (SELECT doc_id, ('0x' || h[1:8])::BIGINT % 384 AS bucket, sum(CASE WHEN h[9] >= '8' THEN -1 ELSE 1 END)::DOUBLE AS s FROM f GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(s * s)) AS n FROM s GROUP BY ALL)
SELECT doc_id AS passage_id, bucket::INT AS bucket, round(s / n, 6) AS x FROM s JOIN n USING (doc_id) WHERE round(s / n, 6) <> 0""",
    "format_timestamp": f"WITH {_CUES} SELECT video_id, idx, {_at(_whole('start_s * 20 - 5'))} AS at FROM cues",
    "timestamp_url": f"WITH {_CUES} SELECT video_id, idx, 'https://www.youtube.com/watch?v=' || video_id || '&t=' || greatest(0, trunc(start_s - 2))::BIGINT || 's' AS url FROM cues",
    "to_seconds": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 5) || ':' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN (event_id % 60) || ':' ELSE '' END || (event_id % 59) AS at, (CASE WHEN event_id % 3 = 0 THEN (event_id % 5) * CASE WHEN event_id % 2 = 0 THEN 3600 ELSE 60 END ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN (event_id % 60) * 60 ELSE 0 END + event_id % 59)::DOUBLE AS seconds FROM events",
    "parse_locator": f"WITH {_LOCATORS} SELECT page_id, CASE WHEN page_id % 9 < 7 THEN vid END AS video_id FROM ids",
    "parse_start_offset": "SELECT page_id, CASE page_id % 9 WHEN 1 THEN 3723 WHEN 2 THEN 763 WHEN 4 THEN 763 END::BIGINT AS start_s FROM pages",
    "slug_and_quote": f"WITH p AS (SELECT page_id, url, {_SQUEEZE.format('html')} AS h FROM pages) SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) AS slug, {_QUOTE.format('h')} AS quote FROM p",
    "extract_markers": "SELECT conv_id AS question_id, (['1,2', '9,2', '', '', '77', '3,1'])[(conv_id % 6 + 1)::INT] AS markers FROM conversations WHERE turn = 0",
    "context_budget": f"WITH {_CHAT} SELECT question_id, rank, block FROM used",
    "build_citations": f"""WITH {_CHAT}, p AS (SELECT *, {_SQUEEZE.format('text')} AS line FROM used) SELECT c.question_id, (row_number() OVER (PARTITION BY c.question_id ORDER BY c.p) - 1)::INT AS place, marker, passage_id, 'https://www.youtube.com/watch?v=' || video_id || '&t=' || floor(start_s)::BIGINT || 's' AS url, {_at(_whole('start_s'))} AS timestamp, {_QUOTE.format('line')} AS quote
FROM cited c JOIN p ON p.question_id = c.question_id AND p.rank + 1 = c.marker""",
    "valid_citation_text": f"WITH {_CHAT} SELECT question_id, cleaned, array_to_string(invalid, ',') AS invalid FROM tidy",
    "gate_a": f"WITH {_CHAT} SELECT question_id, round(confidence, 6) AS confidence, confidence < 0.28 AS refused FROM conf",
    "answer_gates": f"WITH {_CHAT} SELECT question_id, CASE WHEN layer IN ('A', 'B', 'C') THEN 'I cannot find this information in the video.' ELSE cleaned END AS text, coalesce(layer IN ('A', 'B', 'C'), false) AS refused, layer FROM layered",
    "retrieved_rule": f"WITH {_CHAT} SELECT c.question_id, c.rank, c.passage_id FROM chat c JOIN layered l ON l.question_id = c.question_id LEFT JOIN used u ON u.question_id = c.question_id AND u.rank = c.rank WHERE coalesce(layer IN ('A', 'B', 'C'), false) OR u.rank IS NOT NULL",
    "needs_rewrite": rf"""WITH q AS (SELECT conv_id, turn, trim(CASE WHEN turn % 4 = 2 THEN 'And ' || text WHEN conv_id % 5 = 0 THEN 'Why so?' ELSE text END) AS q FROM conversations WHERE role = 'user')
SELECT conv_id, turn, turn > 0 AND (len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')) <= 3 OR regexp_matches(q, '{_quoted(REFERENTIAL)}') OR regexp_matches(q, '{_quoted(CONTINUATION)}')) AS needed FROM q""",
    "history_window": f"WITH t AS (SELECT conv_id, turn, role, {_SQUEEZE.format('text')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id AS conversation_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(x) > 240 THEN substr(x, 1, 239) || '…' ELSE x END, chr(10) ORDER BY turn) AS history FROM t WHERE n <= 4 GROUP BY conv_id",
    "parse_judge_score": "SELECT doc_id, round(CASE doc_id % 5 WHEN 0 THEN least(1, (doc_id % 30) / 10.0::DOUBLE) WHEN 1 THEN (doc_id % 10) / 10.0::DOUBLE WHEN 4 THEN 1 ELSE 0 END, 6)::DOUBLE AS score FROM documents",
    "call_failures": "SELECT (['transient', 'exhausted', 'transient', 'exhausted', 'permanent'])[(event_id % 5 + 1)::INT] AS failure, count(*) AS n FROM events GROUP BY ALL",
    "prefer_track": f"WITH {_TRACKS}, one AS (SELECT video_id, language, kind, min(turn) AS turn FROM tracks GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY list_position(['manual', 'generated', 'translated', 'unknown'], kind), coalesce(list_position(['en', 'en-US', 'en-GB'], language), 4), language) AS n FROM one) SELECT video_id, language, kind, turn FROM r WHERE n = 1",
    "provider_chain": f"WITH {_TRACKS}, p AS (SELECT *, 0 AS provider FROM tracks WHERE kind = 'manual' UNION ALL SELECT *, 1 FROM tracks WHERE language = 'de' UNION ALL SELECT *, 2 FROM tracks) SELECT * FROM p WHERE (video_id, provider) IN (SELECT (video_id, min(provider)) FROM p GROUP BY video_id)",
    "metadata_fallback": """SELECT v.video_id, coalesce(CASE WHEN a.page_id % 3 = 0 THEN a.url END, b.p_name, 'Video ' || v.video_id) AS title, b.p_brand AS channel, a.page_id::DOUBLE AS duration_s FROM (SELECT DISTINCT conv_id::VARCHAR AS video_id, conv_id FROM conversations) v
LEFT JOIN pages a ON a.page_id = v.conv_id AND a.page_id % 2 = 0 LEFT JOIN part b ON b.p_partkey = v.conv_id AND b.p_partkey % 5 <> 0""",
    "segment_cache_upsert": f"WITH {_CUES} SELECT video_id, 'Talk ' || video_id || CASE WHEN video_id::INT % 2 = 0 THEN ' again' ELSE '' END AS title, round(max(CASE WHEN video_id::INT % 2 = 1 OR idx > 0 THEN end_s END), 6) AS duration_s, count(*) FILTER (video_id::INT % 2 = 1 OR idx > 0) AS n_segments FROM cues GROUP BY video_id",
    "cascade_delete": """WITH k AS (SELECT * FROM conversations WHERE conv_id % 3 <> 0), v AS (SELECT count(DISTINCT conv_id) AS v, count(*) AS c FROM k)
SELECT unnest(['videos', 'segments', 'chunk_sets', 'chunks', 'embedding_sets', 'embeddings', 'conversations', 'messages']) AS table_name, unnest([v, c, v, c, 0, 0, 0, 0]) AS n FROM v""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_sessions": """WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, island""",
    "snapshot_versions": f"""WITH {_CUES}, v AS (SELECT *, unnest([1, 2]) AS version FROM cues)
SELECT video_id, version, count(*) AS cues, round(max(end_s), 6) AS end_s, 'Talk ' || video_id || CASE WHEN version = 2 AND video_id::INT % 2 = 0 THEN ' cut' ELSE '' END AS title FROM v WHERE version = 1 OR video_id::INT % 2 = 1 OR idx <= 1 GROUP BY video_id, version""",
    "cue_overlaps": f"""WITH {_CUES}, s AS (SELECT video_id, idx AS span, start_s - 4 AS a, start_s - 4 + CASE WHEN idx % 10 = 0 THEN 10000 ELSE 3 + idx * 7 % 40 END AS b FROM cues)
SELECT c.video_id, c.idx, s.span, round(least(end_s, b) - greatest(start_s, a), 6) AS shared_s FROM cues c JOIN s ON c.video_id = s.video_id AND c.end_s > s.a AND s.b > c.start_s WHERE c.end_s > c.start_s""",
    "case_positions": """WITH RECURSIVE n AS (SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN turn + 1 WHEN 0 THEN turn - 1 END AS up FROM conversations),
c AS (SELECT n.conv_id, n.turn, m.turn AS up, n.conv_id * 1000 + n.turn AS place FROM n LEFT JOIN conversations m ON m.conv_id = n.conv_id AND m.turn = n.up),
line AS (SELECT conv_id, turn, up, place, turn AS own, 0 AS depth, place AS asked FROM c UNION ALL SELECT l.conv_id, l.turn, c.up, l.place, l.own, l.depth + 1, l.asked FROM line l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.up),
depths AS (SELECT conv_id, own, max(depth) AS depth FROM line GROUP BY ALL),
reach AS (SELECT c.conv_id, c.turn AS own, c.turn AS here, c.up, c.place AS asked FROM c UNION ALL SELECT r.conv_id, r.own, c.turn, c.up, r.asked FROM reach r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.up),
first AS (SELECT conv_id, here AS turn, min(asked) AS asked FROM reach GROUP BY ALL)
SELECT f.conv_id || '-' || f.turn AS case_id, row_number() OVER (ORDER BY f.asked, d.depth) - 1 AS position FROM first f JOIN depths d ON d.conv_id = f.conv_id AND d.own = f.turn""",
    "grouped_summaries": f"""WITH {_RESULTS}, tagged AS (SELECT * EXCLUDE (tags), unnest(list_filter([NULL, 'q' || (case_id % 3), 't', CASE WHEN case_id % 4 = 0 THEN 'four' END], lambda x, i: i = 1 OR x IS NOT NULL)) AS tag FROM (SELECT *, 0 AS tags FROM results)),
sided AS (SELECT * EXCLUDE (retriever), unnest([retriever, NULL]) AS retriever FROM tagged)
SELECT retriever, tag, count(*) AS cases, {', '.join(f'round(coalesce(avg({c}) FILTER (answerable), 0), 6) AS {c}' for c in ('recall_at_k', 'precision_at_k', 'mrr', 'ndcg_at_k'))},
  round(coalesce(avg(citation_precision) FILTER (answerable AND has_answer AND NOT refused), 0), 6) AS citation_precision, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('faithfulness', 'answer_relevance', 'correctness'))},
  round(coalesce(avg(refused::INT) FILTER (NOT answerable AND has_answer), 0), 6) AS correct_refusal_rate, round(coalesce(avg(refused::INT) FILTER (answerable AND has_answer), 0), 6) AS false_refusal_rate FROM sided GROUP BY retriever, tag""",
    "recent_talk": f"""WITH {_CUES}, f AS (SELECT video_id, idx, least(30, sum(end_s - start_s) OVER w) AS talk, avg(contains(text, 'the')::INT) OVER w AS hit FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY start_s RANGE BETWEEN 30 PRECEDING AND CURRENT ROW))
SELECT video_id, idx, round(talk / 30, 6) AS talk_share, round(hit, 6) AS hit_share, round(30 - talk, 6) AS silence_s FROM f""",
    "confidence_percent_ranks": f"""WITH {_CHAT}, c AS (SELECT question_id, rank AS place, CASE WHEN rank % 7 <> 6 THEN floor(confidence * 100) END AS confidence FROM chat)
SELECT question_id, place, round(percent_rank() OVER (ORDER BY confidence), 9) AS percent_rank FROM c WHERE confidence IS NOT NULL UNION ALL SELECT question_id, place, NULL FROM c WHERE confidence IS NULL""",
    "sketched_terms": f"WITH t AS (SELECT lang AS scope, unnest({_terms('text')}) AS term FROM documents), e AS (SELECT scope, count(DISTINCT term) AS terms FROM t GROUP BY scope), n AS (SELECT lang AS scope, count(*) AS n FROM documents GROUP BY lang) SELECT n.scope, n, terms, TRUE AS terms_near, TRUE AS median_near FROM n JOIN e ON e.scope = n.scope",
    "caption_tracks": f"WITH {_CUES}, t AS (SELECT *, {_SQUEEZE.format('text')} AS line FROM cues WHERE video_id::INT % 3 <> 0) SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1)::INT AS idx, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, line AS text FROM t WHERE line <> ''",
}
ORACLES["bm25_kept_index"] = ORACLES["bm25_topk"]
