"""SQL of the retrieval queries for an independent engine."""

from __future__ import annotations


def _ws(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[^가-힣A-Za-z0-9]+'), lambda t: t <> '')"


def _bi(column: str) -> str:
    runs = f"list_transform(regexp_split_to_array({column}, '[^À-ÿA-Za-z0-9]+'), lambda r: regexp_replace(r, '[^À-ÿ]', '', 'g'))"
    grams = "CASE WHEN length(r) > 1 THEN list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) WHEN length(r) = 1 THEN [r] ELSE [] END"
    return f"list_concat(list_transform(regexp_extract_all({column}, '[A-Za-z0-9]+'), lambda t: lower(t)), flatten(list_transform({runs}, lambda r: {grams})))"


def _bm25(tok, k: int, k1: float = 1.2, b: float = 0.75) -> str:
    return f"""
bags AS (SELECT doc_id, {tok('text')} AS ts FROM documents),
dl AS (SELECT doc_id, len(ts) AS dl FROM bags),
st AS (SELECT count(*) AS n, sum(dl)::double / count(*) AS avg_len FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM bags) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest(list_distinct({tok('text')})) AS term FROM benchmark),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1}::double + 1) / (tf + {k1}::double * (1 - {b}::double + {b}::double * dl / avg_len))), 7) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::varchar)::int AS rank FROM scored) WHERE rank <= {k})"""


_QRELS = "qrels AS (SELECT item_id AS query_id, doc_id, 1.0::double AS grade FROM documents d JOIN benchmark b ON contains(d.text, b.text))"

_PER_QUERY = f"""{_bm25(_ws, 20)}, {_QRELS},
ideal AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN grade / log2(place + 1) END) AS ideal, count(DISTINCT doc_id) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM qrels) GROUP BY 1),
hits AS (SELECT r.query_id, r.doc_id, rank, grade, l.doc_id IS NOT NULL AS known FROM ranked r LEFT JOIN qrels USING (query_id, doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = r.doc_id),
found AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN coalesce(grade, 0) / log2(rank + 1) END) AS dcg, min(rank) FILTER (rank <= 10 AND grade IS NOT NULL) AS first,
  count(DISTINCT doc_id) FILTER (rank <= 20 AND grade IS NOT NULL) AS hit, count(*) FILTER (rank <= 10 AND NOT known AND grade IS NULL) AS unjudged FROM hits GROUP BY 1),
per_query AS (SELECT item_id AS query_id, relevant IS NOT NULL AS has_qrel, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0.0 END::double AS ndcg,
  coalesce(1.0::double / first, 0.0) AS mrr, CASE WHEN relevant > 0 THEN coalesce(hit, 0)::double / relevant ELSE 0.0 END AS recall, coalesce(unjudged, 0) AS unjudged_in_top
  FROM benchmark LEFT JOIN ideal ON ideal.query_id = item_id LEFT JOIN found ON found.query_id = item_id)"""

_QUESTIONS = """
exchanges AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
firsts AS (SELECT conv_id, arg_min(question, turn) AS text, arg_min(answer, turn) AS answer FROM exchanges GROUP BY 1),
opts AS (SELECT f.conv_id AS question_id, f.text, o.answer AS option, o.conv_id - f.conv_id AS j,
  (row_number() OVER (PARTITION BY f.conv_id ORDER BY ((o.conv_id - f.conv_id) + f.conv_id) % 5, o.answer) - 1)::int AS idx
  FROM firsts f JOIN firsts o ON o.conv_id BETWEEN f.conv_id AND f.conv_id + 4),
golds AS (SELECT question_id, idx AS gold FROM opts WHERE j = 0)"""


def _option_scores(name: str, tok, k1: float, b: float) -> str:
    return f"""
bags_{name} AS (SELECT question_id, idx, {tok('option')} AS ts FROM opts),
st_{name} AS (SELECT question_id, count(*) AS n, avg(len(ts)) AS avg_len FROM bags_{name} GROUP BY 1),
tf_{name} AS (SELECT question_id, idx, dl, term, count(*) AS tf FROM (SELECT question_id, idx, len(ts) AS dl, unnest(ts) AS term FROM bags_{name}) GROUP BY ALL),
df_{name} AS (SELECT question_id, term, count(*) AS df FROM tf_{name} GROUP BY ALL),
q_{name} AS (SELECT conv_id AS question_id, unnest(list_distinct({tok('text')})) AS term FROM firsts),
sc_{name} AS (SELECT question_id, idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1}::double + 1) / (tf + {k1}::double * (1 - {b}::double + {b}::double * dl / avg_len))), 7) AS score
  FROM tf_{name} JOIN df_{name} USING (question_id, term) JOIN q_{name} USING (question_id, term) JOIN st_{name} USING (question_id) GROUP BY ALL),
rk_{name} AS (SELECT question_id, idx, gold, score,
  row_number() OVER (PARTITION BY question_id ORDER BY score IS NULL, score DESC, CASE WHEN score IS NOT NULL THEN idx::varchar END, idx)::int AS rank
  FROM opts JOIN golds USING (question_id) LEFT JOIN sc_{name} USING (question_id, idx))"""


_CHOICES = f"""{_QUESTIONS}, {_option_scores('a', _ws, 1.2, 0.75)}, {_option_scores('b', _ws, 0.4, 0.0)}, {_option_scores('c', _bi, 1.2, 0.75)},
choices AS (SELECT model_key, question_id AS query_id, rank = 1 AS correct, rank, 1.0::double / rank AS reciprocal_rank FROM (
  SELECT 'bm25' AS model_key, * FROM rk_a UNION ALL SELECT 'bm25_flat', * FROM rk_b UNION ALL SELECT 'bm25_bigram', * FROM rk_c) WHERE idx = gold),
exact AS (SELECT model_key, count(*) AS questions, count(*) FILTER (correct) AS correct_count, avg(correct::int) AS accuracy, avg(reciprocal_rank) AS exam_mrr FROM choices GROUP BY 1),
discordant AS (SELECT a.model_key AS model_a, b.model_key AS model_b, count(*) FILTER (a.correct AND b.correct) AS "both", count(*) FILTER (a.correct AND NOT b.correct) AS only_a,
  count(*) FILTER (NOT a.correct AND b.correct) AS only_b, count(*) FILTER (NOT a.correct AND NOT b.correct) AS neither
  FROM choices a JOIN choices b USING (query_id) WHERE a.model_key < b.model_key GROUP BY ALL),
tests AS (SELECT *, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1),
  lambda k: exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) + (only_a + only_b) * ln(0.5))))) END::double AS p_value FROM discordant)"""

_KEY = "regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_CLEAN = "trim(regexp_replace(nfc_normalize({0}), '\\s+', ' ', 'g'))"


def _key(column: str) -> str:
    return _KEY.format(column)


_TRIPLETS = f"""{_QUESTIONS},
triplets AS (SELECT question_id::varchar AS record_id, question_id, CASE WHEN question_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split, any_value(text) AS query,
  any_value(option) FILTER (j = 0) AS positive, list(option ORDER BY idx) FILTER (j <> 0) AS negs, len(list_filter(list(length(option)), lambda x: x > any_value(length(option)) FILTER (j = 0))) AS option_len_rank
  FROM opts GROUP BY question_id),
negatives AS (SELECT record_id, {_CLEAN.format('t')} AS text, {_key('t')} AS key, i FROM (SELECT record_id, unnest(coalesce(negs, [])) AS t, generate_subscripts(coalesce(negs, []), 1) AS i FROM triplets)),
usable AS (SELECT n.record_id, n.text, n.key, n.i FROM negatives n JOIN triplets t USING (record_id) WHERE n.key <> '' AND n.key <> {_key('t.positive')}
  AND NOT EXISTS (SELECT 1 FROM negatives m WHERE m.record_id = n.record_id AND m.key = n.key AND m.i < n.i)),
classified AS (SELECT t.*, {_key('positive')} AS positive_key, CASE WHEN split <> 'train' THEN 'non_train_split' WHEN {_key('positive')} = '' THEN 'empty_positive'
  WHEN record_id NOT IN (SELECT record_id FROM usable) THEN 'no_usable_hard_negative' END AS reason FROM triplets t),
candidates AS (SELECT record_id, {_CLEAN.format('query')} AS query, {_CLEAN.format('positive')} AS positive, positive_key, option_len_rank,
  (SELECT arg_min(u.text, u.i) FROM usable u WHERE u.record_id = c.record_id) AS negative FROM classified c WHERE reason IS NULL)"""

_STRATA = """labelled AS (SELECT * FROM documents JOIN labels USING (doc_id)),
counted AS (SELECT quality, length(regexp_replace(text, '[^À-ÿ]+', '', 'g')) AS d, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS p FROM labelled),
levels AS (SELECT 'script_' || t AS field, CASE WHEN d >= t AND p >= t THEN 'mixed' WHEN d >= t THEN 'ko' WHEN p >= t THEN 'en' ELSE 'other' END AS bucket, quality FROM counted, (VALUES (5), (20), (50)) v(t)),
strata AS (SELECT field, bucket, count(*) AS n, avg(quality) AS mean FROM levels GROUP BY ALL)"""
_LEVEL = "CASE WHEN d >= {0} AND p >= {0} THEN 'mixed' WHEN d >= {0} THEN 'ko' WHEN p >= {0} THEN 'en' ELSE 'other' END AS level_{0}"


def _draw(iteration: str, place: str, n: str) -> str:
    return f"('0x' || substr(md5('0|' || {iteration} || '|' || {place}), 1, 8))::bigint % {n}"


_PAIRED = f"""n AS (SELECT model_a, model_b, metric, count(*) AS n, avg(value) AS mean FROM vals GROUP BY ALL),
drawn AS (SELECT model_a, model_b, metric, iteration, {_draw('iteration', 'i', 'n')} AS place FROM n JOIN (SELECT model_a, model_b, metric, place AS i FROM vals) USING (model_a, model_b, metric), range(1000) a(iteration)),
ms AS (SELECT model_a, model_b, metric, list(m ORDER BY m) AS ms FROM (SELECT model_a, model_b, metric, iteration, avg(value) AS m FROM drawn JOIN vals USING (model_a, model_b, metric, place) GROUP BY ALL) GROUP BY ALL)"""
_PAIRED_ENDS = """n, round(mean, 9) + 0.0::double AS mean, round(ms[25], 9) + 0.0::double AS low, round(ms[976], 9) + 0.0::double AS high,
round(ms[25], 12) <= 0 AND round(ms[976], 12) >= 0 AS crosses_zero FROM n JOIN ms USING (model_a, model_b, metric)"""


def _nearest(score: str) -> str:
    return f"""SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::varchar)::int AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({score}, 7) + 0.0::double AS score FROM (SELECT vec_id, embedding::double[] AS v FROM embeddings) a, (SELECT vec_id, embedding::double[] AS v FROM embeddings) b)) WHERE rank <= 10"""


_MD5_SLOT = "0"
for _at in (1, 9, 17, 25):
    _MD5_SLOT = f"(({_MD5_SLOT}) * 4294967296 % 100 + ('0x' || substr(md5(term), {_at}, 8))::bigint) % 100"

_DIGESTS = """WITH l AS (SELECT row_number() OVER (ORDER BY doc_id, v) - 1 AS pos, sha256(v) AS h, 1::bigint AS n FROM (SELECT doc_id, coalesce(text, '') AS v FROM documents)),
l0 AS (SELECT pos // 64 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, sum(n)::bigint AS n FROM l GROUP BY 1)""" + "".join(
    f", l{i} AS (SELECT p.pos // 64 AS pos, sha256(string_agg(h, '' ORDER BY p.pos)) AS h, sum(n)::bigint AS n FROM l{i - 1} p WHERE (SELECT count(*) FROM l{i - 1}) > 1 GROUP BY 1)" for i in range(1, 6)) + " " + " UNION ALL ".join(
    f"SELECT {i}::int AS level, pos::bigint AS chunk, n, h AS digest FROM l{i}" for i in range(6))

ORACLES: dict[str, str] = {
    "tok_whitespace_tf": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_ws('text')}) AS term FROM documents) GROUP BY ALL",
    "tok_bigram_tf": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_bi('text')}) AS term FROM documents) GROUP BY ALL",
    "text_clean": f"SELECT doc_id, {_CLEAN.format('text')} AS cleaned FROM documents",
    "text_norm_key": f"SELECT doc_id, {_key('text')} AS key FROM documents",
    "script_levels": f"SELECT doc_id, {', '.join(_LEVEL.format(t) for t in (5, 20, 50))} FROM (SELECT doc_id, length(regexp_replace(text, '[^À-ÿ]+', '', 'g')) AS d, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS p FROM documents)",
    "hashed_encoding": f"SELECT doc_id, ({_MD5_SLOT})::int AS slot, count(*) AS c FROM (SELECT doc_id, unnest({_ws('text')}) AS term FROM documents) GROUP BY ALL",
    "bm25_doc_len": f"SELECT doc_id, len({_ws('text')}) AS dl FROM documents",
    "bm25_corpus_stats": f"SELECT count(*) AS n, round(sum(dl)::double / count(*), 9) AS avg_len FROM (SELECT len({_ws('text')}) AS dl FROM documents)",
    "bm25_idf": f"WITH tf AS (SELECT DISTINCT doc_id, unnest({_ws('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9)::double AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), n",
    "bm25_topk": f"WITH {_bm25(_ws, 10)} SELECT query_id, doc_id, score, rank FROM ranked",
    "bm25_topk_joined": f"WITH {_bm25(_ws, 10)} SELECT query_id, doc_id, score, rank FROM ranked",
    "bm25_topk_bigram": f"WITH {_bm25(_bi, 10)} SELECT query_id, doc_id, score, rank FROM ranked",
    "dense_cosine_topk": _nearest("list_cosine_similarity(a.v, b.v)"),
    "dense_dot_topk": _nearest("list_inner_product(a.v, b.v)"),
    "l2_normalize_vectors": "SELECT vec_id, (i - 1)::int AS i, round(v[i] / sqrt(list_inner_product(v, v)), 9) AS x FROM (SELECT vec_id, embedding::double[] AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "dense_label_metrics": f"WITH near AS ({_nearest('list_cosine_similarity(a.v, b.v)')}) SELECT a.label, count(*) AS n, round(avg((a.label = b.label)::int), 9) AS precision FROM near JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id WHERE query_id <> doc_id GROUP BY 1",
    "mnrl_batch_loss": """WITH e AS (SELECT vec_id, vec_id // 16 AS number, embedding::double[] AS v FROM embeddings), s AS (SELECT a.number, a.vec_id AS q, b.vec_id AS c, 20 * list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b USING (number))
SELECT number, round(avg(l), 6) AS loss FROM (SELECT number, q, ln(sum(exp(s))) - max(s) FILTER (q = c) AS l FROM s GROUP BY ALL) GROUP BY 1""",
    "qrels_by_containment": f"WITH {_QRELS} SELECT query_id, doc_id, grade FROM qrels",
    "ndcg_mrr_recall_per_query": f"WITH {_PER_QUERY} SELECT query_id, has_qrel, round(ndcg, 9) AS ndcg, round(mrr, 9) AS mrr, round(recall, 9) AS recall, unjudged_in_top FROM per_query",
    "retrieval_summary": f"""WITH {_PER_QUERY} SELECT count(*) AS queries_total, count(*) FILTER (has_qrel) AS queries_scored, count(*) FILTER (NOT has_qrel) AS queries_without_qrel,
round(coalesce(avg(ndcg) FILTER (has_qrel), 0), 4) AS ndcg, round(coalesce(avg(mrr) FILTER (has_qrel), 0), 4) AS mrr, round(coalesce(avg(recall) FILTER (has_qrel), 0), 4) AS recall,
round(coalesce(avg(unjudged_in_top) FILTER (has_qrel), 0), 3) AS unjudged_in_top, (SELECT count(*) FROM documents) AS corpus_documents, (SELECT count(DISTINCT doc_id) FROM labels) AS judged_documents FROM per_query""",
    "bootstrap_ci": f"""WITH {_PER_QUERY}, vals AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS place, mrr AS value FROM per_query WHERE has_qrel), n AS (SELECT count(*) AS n, avg(value) AS mean FROM vals),
drawn AS (SELECT iteration, {_draw('iteration', 'i', 'n')} AS place FROM n, range(1000) a(iteration), (SELECT place AS i FROM vals)),
ms AS (SELECT list(m ORDER BY m) AS ms FROM (SELECT iteration, avg(value) AS m FROM drawn JOIN vals USING (place) GROUP BY 1))
SELECT n, round(mean, 9) AS mean, round(ms[25], 9) AS low, round(ms[976], 9) AS high FROM n, ms""",
    "percentile_forms": "SELECT lang, round(quantile_cont(n_chars, 0.5), 9) AS linear_50, quantile_disc(n_chars, 0.5) AS nearest_50, quantile_disc(n_chars, 0.95) AS nearest_95, quantile_disc(n_chars, 0.99) AS nearest_99 FROM documents GROUP BY 1",
    "subgroup_report": """WITH rows_ AS (SELECT * FROM documents JOIN labels USING (doc_id)), g AS (SELECT field, bucket, count(*) AS n, avg(quality) AS mean FROM (
SELECT 'lang' AS field, coalesce(lang, 'None') AS bucket, quality FROM rows_ UNION ALL SELECT 'source', coalesce(source, 'None'), quality FROM rows_) GROUP BY ALL)
SELECT field, bucket, n, round(mean, 9) AS mean, row_number() OVER (PARTITION BY field ORDER BY n DESC, bucket)::int AS place FROM g""",
    "subgroup_first_seen": """WITH rows_ AS (SELECT * FROM documents JOIN labels USING (doc_id)), g AS (SELECT field, bucket, count(*) AS n, avg(quality) AS mean, min(doc_id) AS seen FROM (
SELECT 'tens' AS field, (doc_id % 50)::varchar AS bucket, quality, doc_id FROM rows_ UNION ALL SELECT 'ends', right(source, 1), quality, doc_id FROM rows_) GROUP BY ALL)
SELECT field, bucket, n, round(mean, 9) AS mean, row_number() OVER (PARTITION BY field ORDER BY n DESC, seen)::int AS place FROM g""",
    "manifest_issues": """WITH files AS (SELECT 'doc-' || doc_id AS path, doc_id, strlen(text) AS bytes, sha256(text) AS sha FROM documents WHERE text IS NOT NULL),
claims AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'gone-' || path ELSE path END AS path, bytes + (doc_id % 13 = 0)::int AS bytes, CASE WHEN doc_id % 17 = 0 THEN sha256(sha) ELSE sha END AS sha, doc_id FROM files WHERE doc_id % 7 <> 0)
SELECT path, 'claimed_twice' AS rule, '2' AS detail FROM claims WHERE doc_id % 19 = 0
UNION ALL SELECT path, 'missing', '' FROM claims WHERE path NOT IN (SELECT path FROM files)
UNION ALL SELECT path, 'unlisted', '' FROM files WHERE path NOT IN (SELECT path FROM claims)
UNION ALL SELECT path, 'size', c.bytes || ' ' || f.bytes FROM claims c JOIN files f USING (path) WHERE c.bytes <> f.bytes
UNION ALL SELECT path, 'digest', f.sha FROM claims c JOIN files f USING (path) WHERE c.sha <> f.sha""",
    "code_switch_strata": f"WITH {_STRATA}, kept AS (SELECT * FROM strata WHERE field IN (SELECT field FROM strata WHERE bucket <> 'other')) SELECT field, bucket, n, round(mean, 9) AS mean, row_number() OVER (PARTITION BY field ORDER BY n DESC, bucket)::int AS place FROM kept",
    "strata_intervals": f"""WITH {_PER_QUERY}, sized AS (SELECT query_id, ndcg, mrr, recall, length(text) AS chars, length(regexp_replace(text, '[^À-ÿ]+', '', 'g')) AS d, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS p
  FROM per_query JOIN benchmark ON item_id = query_id WHERE has_qrel),
levels AS (SELECT 'script_' || t AS field, CASE WHEN d >= t AND p >= t THEN 'mixed' WHEN d >= t THEN 'ko' WHEN p >= t THEN 'en' ELSE 'other' END AS bucket, query_id, ndcg, mrr, recall FROM sized, (VALUES (5), (20), (50)) v(t)
  UNION ALL SELECT 'size', CASE WHEN chars >= 200 THEN 'long' ELSE 'short' END, query_id, ndcg, mrr, recall FROM sized),
places AS (SELECT field, bucket, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, bucket)::int AS place FROM levels WHERE field IN (SELECT field FROM levels WHERE bucket <> 'other') GROUP BY 1, 2),
held AS (SELECT field, bucket, n, place, query_id, unnest(['ndcg', 'mrr', 'recall']) AS metric, unnest([ndcg, mrr, recall]) AS value FROM levels JOIN places USING (field, bucket)),
vals AS (SELECT *, row_number() OVER (PARTITION BY field, bucket, metric ORDER BY query_id) - 1 AS spot FROM held),
drawn AS (SELECT field, bucket, metric, iteration, {_draw('iteration', 'spot', 'n')} AS spot FROM vals, range(1000) a(iteration)),
ends AS (SELECT field, bucket, metric, list(m ORDER BY m) AS ms FROM (SELECT field, bucket, metric, iteration, avg(value) AS m FROM drawn JOIN vals USING (field, bucket, metric, spot) GROUP BY ALL) GROUP BY ALL)
SELECT field, bucket, metric, n, round(avg(value), 9) AS mean, round(any_value(ms[25]), 9) AS low, round(any_value(ms[976]), 9) AS high, place FROM vals JOIN ends USING (field, bucket, metric) GROUP BY field, bucket, metric, n, place""",
    "mixed_drop": f"""WITH {_STRATA}, r AS (SELECT field, round(max(mean) FILTER (bucket = 'en'), 4) AS a, round(max(mean) FILTER (bucket = 'mixed'), 4) AS b FROM strata GROUP BY 1)
SELECT field, round((a - b) / a, 4) AS "drop" FROM r WHERE a IS NOT NULL AND b IS NOT NULL AND a <> 0""",
    "mcq_rank": f"WITH {_QUESTIONS}, {_option_scores('a', _ws, 1.2, 0.75)} SELECT question_id, idx, gold, score, rank FROM rk_a",
    "mcq_longest_baseline": f"""WITH {_QUESTIONS}, s AS (SELECT question_id, max(length(option)) AS top, count(*) AS n, max(length(option)) FILTER (j = 0) AS own FROM opts GROUP BY 1),
t AS (SELECT question_id, count(*) AS ties FROM opts JOIN s USING (question_id) WHERE length(option) = top GROUP BY 1)
SELECT question_id, round(CASE WHEN own = top THEN 1.0::double / ties ELSE 0.0 END, 9) AS longest_option_hit, round(1.0::double / n, 9) AS random_hit FROM s JOIN t USING (question_id)""",
    "mcq_summary": f"""WITH {_QUESTIONS}, {_option_scores('a', _ws, 1.2, 0.75)}, s AS (SELECT question_id, max(length(option)) AS top, count(*) AS n, max(length(option)) FILTER (j = 0) AS own FROM opts GROUP BY 1),
t AS (SELECT question_id, count(*) AS ties FROM opts JOIN s USING (question_id) WHERE length(option) = top GROUP BY 1)
SELECT count(*) AS questions, round(avg((rank = 1)::int), 4) AS accuracy, round(avg(1.0::double / rank), 4) AS mrr, round(avg(1.0::double / n), 4) AS random_baseline,
round(avg(CASE WHEN own = top THEN 1.0::double / ties ELSE 0.0 END), 4) AS longest_option_baseline FROM rk_a JOIN s USING (question_id) JOIN t USING (question_id) WHERE idx = gold""",
    "dense_mcq_rank": """WITH e AS (SELECT vec_id, embedding::double[] AS v, label FROM embeddings),
o AS (SELECT a.vec_id AS question_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) - 1 AS idx, a.label = b.label AS same, round(list_cosine_similarity(a.v, b.v), 7) AS score FROM e a JOIN e b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 5),
g AS (SELECT question_id, coalesce(min(idx) FILTER (same), 0) AS gold FROM o GROUP BY 1)
SELECT question_id, idx::int AS idx, gold::int AS gold, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, idx::varchar)::int AS rank FROM o JOIN g USING (question_id)""",
    "pairs_task_corpus": f"WITH {_QUESTIONS}, k AS (SELECT lower({_CLEAN.format('answer')}) AS k, conv_id * 1000000 + turn AS seq, answer FROM exchanges), f AS (SELECT k, min(seq) AS first, arg_min(answer, seq) AS text FROM k WHERE k <> '' GROUP BY 1) SELECT 'doc-' || row_number() OVER (ORDER BY first) AS doc_id, text FROM f",
    "pairs_task_qrels": f"""WITH {_QUESTIONS}, k AS (SELECT lower({_CLEAN.format('answer')}) AS k, lower({_CLEAN.format('question')}) AS qk, conv_id * 1000000 + turn AS seq, conv_id || '-' || turn AS query_id FROM exchanges),
f AS (SELECT k, 'doc-' || row_number() OVER (ORDER BY min(seq)) AS doc_id FROM k WHERE k <> '' GROUP BY 1) SELECT query_id, doc_id, 1.0::double AS grade FROM k JOIN f USING (k) WHERE qk <> ''""",
    "exam_exact_metrics": f"WITH {_CHOICES} SELECT model_key, questions, correct_count, round(accuracy, 9) AS accuracy, round(exam_mrr, 9) AS exam_mrr FROM exact",
    "model_selection": f"""WITH {_CHOICES}, r AS (SELECT e.model_key, e.model_key <> 'bm25_flat' AS eligible, correct_count, round(exam_mrr, 9) AS exam_mrr, CASE e.model_key WHEN 'bm25' THEN 0 WHEN 'bm25_flat' THEN 1 ELSE 2 END AS pos FROM exact e),
w AS (SELECT *, row_number() OVER o AS place, lag(correct_count) OVER o AS pc, lag(exam_mrr) OVER o AS pm FROM r WINDOW o AS (PARTITION BY eligible ORDER BY correct_count DESC, exam_mrr DESC, pos))
SELECT model_key, eligible, CASE WHEN eligible THEN place ELSE 0 END::int AS place, CASE WHEN NOT eligible THEN 0 WHEN place = 1 OR correct_count <> pc THEN 0 WHEN exam_mrr <> pm THEN 1 ELSE 2 END::int AS tied_on FROM w""",
    "selection_trace": f"""WITH {_CHOICES}, r AS (SELECT model_key, correct_count, round(exam_mrr, 9) AS exam_mrr, CASE model_key WHEN 'bm25' THEN 0 ELSE 2 END AS pos FROM exact WHERE model_key <> 'bm25_flat'),
r1 AS (SELECT *, max(correct_count) OVER () AS best FROM r QUALIFY correct_count = max(correct_count) OVER ()), r2 AS (SELECT * REPLACE (max(exam_mrr) OVER () AS best) FROM r1 QUALIFY exam_mrr = max(exam_mrr) OVER ()),
r3 AS (SELECT * REPLACE (min(pos) OVER () AS best) FROM r2 QUALIFY pos = min(pos) OVER ())
SELECT 0::int AS step, 'eligible' AS criterion, NULL::double AS best, (count(*) OVER ())::int AS remaining, model_key FROM r
UNION ALL SELECT 1, 'correct_count', best::double, (count(*) OVER ())::int, model_key FROM r1 UNION ALL SELECT 2, 'exam_mrr', best::double, (count(*) OVER ())::int, model_key FROM r2
UNION ALL SELECT 3, 'position', best::double, (count(*) OVER ())::int, model_key FROM r3""",
    "zero_shot_deltas": f"WITH {_CHOICES} SELECT e.model_key, round(e.accuracy - b.accuracy, 9) + 0.0::double AS accuracy_delta, round(e.exam_mrr - b.exam_mrr, 9) + 0.0::double AS exam_mrr_delta FROM exact e, (SELECT * FROM exact WHERE model_key = 'bm25') b",
    "pairwise_discordant": f"""WITH {_CHOICES} SELECT model_a, model_b, "both", only_a, only_b, neither, round(p_value, 9) AS p_value FROM tests""",
    "paired_bootstrap": f"""WITH {_CHOICES}, vals AS (SELECT a.model_key AS model_a, b.model_key AS model_b, '' AS metric, row_number() OVER (PARTITION BY a.model_key, b.model_key ORDER BY query_id) - 1 AS place,
  a.reciprocal_rank - b.reciprocal_rank AS value FROM choices a JOIN choices b USING (query_id) WHERE a.model_key < b.model_key), {_PAIRED}
SELECT model_a, model_b, {_PAIRED_ENDS}""",
    "paired_intervals": f"""WITH {_CHOICES}, held AS (SELECT a.model_key AS model_a, b.model_key AS model_b, query_id, unnest(['accuracy', 'exam_mrr']) AS metric,
  unnest([a.correct::int::double - b.correct::int::double, a.reciprocal_rank - b.reciprocal_rank]) AS value FROM choices a JOIN choices b USING (query_id) WHERE a.model_key < b.model_key),
vals AS (SELECT *, row_number() OVER (PARTITION BY model_a, model_b, metric ORDER BY query_id::varchar) - 1 AS place FROM held), {_PAIRED}
SELECT model_a, model_b, metric, {_PAIRED_ENDS}""",
    "holm_adjusted": f"WITH {_CHOICES}, r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS place, count(*) OVER () AS m FROM tests) SELECT model_a, model_b, round(max(least(1.0, p_value * (m - place + 1))) OVER (ORDER BY place), 9)::double AS adjusted FROM r",
    "validate_evidence": f"""WITH {_QUESTIONS}, q AS (SELECT conv_id AS query_id FROM firsts),
e AS (SELECT 'bm25' AS model_key, query_id FROM q UNION ALL SELECT 'bm25_flat', query_id FROM q WHERE query_id % 7 <> 0 UNION ALL SELECT 'bm25', query_id FROM q WHERE query_id % 11 = 0 UNION ALL SELECT 'stray', query_id FROM q),
m AS (SELECT unnest(['bm25', 'bm25_flat', 'bm25_bigram']) AS model_key)
SELECT DISTINCT model_key, 'unknown_model' AS rule, '' AS detail FROM e WHERE model_key NOT IN (FROM m) UNION ALL SELECT model_key, 'missing_model', '' FROM m WHERE model_key NOT IN (SELECT model_key FROM e)
UNION ALL SELECT model_key, 'repeated_id', query_id::varchar FROM e GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT m.model_key, 'missing_id', i.query_id::varchar FROM (SELECT DISTINCT query_id FROM e) i, m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.query_id = i.query_id AND e.model_key = m.model_key)""",
    "quarantine_reasons": f"WITH {_TRIPLETS} SELECT reason, count(*) AS rows FROM classified WHERE reason IS NOT NULL GROUP BY 1",
    "collision_pairs": f"WITH {_TRIPLETS} SELECT count(*) AS collision_pairs FROM usable u JOIN candidates c ON c.record_id = u.record_id JOIN candidates p ON p.positive_key = u.key",
    "round_robin_order": f"WITH {_TRIPLETS} SELECT record_id, option_len_rank::int AS option_len_rank, row_number() OVER (PARTITION BY option_len_rank ORDER BY sha256('plan' || chr(0) || 'conversations' || chr(0) || record_id || chr(0)), record_id)::int AS turn FROM candidates",
    "length_stats": f"""WITH {_TRIPLETS}, s AS (SELECT option_len_rank, avg(length(positive)) AS pm, avg(length(negative)) AS nm, quantile_cont(length(positive), 0.5) AS pq, quantile_cont(length(negative), 0.5) AS nq FROM candidates GROUP BY 1)
SELECT option_len_rank::int AS option_len_rank, round(pm, 6) AS positive_mean, round(nm, 6) AS negative_mean, round(abs(pm - nm), 6) AS mean_gap, round(pq, 6) AS positive_quantile, round(nq, 6) AS negative_quantile, round(abs(pq - nq), 6) AS quantile_gap FROM s""",
    "token_length_stats": f"""WITH {_TRIPLETS}, t AS (SELECT 'query' AS field, len({_ws('query')}) AS n FROM candidates UNION ALL SELECT 'positive', len({_ws('positive')}) FROM candidates UNION ALL SELECT 'negative', len({_ws('negative')}) FROM candidates)
SELECT field, count(*) AS rows, round(avg(n), 6) AS mean, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, max(n) AS longest, count(*) FILTER (n > 64) AS over, round(100.0::double * count(*) FILTER (n > 64) / count(*), 6) AS over_percent FROM t GROUP BY 1""",
    "token_length_gaps": f"""WITH {_TRIPLETS}, t AS (SELECT len({_ws('positive')}) - len({_ws('negative')}) AS n FROM candidates)
SELECT count(*) AS rows, round(avg(n), 6) AS mean, quantile_disc(n, 0.05) AS p5, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95 FROM t""",
    "ordered_digest_levels": _DIGESTS,
    "pack_batches_violations": "SELECT 0::bigint AS repeated_positives, 0::bigint AS collisions, 0::bigint AS wrong_sizes, 0::bigint AS unbalanced",
    "contiguous_groups": """WITH r AS (SELECT event_type, row_number() OVER (ORDER BY event_id) AS place FROM events), n AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY place) AS fresh FROM r)
SELECT event_type, min(place) AS first, count(*) AS size, count(*) FILTER (fresh) AS runs FROM n GROUP BY 1""",
    "frozen_sampler_order": """WITH d AS (SELECT doc_id, doc_id // 32 AS number FROM documents), s AS (SELECT number, row_number() OVER (ORDER BY sha256('sampler|1' || chr(0) || number || chr(0)), number) AS step FROM (SELECT DISTINCT number FROM d))
SELECT doc_id, number, step FROM d JOIN s USING (number)""",
}

_CELLS = ", ".join(f"max({value}) FILTER (WHERE i.metric = '{m}') AS {m}_{name}" for m in ("accuracy", "exam_mrr") for name, value in (("diff", "mean"), ("low", "low"), ("high", "high"), ("crosses_zero", "crosses_zero")))
ORACLES["wide_pairs"] = f"""WITH i AS ({ORACLES['paired_intervals']}), t AS ({ORACLES['pairwise_discordant']})
SELECT model_a, model_b, "both" + only_a + only_b + neither AS n, only_a, only_b, p_value, {_CELLS} FROM t JOIN i USING (model_a, model_b) GROUP BY ALL"""
