"""SQL of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality import ANY, COMMON_WORDS, QualityRules

_R = QualityRules()

MIXING = """
WITH counts AS (SELECT coalesce(source, '') AS s, count(*)::double AS n FROM documents GROUP BY 1),
rates AS (SELECT s, (sum(n) OVER ()) * (n ** 0.5 / sum(n ** 0.5) OVER ()) / n AS rate FROM counts),
cdf AS (SELECT s, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c FROM rates, range(0, 400) r(k)),
tables AS (SELECT s, rate, list(c ORDER BY k) AS cs FROM cdf GROUP BY ALL),
drawn AS (
  SELECT d.*, rate, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('17|count|' || coalesce(doc_id::varchar, 'null') || '|0'), 1, 13))::bigint / 4503599627370496.0)) AS copies
  FROM documents d JOIN tables ON coalesce(source, '') = s),
copied AS (SELECT * EXCLUDE (copies), unnest(range(copies))::int AS copy FROM drawn)
SELECT * EXCLUDE (rate), round(rate, 6) AS rate,
  ('0x' || substr(md5('17|order|' || coalesce(doc_id::varchar, 'null') || '|' || copy), 1, 13))::bigint / 4503599627370496.0 AS mix_key
FROM copied
"""

TOPK = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score FROM fine q JOIN fine c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM scored) WHERE rank <= 5
"""

_LISTS = ", ".join(f"({i}, '{lang}', {j}, '{w}')" for i, (lang, ws) in enumerate(COMMON_WORDS.items()) for j, w in enumerate(ws))
_N = max(map(len, COMMON_WORDS.values()))


def _distance(p: str, q: str, n: str) -> str:
    half = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((p[i] + q[i]) / 2)) ELSE 0 END"
    return (f"(SELECT sqrt(greatest(0, sum(({half.format('p[i]')} + {half.format('q[i]')}) / 2))) FROM (SELECT {p} AS p, {q} AS q, unnest(range(1, {n} + 1)) AS i))")


def _judged(name: str, refs: str) -> str:
    return f"""{name} AS (SELECT *, coalesce(class_distance, 0) > {_R.max_class_distance} OR coalesce(word_distance, 0) > {_R.max_word_distance} AS off FROM (
  SELECT c.*, CASE WHEN class_ref IS NOT NULL AND list_sum(classes) >= {_R.min_class_chars} THEN {_distance('shares', 'class_ref', '6')} END AS class_distance,
    CASE WHEN word_ref IS NOT NULL AND list_sum(histogram) >= {_R.min_common_words} THEN {_distance('word_shares', 'word_ref', 'len(word_shares)')} END AS word_distance
  FROM counts c LEFT JOIN {refs} USING (language)))"""


def _references(name: str, source: str) -> str:
    each = f"""SELECT {{0}} AS language, list_transform(range(1, 7), lambda i: list_sum(list_transform(list(classes), lambda c: c[i]))) AS cs,
    list_transform(range(1, {_N} + 1), lambda i: list_sum(list_transform(list(histogram), lambda c: c[i]))) AS hs FROM {source} WHERE NOT base_failed"""
    return f"""{name} AS (SELECT language, list_transform(cs, lambda c: c / list_sum(cs)) AS class_ref, list_transform(list_filter(hs, lambda h: h IS NOT NULL), lambda h: h / list_sum(hs)) AS word_ref FROM (
  {each.format('language')} AND language <> '{ANY}' GROUP BY language UNION ALL {each.format(f"'{ANY}'")}))"""


QUALITY = rf"""
WITH lists(l, language, j, word) AS (VALUES {_LISTS}),
t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  regexp_replace(t, '[a-zß-öø-ÿ\x{{0100}}-\x{{1FFF}}\x{{2C00}}-\x{{D7FF}}]+', '', 'g') AS r1 FROM t),
r AS (SELECT *, regexp_replace(r1, '[\x20\x09-\x0D]+', '', 'g') AS r2 FROM w),
r3 AS (SELECT *, regexp_replace(r2, '[.,;:!?''"()\-]+', '', 'g') AS r3 FROM r),
r4 AS (SELECT *, regexp_replace(r3, '[A-ZÀ-ÖØ-Þ]+', '', 'g') AS r4 FROM r3),
r5 AS (SELECT *, regexp_replace(r4, '[0-9]+', '', 'g') AS r5 FROM r4),
positions AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM positions) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) x(k) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
common AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, lower(rtrim(unnest(ws), '.,;:!?#*$%&|<>)''"')) AS word FROM w) WHERE word IN (SELECT word FROM lists) GROUP BY ALL),
hits AS (SELECT doc_id, language, l, sum(n) AS hits FROM common JOIN lists USING (word) GROUP BY ALL),
spoken AS (SELECT doc_id, arg_min(language, (-hits, l)) AS language FROM hits GROUP BY 1),
histograms AS (SELECT doc_id, s.language, list(coalesce(n, 0)::double ORDER BY j) AS histogram FROM spoken s JOIN lists USING (language) LEFT JOIN common USING (doc_id, word) GROUP BY ALL),
base AS (SELECT doc_id, len(ws)::bigint AS n_words, (length(t) - (length(r1) - length(r2)))::bigint AS word_chars, length(regexp_replace(r2, '[^#*$%&|<>]+', '', 'g'))::bigint AS n_symbols,
  coalesce(lines.n, 0)::bigint AS n_dup_lines, coalesce(repeats.n, 0)::bigint AS n_repeat_words,
  [(length(t) - length(r1))::double, (length(r3) - length(r4))::double, (length(r4) - length(r5))::double, (length(r2) - length(r3))::double, (length(r1) - length(r2))::double, length(r5)::double] AS classes,
  coalesce(language, '{ANY}') AS language, coalesce(histogram, []) AS histogram
  FROM r5 LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN histograms USING (doc_id)),
counts AS (SELECT *, list_transform(classes, lambda c: c / list_sum(classes)) AS shares, list_transform(histogram, lambda c: c / list_sum(histogram)) AS word_shares,
  n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed FROM base),
{_references('refs1', 'counts')}, {_judged('first_fit', 'refs1')}, {_references('refs2', '(SELECT * FROM first_fit WHERE NOT off)')}, {_judged('second_fit', 'refs2')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT off AS kept, language, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM second_fit
"""

SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
late AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM late, range(20) r(k)),
words AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(ws)::bigint AS n_words, (len(ws) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op5_quality_rules": QUALITY, "op7_substring_dedup": SUBSTRINGS, "op8_source_mixing": MIXING, "op10_topk_search": TOPK}
