"""SQL that gives the rows of queries which SQL can express, for an engine with the tables as views."""

from __future__ import annotations

from packlens.llm.secret_scan import ACCESS, ASSIGN, HEX, LEAST_ACCESS, LEAST_VALUE


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(k: int, name: str, pattern: str, group: int, least: int) -> str:
    p = _quoted(pattern)
    return f"""SELECT r, {k} AS kind, '{name}' AS name, unnest(string_split_regex(t, {p})[:-2]) AS gap, unnest(regexp_extract_all(t, {p})) AS hit,
      unnest(regexp_extract_all(t, {p}, {group})) AS value, {least} AS least, generate_subscripts(regexp_extract_all(t, {p}), 1) AS nth FROM d WHERE len(regexp_extract_all(t, {p})) > 0"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_kind(0, "assign", ASSIGN, 2, LEAST_VALUE)} UNION ALL {_kind(1, "access", ACCESS, 0, LEAST_ACCESS)} UNION ALL {_kind(2, "hex", HEX, 0, 24)}),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY nth) AS last FROM m),
s AS (SELECT r, kind, last - length(hit) AS first, name || ':' || CAST(last - length(hit) AS BIGINT) || ':' || CAST(last AS BIGINT) AS span FROM p WHERE length(value) >= least),
g AS (SELECT r, count_if(kind = 0) AS a, count_if(kind = 1) AS b, count_if(kind = 2) AS c, string_agg(span, ',' ORDER BY first, kind) AS spans FROM s GROUP BY r)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Exact phrases; proximity matches stay in the operator.
DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) q),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) k WHERE len(w) >= n) q),
h AS (SELECT r, i, n, item FROM dw JOIN iw USING (n, gram)),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) q GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def _share(count: str, total: str) -> str:
    return f"1 + 1000000000 * (CAST({count} AS HUGEINT) + 5) // (CAST({total} AS HUGEINT) + 5 * CAST(v AS HUGEINT))"


DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
n AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(t, 0) AS t, coalesce(v, 0) AS v, coalesce(lt, 0) AS lt FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS t FROM n GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) USING (lang) LEFT JOIN (SELECT lang, sum(n) AS lt FROM n GROUP BY lang) USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, {_share("coalesce(n.n, 0)", "t")} AS p, {_share("ln", "lt")} AS q
  FROM g JOIN k ON g.lang = k.lang JOIN (SELECT lang, term, sum(n) AS ln FROM n GROUP BY ALL) l ON l.lang = k.lang AND l.term = k.term
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM s WHERE part = 'pair' OR rank <= 50"""

ORACLES = {"op3_secret_scans": SECRETS, "op9_decontamination": DECONTAMINATION, "op11_vector_search": TOP_K, "op12_source_divergence": DIVERGENCE}
