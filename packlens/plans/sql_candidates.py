"""Checking SQL for extraction: every candidate of the derived labels, written as set operations.

The SQL covers what occurs on the derived labels; it is written independently of the operators
(joins where they scan, list comprehensions where they use higher-order functions).
"""

from __future__ import annotations

from packlens.functions import fixed_values as V
from packlens.plans.sql_parts import cap, conf, has, nutrition, spans_sql, values_map

WS = r"E' \n\t\r'"
_MONTHS = "'JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC'"


def _int(x: str) -> str:
    return f"TRY_CAST({x} AS INT)"


def iso_date(t: str) -> str:
    """ISO text of the first readable absolute date."""
    dmy = [_int(cap(t, V.DATE_DMY, i)) for i in (1, 2, 3)]
    my = [_int(cap(t, V.DATE_MY, i)) for i in (1, 2)]
    my2 = [_int(cap(t, V.DATE_MY_SHORT, i)) for i in (1, 2)]

    def month(p, i):
        return f"((strpos({_MONTHS}, upper(left({cap(t, p, i)}, 3))) + 2) // 3)"

    def year(p, i):
        y = _int(cap(t, p, i))
        return f"(CASE WHEN {y} < 100 THEN 2000 + {y} ELSE {y} END)"

    dby_d = _int(cap(t, V.DATE_DAY_MONTH_YEAR, 1))
    return (
        f"CASE WHEN {has(t, V.RELATIVE_DATE)} THEN NULL "
        f"WHEN {dmy[1]} BETWEEN 1 AND 12 AND {dmy[0]} BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', {dmy[2]}, {dmy[1]}, {dmy[0]}) "
        f"WHEN {dby_d} BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', {year(V.DATE_DAY_MONTH_YEAR, 3)}, {month(V.DATE_DAY_MONTH_YEAR, 2)}, {dby_d}) "
        f"WHEN {has(t, V.DATE_MONTH_YEAR)} THEN printf('%04d-%02d', {year(V.DATE_MONTH_YEAR, 2)}, {month(V.DATE_MONTH_YEAR, 1)}) "
        f"WHEN {my[0]} BETWEEN 1 AND 12 THEN printf('%04d-%02d', {my[1]}, {my[0]}) "
        f"WHEN {my2[0]} BETWEEN 1 AND 12 THEN printf('%04d-%02d', 2000 + {my2[1]}, {my2[0]}) END"
    )


def relative_months(t: str) -> str:
    return _int(cap(t, V.RELATIVE_DATE, 1))


def amount(raw: str) -> str:
    """Amount of a price without thousands separators."""
    return f"TRY_CAST(regexp_extract({raw}, '([0-9]+(\\.[0-9]{{1,2}})?)', 1) AS DOUBLE)"


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def batch_code(raw: str) -> str:
    """Accepted batch code of a text or null."""
    clean = f"trim(trim({raw}, {WS}), '.:- #')"
    tokens = f"[upper(trim(w, '.:-,/')) for w in regexp_split_to_array({clean}, '\\s+') if trim(w, '.:-,/') <> '']"
    stop = _list(V.INSTRUCTION_STOP_WORDS)
    rescued = (f"([w for w in list_slice({tokens}, 2, 99) if NOT list_contains({stop}, w) AND regexp_matches(w, '[0-9]') "
               f"AND length(w) >= 2])[1]")
    code = f"(CASE WHEN list_contains({stop}, ({tokens})[1]) AND len({tokens}) <= 5 THEN {rescued} ELSE {clean} END)"
    address = f"(regexp_matches({raw}, '{V.PINCODE}') OR len([x for x in {_list(V.ADDRESS_INDICATORS)} if contains(upper({raw}), x)]) > 0)"
    bad = " OR ".join([nutrition(raw), has(raw, V.WEIGHT_MEASURE), has(raw, V.LICENCE_OR_ID), has(raw, V.QTY_MULTIPACK), address,
                       has(clean, V.INSTRUCTION_REFERENCE)])
    return (
        f"CASE WHEN {bad} OR {clean} = '' THEN NULL "
        f"WHEN length(regexp_replace({code}, '[^a-zA-Z0-9]', '', 'g')) < 2 OR NOT regexp_matches({code}, '[0-9]') "
        f"OR (length({code}) > 25 AND contains({code}, ' ')) THEN NULL ELSE {code} END"
    )


def title(t: str) -> str:
    """Title case of words separated by single spaces."""
    return f"array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) for w in string_split({t}, ' ')], ' ')"


_COMMODITY = V.COMMODITY.replace(r"(?=\n|\r|$)", r"(?:\n|\r|$)")
_MULTI = "CASE WHEN is_multi THEN {} ELSE {} END"
_COLS = "image_id, stage, a, b, c, block_ids, text"

C_MRP = f"""
c_mrp AS (SELECT {_COLS}, 'MRP' AS declaration_type, 0 AS ext_seq, raw AS raw_value, labelled,
    {amount('raw')} AS amount, {has('text', V.INCL_TAXES)} AS taxes,
    CASE WHEN labelled THEN {conf('ocr', '1', '1', '1', _MULTI.format('0.9', '1'))}
         ELSE {conf('ocr', '0.65', '0.72', '1', '1')} END AS confidence
  FROM (SELECT *, coalesce(r1, r2) AS raw, r1 IS NOT NULL AS labelled FROM (
    SELECT *, {cap('text', V.MRP_EXPLICIT)} AS r1,
           CASE WHEN n_blocks <= 2 AND NOT {has('text', V.WEIGHT_MEASURE)}
             AND NOT ((contains(text, '/') OR contains(text, '-'))
                      AND regexp_matches(regexp_extract(text, '(?is)(.{{0,5}}{V.MRP_CURRENCY_ONLY}.{{0,5}})', 1), '[0-9]{{1,2}}[/-][0-9]{{2,4}}'))
           THEN {cap('text', V.MRP_CURRENCY_ONLY)} END AS r2
    FROM spans WHERE NOT nutrition) q) q
  WHERE raw IS NOT NULL AND {amount('raw')} > 0 AND {amount('raw')} <= 99999)"""

C_QTY = f"""
units AS (SELECT * FROM {values_map(V.UNIT_ALIASES)} u(k, v)),
q_raw AS (SELECT *,
    CASE WHEN {has('text', V.QTY_MULTIPACK)} THEN 'multipack' WHEN {has('text', V.QTY_EXPLICIT)} THEN 'labelled'
         WHEN n_blocks <= 2 AND {has('text', V.QTY_COUNT)} THEN 'counted'
         WHEN n_blocks <= 2 AND lower({cap('text', V.QTY_STANDALONE, 2)}) <> 'mg' THEN 'alone' END AS how
  FROM spans WHERE NOT nutrition),
q_val AS (SELECT *,
    CASE how WHEN 'multipack' THEN {cap("replace(text, ',', '.')", V.QTY_MULTIPACK, 4)} WHEN 'labelled' THEN {cap('text', V.QTY_EXPLICIT, 1)}
             WHEN 'counted' THEN {cap('text', V.QTY_COUNT, 1)} ELSE {cap('text', V.QTY_STANDALONE, 1)} END AS rv,
    CASE how WHEN 'multipack' THEN coalesce({cap("replace(text, ',', '.')", V.QTY_MULTIPACK, 5)}, {cap("replace(text, ',', '.')", V.QTY_MULTIPACK, 3)}, 'g')
             WHEN 'labelled' THEN {cap('text', V.QTY_EXPLICIT, 2)}
             WHEN 'counted' THEN {cap('text', V.QTY_COUNT, 2)} ELSE {cap('text', V.QTY_STANDALONE, 2)} END AS ru
  FROM q_raw WHERE how IS NOT NULL),
c_qty AS (SELECT {_COLS}, 'NET_QUANTITY' AS declaration_type, 1 AS ext_seq,
    CASE WHEN how = 'multipack' THEN trim(text, {WS}) ELSE rv || coalesce(' ' || ru, '') END AS raw_value, how,
    CAST(rv AS DOUBLE) AS value, u.v AS unit,
    CASE WHEN u.v IN ('kg', 'L') THEN CAST(rv AS DOUBLE) * 1000 WHEN u.v = 'mg' THEN round(CAST(rv AS DOUBLE) / 1000, 6)
         WHEN u.v IN ('cm', 'm') THEN NULL WHEN u.v IS NOT NULL THEN CAST(rv AS DOUBLE) END AS canonical_value,
    CASE WHEN u.v IN ('kg', 'mg', 'g') THEN 'g' WHEN u.v IN ('L', 'ml') THEN 'ml' WHEN u.v IN ('pcs', 'units') THEN 'units'
         WHEN u.v IN ('cm', 'm') THEN NULL ELSE u.v END AS canonical_unit,
    CASE WHEN how = 'multipack' THEN {conf('ocr', '1', '1', '1', _MULTI.format('0.95', '1'))}
         WHEN how = 'labelled' AND u.v IS NULL THEN {conf('ocr', '1', '0.55', '0.6', _MULTI.format('0.9', '1'))}
         WHEN how = 'labelled' THEN {conf('ocr', '1', '1', "CASE WHEN CAST(rv AS DOUBLE) > 0 THEN 1.0 ELSE 0.4 END", _MULTI.format('0.9', '1'))}
         WHEN how = 'counted' THEN {conf('ocr', '0.65', '0.88', "CASE WHEN CAST(rv AS DOUBLE) > 0 THEN 1.0 ELSE 0.5 END", '1')}
         ELSE {conf('ocr', '0.65', '0.68', "CASE WHEN CAST(rv AS DOUBLE) > 0 THEN 1.0 ELSE 0.4 END", '1')} END AS confidence
  FROM q_val LEFT JOIN units u ON u.k = lower(ru))"""

C_COUNTRY = f"""
aliases AS (SELECT k, v, row_number() OVER () AS pos FROM {values_map(V.COUNTRY_ALIASES)} t(k, v)),
o_raw AS (SELECT *, {cap('text', V.COUNTRY_ORIGIN)} AS raw FROM spans WHERE {has('text', V.COUNTRY_ORIGIN)}),
o_clean AS (SELECT *, trim(regexp_split_to_array(trim(trim(raw, {WS}), '.:-'), '\\s{{2,}}|\\n|\\r')[1], {WS}) AS clean FROM o_raw),
o_known AS (SELECT *, coalesce((SELECT v FROM aliases WHERE k = upper(clean)),
    (SELECT arg_min(v, pos) FROM aliases WHERE contains(upper(clean), k))) AS known FROM o_clean),
c_country AS (SELECT {_COLS}, 'COUNTRY_OF_ORIGIN' AS declaration_type, 2 AS ext_seq, trim(raw, {WS}) AS raw_value,
    coalesce(known, {title('clean')}) AS country, known IS NOT NULL AS is_recognized,
    CASE WHEN known IS NOT NULL THEN {conf('ocr', '1', '1', '1', '1')} ELSE {conf('ocr', '1', '0.72', '0.6', '1')} END AS confidence
  FROM o_known)"""

_DATE_UNION = " UNION ALL ".join(
    f"SELECT *, '{t}' AS declaration_type, {3 + i} AS ext_seq, " + (
        f"regexp_extract(text, '(?i){p}', 1) AS raw FROM spans WHERE {has('text', p)}" if t != "BEST_BEFORE" else
        f"CASE WHEN {has('text', p)} THEN regexp_extract(text, '(?i){p}', 1) ELSE {cap('text', V.RELATIVE_DATE)} END AS raw "
        f"FROM spans WHERE {has('text', p)} OR {has('text', V.RELATIVE_DATE)}")
    for i, (t, p) in enumerate(V.DATE_ANCHORS.items()))
_STEALS = [V.DATE_ANCHORS[t] for t in ("DATE_OF_MANUFACTURE", "DATE_OF_PACKING", "EXPIRY_DATE")]


def _gap(a: str, b: str, lo: str, hi: str) -> str:
    return f"greatest({b}.{lo} - {a}.{hi}, {a}.{lo} - {b}.{hi}, 0)"


_DX, _DY = _gap("s", "v", "x1", "x2"), _gap("s", "v", "y1", "y2")
C_DATES = f"""
d_hits AS (SELECT *, {iso_date('raw')} AS date, {relative_months('raw')} AS relative_duration FROM ({_DATE_UNION}) q),
d_values AS (SELECT image_id, block_id, block_order, text AS v_text, x1, y1, x2, y2, {iso_date('text')} AS date,
    {relative_months('text')} AS relative_duration FROM blocks
  WHERE regexp_matches(text, '[0-9]') AND NOT ({" OR ".join(has('text', p) for p in _STEALS)})),
d_near AS (SELECT s.image_id, s.stage, s.a, s.b, s.c, s.ext_seq,
    arg_min(struct_pack(t := v.v_text, d := v.date, r := v.relative_duration, i := v.block_id),
            struct_pack(x := {_DX} + {_DY}, o := v.block_order, i := v.block_id)) AS n
  FROM d_hits s JOIN d_values v ON v.image_id = s.image_id AND (v.date IS NOT NULL OR v.relative_duration IS NOT NULL)
   AND {_DX} <= {V.DATE_NEIGHBOUR_PX[0]} AND {_DY} <= {V.DATE_NEIGHBOUR_PX[1]}
   AND NOT list_contains(string_split(s.block_ids, ','), CAST(v.block_id AS VARCHAR))
  WHERE s.date IS NULL AND s.relative_duration IS NULL GROUP BY ALL),
c_dates AS (
  SELECT {_COLS}, declaration_type, ext_seq, raw AS raw_value, date, relative_duration, FALSE AS nearby,
         {conf('ocr', '1', '1', '1', '1')} AS confidence
  FROM d_hits WHERE date IS NOT NULL OR relative_duration IS NOT NULL
  UNION ALL
  SELECT h.image_id, h.stage, h.a, h.b, h.c, h.block_ids || ',' || CAST(n.i AS VARCHAR), n.t, h.declaration_type, h.ext_seq, n.t, n.d, n.r, TRUE,
         {conf('ocr', '1', '1', '1', '0.9')}
  FROM d_hits h JOIN d_near USING (image_id, stage, a, b, c, ext_seq))"""

_ORG_UNION = " UNION ALL ".join(
    f"SELECT *, '{r}' AS role, {8 + 2 * i} AS ext_seq, trim(regexp_replace(text, '(?i)^{p}', ''), {WS}) AS content FROM spans WHERE {has('text', p)}"
    for i, (r, p) in enumerate(V.ORG_PREFIXES.items()))
_SUFFIX_AT = (
    f"list_min([i for i in range(1, len(tok) + 1) if list_contains({_list(V.COMPANY_SUFFIXES)}, upper(rtrim(tok[i], ',.-'))) AND "
    f"(tok[i] LIKE '%,' OR coalesce(tok[i + 1] LIKE ',%' OR list_contains({_list(V.ADDRESS_INDICATORS)}, upper(rtrim(tok[i + 1], ',.-'))) "
    "OR regexp_full_match(upper(rtrim(tok[i + 1], ',.-')), '[0-9]+') OR contains(tok[i + 1], '/'), FALSE))])")
C_ORGS = f"""
g_lines AS (SELECT *, [trim(x, {WS}) for x in string_split(clean, chr(10)) if trim(x, {WS}) <> ''] AS ls FROM
  (SELECT *, trim(trim(content, {WS}), '.:-') AS clean FROM ({_ORG_UNION}) q WHERE content <> '') q),
g_tok AS (SELECT *, regexp_split_to_array(coalesce(ls[1], clean), '\\s+') AS tok FROM g_lines),
g_cut AS (SELECT *, CASE WHEN len(ls) < 2 THEN {_SUFFIX_AT} END AS cut FROM g_tok),
g_norm AS (SELECT *,
    trim(CASE WHEN len(ls) >= 2 THEN ls[1] WHEN cut IS NOT NULL THEN rtrim(array_to_string(tok[1:cut], ' '), ',- ') ELSE coalesce(ls[1], clean) END, ' ,-') AS name,
    CASE WHEN len(ls) >= 2 THEN array_to_string(ls[2:], ', ') WHEN cut IS NOT NULL THEN ltrim(array_to_string(tok[cut + 1 :], ' '), ',- ') ELSE '' END AS address,
    replace(nullif(regexp_extract(clean, '{V.PINCODE}', 1), ''), ' ', '') AS pincode
  FROM g_cut),
c_orgs AS (
  SELECT {_COLS}, role || kind AS declaration_type, ext_seq + add AS ext_seq, CASE add WHEN 0 THEN name ELSE address END AS raw_value,
         name, address, pincode, clean,
         {conf('ocr', '1', "CASE WHEN name <> '' THEN 1.0 ELSE 0.65 END", "CASE WHEN length(regexp_replace(name, '[^a-zA-Z]', '', 'g')) >= 2 THEN 1.0 ELSE 0.55 END", _MULTI.format('0.92', '1'))} AS confidence
  FROM g_norm, (VALUES ('_NAME', 0), ('_ADDRESS', 1)) k(kind, add)
  WHERE add = 0 OR (address <> '' AND address <> name))"""

C_CARE = f"""
p_hits AS (SELECT *, {cap('text', V.PHONE, 0)} AS raw FROM spans
  WHERE NOT {has('text', V.LICENCE_OR_ID)} AND NOT regexp_matches(text, '{V.FSSAI_NUMBER}')),
c_phone AS (SELECT {_COLS}, 'CONSUMER_CARE_PHONE' AS declaration_type, 16 AS ext_seq, trim(raw, {WS}) AS raw_value,
    regexp_replace(raw, '[^0-9]', '', 'g') AS digits, {conf('ocr', '1', '1', '1', '1')} AS confidence
  FROM p_hits WHERE raw IS NOT NULL AND regexp_replace(raw, '[^0-9]', '', 'g') LIKE '1800%'
   AND length(regexp_replace(raw, '[^0-9]', '', 'g')) BETWEEN 10 AND 11
   AND (contains(raw, '1800') OR contains(raw, '1-800') OR {has('text', V.CARE_HEADER)} OR {has('text', V.CONTACT_PREFIX)})),
e_hits AS (SELECT *, {cap('text', V.EMAIL)} AS raw FROM spans WHERE {has('text', V.EMAIL)}),
c_email AS (SELECT {_COLS}, 'CONSUMER_CARE_EMAIL' AS declaration_type, 17 AS ext_seq, raw AS raw_value,
    lower(trim(raw, '.:-')) AS email, {conf('ocr', '1', '1', '1', '1')} AS confidence FROM e_hits),
c_care AS (SELECT {_COLS}, 'CONSUMER_CARE_ADDRESS' AS declaration_type, 18 AS ext_seq, trim(text, {WS}) AS raw_value,
    {conf('ocr', '1', '0.82', '0.85', '0.88')} AS confidence
  FROM spans WHERE is_multi AND {has('text', V.CARE_HEADER)} AND NOT {has('text', V.PHONE)} AND NOT {has('text', V.EMAIL)})"""

_BATCH = V.BATCH.replace("'", "''")
_BATCH_STEALS = [V.LICENCE_OR_ID, V.CONTACT_PREFIX, V.EMAIL, *_STEALS, V.DATE_ANCHORS["BEST_BEFORE"]]
C_BATCH = f"""
b_hits AS (SELECT *, {batch_code('raw')} AS code FROM (
  SELECT *, regexp_extract(text, '(?im){_BATCH}', 1) AS raw FROM spans WHERE regexp_matches(text, '(?im){_BATCH}')) q),
b_values AS (SELECT * FROM (SELECT image_id, block_id, block_order, text AS v_text, x1, y1, x2, y2, {batch_code('text')} AS code FROM blocks
  WHERE regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, '(?im){_BATCH}') AND NOT {nutrition('text')}
   AND NOT ({" OR ".join(has('text', p) for p in _BATCH_STEALS)})) q WHERE code IS NOT NULL),
b_near AS (SELECT s.image_id, s.stage, s.a, s.b, s.c,
    arg_min(struct_pack(t := v.v_text, k := v.code, i := v.block_id), struct_pack(x := {_DX} + {_DY}, o := v.block_order, i := v.block_id)) AS n
  FROM b_hits s JOIN b_values v ON v.image_id = s.image_id AND {_DX} <= {V.BATCH_NEIGHBOUR_PX[0]} AND {_DY} <= {V.BATCH_NEIGHBOUR_PX[1]}
   AND NOT list_contains(string_split(s.block_ids, ','), CAST(v.block_id AS VARCHAR))
  WHERE s.code IS NULL GROUP BY ALL),
c_batch AS (
  SELECT {_COLS}, 'BATCH_OR_LOT_NUMBER' AS declaration_type, 19 AS ext_seq, code AS raw_value, FALSE AS nearby,
         {conf('ocr', '1', '1', '1', '1')} AS confidence FROM b_hits WHERE code IS NOT NULL
  UNION ALL
  SELECT h.image_id, h.stage, h.a, h.b, h.c, h.block_ids || ',' || CAST(n.i AS VARCHAR), n.t, 'BATCH_OR_LOT_NUMBER', 19, n.k, TRUE,
         {conf('ocr', '1', '1', '1', '0.9')} FROM b_hits h JOIN b_near USING (image_id, stage, a, b, c))"""

_CLEAN_NAME = f"trim(trim(string_split(trim(raw, {WS}), chr(10))[1], {WS}), '.:- #()[]{{}}\"''')"
C_COMMODITY = f"""
m_hits AS (SELECT *, {_CLEAN_NAME} AS clean FROM (SELECT *, {cap('text', _COMMODITY)} AS raw FROM spans WHERE {has('text', _COMMODITY)}) q),
c_commodity AS (SELECT {_COLS}, 'COMMODITY_NAME' AS declaration_type, 20 AS ext_seq, {title('clean')} AS raw_value,
    {conf('ocr', '1', '0.88', '1', '1')} AS confidence
  FROM m_hits WHERE length(regexp_replace(clean, '[^a-zA-Z]', '', 'g')) >= 3 AND length(clean) <= 60 AND NOT {nutrition('clean')}
   AND NOT {has('clean', V.INSTRUCTION_REFERENCE)} AND NOT ({" OR ".join(f"starts_with(upper(clean), '{p}')" for p in V.COMMODITY_EXCLUDED_PREFIXES)}))"""

FAMILY_CTE = {"mrp": C_MRP, "quantity": C_QTY, "country": C_COUNTRY, "dates": C_DATES, "organisations": C_ORGS,
              "care": C_CARE, "batch": C_BATCH, "commodity": C_COMMODITY}


def from_family(family: str, select: str) -> str:
    return spans_sql() + ", " + FAMILY_CTE[family] + " " + select


# the deduplication key of a candidate, as text
_SIG = {
    "c_mrp": "printf('%.6f', amount)",
    "c_qty": "printf('%.6f', coalesce(nullif(canonical_value, 0), nullif(value, 0))) || '_' || coalesce(canonical_unit, unit, 'None')",
    "c_country": "country",
    # a date, or the whole relative text (null keys never occur)
    "c_dates": "coalesce(date, trim(raw_value, " + WS + "))",
    "c_orgs": "CASE WHEN declaration_type LIKE 'MARKETER%' THEN concat_ws('|', name, address, pincode, clean) "
              "WHEN declaration_type LIKE '%_NAME' THEN left(upper(name), 40) "
              "ELSE coalesce('PIN' || pincode, left(upper(address), 50)) END",
    "c_phone": "digits", "c_email": "lower(email)", "c_care": "raw_value", "c_batch": "upper(raw_value)",
    "c_commodity": "upper(raw_value)",
}
_LABEL = {"c_mrp": "labelled", "c_qty": "how IN ('multipack', 'labelled')"}


def candidates_sql() -> str:
    """All candidates in one CTE ``cand`` with order keys, signature and label flag."""
    union = " UNION ALL ".join(
        f"SELECT image_id, stage, a, b, c, block_ids, declaration_type, ext_seq, raw_value, confidence, {sig} AS sig, "
        f"{_LABEL.get(name, 'TRUE')} AS labelled, {'how' if name == 'c_qty' else 'NULL'} AS how FROM {name}"
        for name, sig in _SIG.items())
    return (
        spans_sql() + ", " + ", ".join(FAMILY_CTE.values())
        + f", cand AS MATERIALIZED (SELECT *, image_id // 4 AS scan_id, image_id % 4 AS image_seq, "
          f"array_to_string(list_sort(string_split(block_ids, ',')), ',') AS block_key FROM ({union}) u)"
    )


_ORDER = "confidence DESC, image_seq, image_id, stage, a, b, c, ext_seq, CAST(string_split(block_ids, ',')[1] AS BIGINT)"

ARBITRATED = f"""
ranked AS (SELECT *, first(declaration_type) OVER w AS top_type, first(confidence) OVER w AS top_conf FROM cand
           WINDOW w AS (PARTITION BY image_id, block_key ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
arb AS MATERIALIZED (SELECT * FROM ranked WHERE NOT (top_conf >= {V.ARBITRATION_MIN} AND top_type IN ('{"', '".join(V.STRONG_TYPES)}')
                     AND declaration_type <> top_type))"""

MERGED = f"""
firsts AS (SELECT *, row_number() OVER (PARTITION BY scan_id, declaration_type, sig ORDER BY {_ORDER}) AS rn,
             first(image_id) OVER (PARTITION BY scan_id, declaration_type, sig ORDER BY {_ORDER}) AS home,
             count(*) OVER (PARTITION BY scan_id, declaration_type, sig) AS n_merged FROM arb),
crossed AS (SELECT scan_id, declaration_type, sig, count_if(image_id <> home) AS n_cross FROM firsts GROUP BY ALL),
merged AS MATERIALIZED (SELECT f.* EXCLUDE (confidence, rn, home), c.n_cross, f.confidence AS rank_confidence,
             round(least(1.0, f.confidence + CAST(0.04 AS DOUBLE) * c.n_cross), 4) AS confidence
           FROM firsts f JOIN crossed c USING (scan_id, declaration_type, sig) WHERE rn = 1)"""

_RANK = _ORDER.replace("confidence DESC", "rank_confidence DESC")
ANCHORED = """
pruned AS MATERIALIZED (SELECT * FROM (SELECT *, bool_or(labelled) OVER (PARTITION BY scan_id, declaration_type) AS any_label FROM merged) q
           WHERE labelled OR NOT any_label)"""
CONSOLIDATED = f"""
topped AS (SELECT *, row_number() OVER (PARTITION BY scan_id, declaration_type ORDER BY {_RANK}) AS pos,
             first(confidence) OVER (PARTITION BY scan_id, declaration_type ORDER BY {_RANK}) AS top FROM pruned),
strong AS (SELECT *, count_if(confidence >= {V.CREDIBLE_MIN}) OVER (PARTITION BY scan_id, declaration_type) AS n_credible
           FROM topped WHERE NOT (top >= {V.STRONG_MIN} AND confidence < {V.LEVEL_MEDIUM} AND pos > 1)),
cons AS MATERIALIZED (SELECT *, n_credible > 1 AS has_conflict FROM strong
           WHERE CASE WHEN n_credible > 1 THEN confidence >= {V.CREDIBLE_MIN} ELSE pos = 1 END)"""


def consolidated_sql() -> str:
    return ", ".join([candidates_sql(), ARBITRATED, MERGED, ANCHORED, CONSOLIDATED]) + " "
