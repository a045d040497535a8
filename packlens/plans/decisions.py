"""Queries over value normalisers, review, rules, evaluation and analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.functions import normalize as N
from packlens.functions import scores as S
from packlens.functions.text import truncate_message
from packlens.operators import analytics as A
from packlens.operators import evaluate as EV
from packlens.operators import review as RV
from packlens.operators import rule_conditions as RC
from packlens.operators import rules as RU
from packlens.plans import sql_candidates as Q
from packlens.plans.registry import query
from packlens.plans.sql_parts import conf, has, nutrition, values_map, with_tables
from packlens.plans.tables import labelled_rows
from packlens.sources.corpus import derived, label_blocks, label_blocks_sql, part_facts, PART_FACTS, sql_tables
from packlens.sources.tables import read_table

WS = Q.WS


def _part(spark, d, expr: str, name: str = "raw") -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", F.expr(expr).alias(name))


# --------------------------------------------------------------------------- scalars
_PRICE_RAW = """CASE p_partkey % 5 WHEN 0 THEN printf('%.2f', p_retailprice) WHEN 1 THEN CAST(p_size AS STRING) || ',50' WHEN 2 THEN '1,' || printf('%.2f', p_retailprice)
 WHEN 3 THEN CAST(p_size AS STRING) || ',000,000' ELSE CAST(p_size AS STRING) || ',900' END"""


@query("sc1_norm_amount", f"""
WITH r AS (SELECT p_partkey, {_PRICE_RAW} AS raw FROM part),
c AS (SELECT *, CASE WHEN NOT contains(raw, ',') THEN raw WHEN contains(raw, '.') THEN replace(raw, ',', '')
   WHEN regexp_matches(raw, ',([0-9]{{2}})([^0-9]|$)') AND length(raw) - length(replace(raw, ',', '')) = 1 THEN replace(raw, ',', '.') ELSE replace(raw, ',', '') END AS clean FROM r)
SELECT p_partkey, CASE WHEN {Q.amount('clean')} > 0 AND {Q.amount('clean')} <= 99999 THEN round({Q.amount('clean')}, 2) END AS amount,
       coalesce({Q.amount('clean')} > 0 AND {Q.amount('clean')} <= 99999, FALSE) AS valid FROM c""")
def sc1(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, _PRICE_RAW).withColumn("v", N.norm_amount(F.col("raw"))).select("p_partkey", "v.amount", "v.valid")


_UNIT_RAW = "CASE p_partkey % 8 WHEN 0 THEN 'kg' WHEN 1 THEN 'mg' WHEN 2 THEN 'Litres' WHEN 3 THEN 'mL' WHEN 4 THEN 'Pieces' WHEN 5 THEN 'cm' WHEN 6 THEN 'Tablets' ELSE 'gms' END"
_VALUE_RAW = "CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN CAST(p_size AS STRING) || ',5' ELSE '0' END"


@query("sc2_norm_quantity", f"""
WITH u AS (SELECT * FROM {values_map(V.UNIT_ALIASES)} t(k, v)),
r AS (SELECT p_partkey, CAST(replace({_VALUE_RAW}, ',', '.') AS DOUBLE) AS value, u.v AS unit FROM part LEFT JOIN u ON u.k = lower({_UNIT_RAW}))
SELECT p_partkey, value, unit, CASE WHEN unit IN ('kg', 'L') THEN value * 1000 WHEN unit = 'mg' THEN round(value / 1000, 6) WHEN unit = 'cm' THEN NULL ELSE value END AS canonical_value,
       CASE WHEN unit IN ('kg', 'mg', 'g') THEN 'g' WHEN unit IN ('L', 'ml') THEN 'ml' WHEN unit = 'pcs' THEN 'units' WHEN unit = 'tablets' THEN 'tablets' END AS canonical_unit, value > 0 AS valid FROM r""")
def sc2(spark, d):
    rows = read_table(spark, d, "part").select("p_partkey", N.norm_quantity(F.expr(_VALUE_RAW), F.expr(_UNIT_RAW)).alias("q"))
    return rows.select("p_partkey", "q.value", "q.unit", "q.canonical_value", "q.canonical_unit", "q.valid")


_PACK = """CAST(p_partkey % 12 + 2 AS STRING) || CASE p_partkey % 3 WHEN 0 THEN ' N x ' WHEN 1 THEN ' x ' ELSE ' PCS X ' END || CAST(p_size AS STRING) || '.5' ||
 CASE p_partkey % 2 WHEN 0 THEN ' g' ELSE ' ml' END || ' = ' || CAST(p_size * 10 AS STRING) || CASE p_partkey % 4 WHEN 0 THEN ' g' WHEN 1 THEN ' ml' WHEN 2 THEN ' kg' ELSE ' L' END"""


@query("sc3_norm_multipack", f"""
SELECT p_partkey, CAST(p_partkey % 12 + 2 AS INT) AS units, p_size + 0.5 AS unit_value, CASE p_partkey % 2 WHEN 0 THEN 'g' ELSE 'ml' END AS unit_unit,
  CAST(p_size * 10 AS DOUBLE) AS value, CASE p_partkey % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' WHEN 2 THEN 'kg' ELSE 'L' END AS unit,
  CAST(p_size * 10 AS DOUBLE) * CASE WHEN p_partkey % 4 >= 2 THEN 1000 ELSE 1 END AS canonical_value FROM part""")
def sc3(spark, d):
    rows = _part(spark, d, _PACK).withColumn("m", N.norm_multipack(F.col("raw")))
    return rows.select("p_partkey", "m.multipack.units", "m.multipack.unit_value", "m.multipack.unit_unit", "m.value", "m.unit", "m.canonical_value")


_DATE_RAW = """CASE p_partkey % 8 WHEN 0 THEN lpad(CAST(p_partkey % 31 + 1 AS STRING), 2, '0') || '/' || lpad(CAST(p_partkey % 14 AS STRING), 2, '0') || '/2026'
 WHEN 1 THEN CAST(p_partkey % 28 + 1 AS STRING) || ' AUG 2025' WHEN 2 THEN 'Sept 24' WHEN 3 THEN CAST(p_partkey % 12 + 1 AS STRING) || '-2023' WHEN 4 THEN '0' || CAST(p_partkey % 9 + 1 AS STRING) || '.27'
 WHEN 5 THEN CAST(p_partkey % 20 + 1 AS STRING) || ' weeks from Packing' WHEN 6 THEN '12/2005' ELSE 'printed on cap' END"""


@query("sc4_norm_date", f"""
WITH r AS (SELECT p_partkey, {_DATE_RAW} AS raw FROM part)
SELECT p_partkey, {Q.iso_date('raw')} AS date, {Q.relative_months('raw')} AS relative_duration FROM r""")
def sc4(spark, d):
    rows = _part(spark, d, _DATE_RAW).withColumn("v", N.norm_date(F.col("raw"), F.lit("EXPIRY_DATE")))
    return rows.select("p_partkey", "v.date", "v.relative_duration")


_COUNTRY_RAW = "CASE p_partkey % 6 WHEN 0 THEN ': India' WHEN 1 THEN 'viet nam  Plot 5' WHEN 2 THEN 'INDONESIA JAKARTA' WHEN 3 THEN p_name WHEN 4 THEN 'U.S.A.' ELSE 'Korea' END"


@query("sc5_norm_country", f"""
WITH a AS (SELECT k, v, row_number() OVER () AS pos FROM {values_map(V.COUNTRY_ALIASES)} t(k, v)),
r AS (SELECT p_partkey, trim(regexp_split_to_array(trim(trim({_COUNTRY_RAW}, {WS}), '.:-'), '\\s{{2,}}|\\n')[1], {WS}) AS clean FROM part),
u AS (SELECT *, upper(trim(regexp_replace(clean, '[^a-zA-Z\\s]', '', 'g'))) AS up FROM r),
k AS (SELECT *, coalesce((SELECT v FROM a WHERE k = up), (SELECT arg_min(v, pos) FROM a WHERE contains(up, k))) AS known FROM u)
SELECT p_partkey, coalesce(known, {Q.title('clean')}) AS country, known IS NOT NULL AS is_recognized FROM k""")
def sc5(spark, d):
    rows = _part(spark, d, _COUNTRY_RAW).withColumn("v", N.norm_country(F.col("raw")))
    return rows.select("p_partkey", "v.country", "v.is_recognized")


_PHONE_RAW = """CASE p_partkey % 7 WHEN 0 THEN '1800-425-' || lpad(CAST(p_partkey % 1000 AS STRING), 4, '0') WHEN 1 THEN '+91 98765 ' || lpad(CAST(p_partkey % 100000 AS STRING), 5, '0')
 WHEN 2 THEN '1001' || lpad(CAST(p_partkey AS STRING), 10, '0') WHEN 3 THEN '080-2345' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') WHEN 4 THEN '12345' WHEN 5 THEN '1800 11' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0')
 ELSE '7' || lpad(CAST(p_partkey AS STRING), 9, '0') END"""


@query("sc6_norm_phone", f"""
WITH r AS (SELECT p_partkey, {_PHONE_RAW} AS raw FROM part), g AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM r),
l AS (SELECT *, CASE WHEN digits LIKE '91%' AND length(digits) = 12 THEN substr(digits, 3) ELSE digits END AS loc FROM g),
o AS (SELECT *, length(digits) <> 14 AND ((digits LIKE '1800%' AND length(digits) BETWEEN 10 AND 11) OR (length(loc) = 10 AND left(loc, 1) IN ('6', '7', '8', '9')) OR length(loc) IN (7, 8, 11)
   OR (length(digits) BETWEEN 8 AND 11 AND digits LIKE '0%')) AS valid FROM l)
SELECT p_partkey, digits, valid, CASE WHEN NOT valid THEN NULL WHEN digits LIKE '1800%' AND length(digits) = 10 THEN '1800-' || substr(digits, 5, 3) || '-' || substr(digits, 8)
  WHEN digits LIKE '1800%' THEN '1800-' || substr(digits, 5, 4) || '-' || substr(digits, 9) WHEN length(loc) = 10 THEN '+91 ' || left(loc, 5) || ' ' || substr(loc, 6) ELSE raw END AS number FROM o""")
def sc6(spark, d):
    rows = _part(spark, d, _PHONE_RAW).withColumn("v", N.norm_phone(F.col("raw")))
    return rows.select("p_partkey", "v.digits", "v.valid", "v.number")


_EMAIL_RAW = "CASE p_partkey % 4 WHEN 0 THEN 'Care' || CAST(p_partkey AS STRING) || ' @ Example . COM' WHEN 1 THEN 'help [AT] brand.in' WHEN 2 THEN 'a+b@c-d.org.' ELSE 'broken@' || p_name END"


@query("sc7_norm_email", f"""
WITH r AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(trim({_EMAIL_RAW}, '.:-'), '(?i)\\s*\\[at\\]\\s*', '@', 'g'), '\\s*@\\s*', '@', 'g'), '\\s*\\.\\s*', '.', 'g')) AS email FROM part)
SELECT p_partkey, email, regexp_matches(email, '{V.EMAIL_VALID}') AS valid FROM r""")
def sc7(spark, d):
    return _part(spark, d, _EMAIL_RAW).withColumn("v", N.norm_email(F.col("raw"))).select("p_partkey", "v.email", "v.valid")


_ORG_RAW = """CASE p_partkey % 3 WHEN 0 THEN p_name || ' Works,' || chr(10) || 'Plot 5' || chr(10) || 'Pune 411 001' WHEN 1 THEN ': ' || p_name || ' Traders' ELSE '12' END"""


@query("sc8_norm_organisation", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' Works' WHEN 1 THEN p_name || ' Traders' ELSE '12' END AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'Plot 5, Pune 411 001' ELSE '' END AS address, CASE p_partkey % 3 WHEN 0 THEN '411001' END AS pincode, p_partkey % 3 <> 2 AS valid FROM part""")
def sc8(spark, d):
    rows = _part(spark, d, _ORG_RAW).withColumn("v", N.norm_org(F.col("raw"), F.lit("PACKER")))
    return rows.select("p_partkey", "v.name", "v.address", "v.pincode", "v.valid")


_SPLIT_RAW = """CASE p_partkey % 5 WHEN 0 THEN p_name || ' Pvt. Ltd., ' || CAST(p_size AS STRING) || ' Hill View' WHEN 1 THEN p_name || ' LLP 12/4 Baker Lane' WHEN 2 THEN p_name || ' Enterprises, ' || CAST(p_size AS STRING) || ' Link Road, Pune'
 WHEN 3 THEN p_name || ' Foods - Kochi 682001' ELSE p_name || ' Traders' END"""


@query("sc9_split_name_address", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' Pvt. Ltd.' WHEN 1 THEN p_name || ' LLP' WHEN 2 THEN p_name || ' Enterprises' WHEN 3 THEN p_name || ' Foods' ELSE p_name || ' Traders' END AS name,
  CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) || ' Hill View' WHEN 1 THEN '12/4 Baker Lane' WHEN 2 THEN CAST(p_size AS VARCHAR) || ' Link Road, Pune' WHEN 3 THEN '- Kochi 682001' END AS address FROM part""".replace(
    "WHEN 0 THEN p_name || ' Pvt. Ltd.'", "WHEN 0 THEN p_name || ' Pvt.'").replace("WHEN 0 THEN CAST(p_size AS VARCHAR) || ' Hill View'", "WHEN 0 THEN 'Ltd., ' || CAST(p_size AS VARCHAR) || ' Hill View'"))
def sc9(spark, d):
    rows = _part(spark, d, _SPLIT_RAW).withColumn("v", N.split_name_address(F.col("raw")))
    return rows.select("p_partkey", "v.name", "v.address")


_BATCH_RAW = "CASE p_partkey % 7 WHEN 0 THEN 'AB' || CAST(p_partkey AS STRING) WHEN 1 THEN 'LOT A' || CAST(p_size AS STRING) WHEN 2 THEN 'see crimp' WHEN 3 THEN 'PLAIN' WHEN 4 THEN 'no' WHEN 5 THEN 'batch 7 of a rather long story told' ELSE ' # X' || CAST(p_size AS STRING) || '.' END"


@query("sc10_norm_batch", f"""
WITH r AS (SELECT p_partkey, {_BATCH_RAW} AS raw FROM part) SELECT p_partkey, {Q.batch_code('raw')} AS batch_number FROM r""")
def sc10(spark, d):
    return _part(spark, d, _BATCH_RAW).select("p_partkey", N.batch_value(F.col("raw")).alias("batch_number"))


_NAME_RAW = "CASE p_partkey % 6 WHEN 0 THEN '(' || p_name || ')' || chr(10) || 'second' WHEN 1 THEN 'sku ' || p_name WHEN 2 THEN 'protein ' || p_name WHEN 3 THEN '(-' WHEN 4 THEN 'see pack' ELSE upper(p_name) || ' BAR' END"


@query("sc11_norm_commodity", f"""
WITH r AS (SELECT p_partkey, {_NAME_RAW} AS raw FROM part), c AS (SELECT *, trim(trim(string_split(trim(raw, {WS}), chr(10))[1], {WS}), '.:- #()[]{{}}\"''') AS clean FROM r)
SELECT p_partkey, CASE WHEN length(regexp_replace(clean, '[^a-zA-Z]', '', 'g')) >= 3 AND NOT {nutrition('clean')} AND NOT {has('clean', V.INSTRUCTION_REFERENCE)} AND NOT starts_with(upper(clean), 'SKU')
  THEN {Q.title('clean')} END AS commodity_name FROM c""")
def sc11(spark, d):
    return _part(spark, d, _NAME_RAW).withColumn("v", N.norm_commodity(F.col("raw"))).select("p_partkey", "v.commodity_name")


@query("sc12_lexical_predicates", f"""
WITH {label_blocks_sql()} SELECT block_id, {nutrition('text')} AS nutrition, {has('text', V.INSTRUCTION_REFERENCE)} AS instruction, {has('text', V.WEIGHT_MEASURE)} AS weight,
  regexp_matches(text, '{V.PINCODE}') OR len([x for x in {Q._list(V.ADDRESS_INDICATORS)} if contains(upper(text), x)]) > 0 AS address FROM blocks""")
def sc12(spark, d):
    t = F.col("text")
    return label_blocks(spark, d).select(
        "block_id", N.is_nutrition(t).alias("nutrition"), N.is_instruction(t).alias("instruction"),
        N.is_weight_context(t).alias("weight"), N.has_address_indicator(t).alias("address"))


_SCORES = ["l_discount * 10", "l_returnflag = 'R'", "(10 - l_linenumber) / CAST(10 AS DOUBLE)", "(l_quantity + 50) / CAST(100 AS DOUBLE)", "l_tax * 10"]


@query("sc13_confidence", f"""
SELECT l_orderkey, l_linenumber, {conf(f'least(1.0, {_SCORES[0]})', "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.65 END", _SCORES[2], f'least(1.0, {_SCORES[3]})', f'least(1.0, {_SCORES[4]})')} AS confidence,
  CASE WHEN {conf(f'least(1.0, {_SCORES[0]})', "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.65 END", _SCORES[2], f'least(1.0, {_SCORES[3]})', f'least(1.0, {_SCORES[4]})')} >= 0.82 THEN 'HIGH'
       WHEN {conf(f'least(1.0, {_SCORES[0]})', "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.65 END", _SCORES[2], f'least(1.0, {_SCORES[3]})', f'least(1.0, {_SCORES[4]})')} >= 0.58 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM lineitem""")
def sc13(spark, d):
    ocr, label, pattern, validity, spatial = (F.expr(x) for x in _SCORES)
    c = S.confidence(ocr, label, pattern, spatial, validity)
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("confidence")).withColumn("level", S.level_of(F.col("confidence")))


@query("sc14_confidence_breakdown", """
SELECT l_orderkey, l_linenumber, round((CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE CAST('0.65' AS DOUBLE) END + l_tax) / 2, 4) AS association, round((l_discount + l_tax) / 2, 4) AS semantic,
  CAST('0.5' AS DOUBLE) AS consistency FROM lineitem""")
def sc14(spark, d):
    b = S.breakdown(F.col("l_discount"), F.expr("l_returnflag = 'R'"), F.col("l_discount"), F.col("l_tax"), F.col("l_tax"))
    return read_table(spark, d, "lineitem").withColumn("b", b).select(
        "l_orderkey", "l_linenumber", F.col("b.association_confidence").alias("association"),
        F.col("b.semantic_confidence").alias("semantic"), F.col("b.consistency_confidence").alias("consistency"))


@query("sc15_signature", Q.from_family("organisations", """
SELECT image_id, stage, block_ids, declaration_type, CASE WHEN declaration_type LIKE '%_NAME' THEN 'ORG_' || left(upper(name), 40) ELSE coalesce('ADDR_PIN_' || pincode, 'ADDR_' || left(upper(address), 50)) END AS signature
FROM c_orgs WHERE declaration_type NOT LIKE 'MARKETER%'"""))
def sc15(spark, d):
    from packlens.operators.extract import extract_candidates
    from packlens.plans.extraction import ids_text

    cand = extract_candidates(label_blocks(spark, d), ("organisations",)).where("NOT startswith(declaration_type, 'MARKETER')")
    return cand.select("image_id", "stage", ids_text(F.col("block_ids")).alias("block_ids"), "declaration_type",
                       N.signature(F.col("declaration_type"), F.col("normalized")).alias("signature"))


@query("sc18_truncate_message", f"""
SELECT doc_id, CASE WHEN length(trim(text, {WS})) > 400 THEN left(trim(text, {WS}), 400) || '... [truncated]' ELSE trim(text, {WS}) END AS content FROM documents""")
def sc18(spark, d):
    return read_table(spark, d, "documents").select("doc_id", truncate_message(F.col("text"), V.HISTORY_CHARS).alias("content"))


# ---------------------------------------------------------------------------- review
def stored(spark, d) -> DataFrame:
    return derived(spark, d, "declarations").select(
        "scan_id", "declaration_type", "declaration_id", "resolution_status", (F.col("resolution_status") == "CONFIRMED").alias("reviewed"),
        F.when(F.col("resolution_status") == "CONFIRMED", F.concat(F.lit("rev "), "machine_value")).alias("reviewed_value"), "machine_value")


def fresh(spark, d) -> DataFrame:
    """A second machine run: other values, some types gone, some new."""
    return derived(spark, d, "declarations").where("(scan_id + seq) % 7 <> 0").select(
        "scan_id", F.when(F.col("scan_id") % 5 == 0, F.concat("declaration_type", F.lit("_NAME"))).otherwise(F.col("declaration_type")).alias("declaration_type"),
        F.when(F.col("scan_id") % 6 == 0, "NOT_DETECTED").otherwise("AUTO_RESOLVED").alias("resolution_status"),
        F.concat(F.lit("new "), "machine_value").alias("machine_value"), "confidence")


_UPSERT = """
old AS (SELECT scan_id, declaration_type, declaration_id, resolution_status, CASE WHEN resolution_status = 'CONFIRMED' THEN 'rev ' || machine_value END AS reviewed_value
        FROM declarations WHERE resolution_status IN ('CONFIRMED', 'REJECTED')),
new AS (SELECT scan_id, CASE WHEN scan_id % 5 = 0 THEN declaration_type || '_NAME' ELSE declaration_type END AS declaration_type, scan_id % 6 <> 0 AS found, 'new ' || machine_value AS machine_value, confidence
        FROM declarations WHERE (scan_id + seq) % 7 <> 0)
SELECT coalesce(o.scan_id, n.scan_id) AS scan_id, coalesce(o.declaration_type, n.declaration_type) AS declaration_type, o.declaration_id,
  coalesce(o.resolution_status, 'AUTO_RESOLVED') AS resolution_status, CASE WHEN n.found THEN n.machine_value END AS machine_value, o.reviewed_value,
  coalesce(o.reviewed_value, CASE WHEN n.found THEN n.machine_value END) AS canonical_value, CASE WHEN n.found THEN n.confidence ELSE 0.0 END AS confidence, o.scan_id IS NOT NULL AS reviewed
FROM old o FULL JOIN new n ON n.scan_id = o.scan_id AND n.declaration_type = o.declaration_type WHERE o.scan_id IS NOT NULL OR n.found"""


@query("sta1_review_preserving_upsert", with_tables("declarations") + ", " + _UPSERT)
def sta1(spark, d):
    return RV.upsert_declarations(stored(spark, d), fresh(spark, d))


@query("snk2_upsert_is_idempotent", with_tables("declarations") + ", " + _UPSERT.replace("o.declaration_id,", "NULL AS declaration_id,").replace(
    "SELECT coalesce(o.scan_id", "SELECT * EXCLUDE (declaration_id) FROM (SELECT coalesce(o.scan_id") + ") q")
def snk2(spark, d):
    once = RV.upsert_declarations(stored(spark, d), fresh(spark, d))
    return RV.upsert_declarations(once, fresh(spark, d)).drop("declaration_id")


@query("snk2_full_snapshot", with_tables("declarations") + f""",
old AS (SELECT scan_id, declaration_type, resolution_status, CASE WHEN resolution_status = 'CONFIRMED' THEN 'rev ' || machine_value END AS reviewed_value, CAST(amount AS VARCHAR) AS normalized_value
        FROM declarations WHERE resolution_status IN ('CONFIRMED', 'REJECTED')),
new AS (SELECT *, CASE WHEN scan_id % 6 = 0 THEN 'NOT_DETECTED' ELSE 'AUTO_RESOLVED' END AS new_status FROM (
        SELECT * REPLACE (CASE WHEN scan_id % 5 = 0 THEN declaration_type || '_NAME' ELSE declaration_type END AS declaration_type, 'new ' || machine_value AS machine_value) FROM declarations WHERE (scan_id + seq) % 7 <> 0) q)
SELECT coalesce(o.scan_id, n.scan_id) AS scan_id, coalesce(o.declaration_type, n.declaration_type) AS declaration_type, coalesce(o.resolution_status, n.new_status) AS resolution_status,
  CASE WHEN f THEN n.machine_value END AS machine_value, o.reviewed_value, coalesce(o.reviewed_value, CASE WHEN f THEN n.machine_value END) AS canonical_value, CASE WHEN f THEN n.confidence ELSE 0 END AS confidence,
  o.scan_id IS NOT NULL AS reviewed, coalesce(n.raw_text, '') AS raw_text, n.image_id, coalesce(n.has_conflict, FALSE) AS has_conflict, n.source_block_id,
  CASE WHEN n.scan_id IS NULL THEN 'LOW' WHEN n.confidence >= 0.82 THEN 'HIGH' WHEN n.confidence >= 0.58 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level,
  CASE WHEN o.scan_id IS NOT NULL THEN '{V.REVIEW_PRESERVED}' ELSE 'run 2' END AS resolution_reason,
  CASE WHEN o.scan_id IS NOT NULL THEN o.normalized_value ELSE n.machine_value END AS normalized_value, '2' AS extractor_version
FROM old o FULL JOIN (SELECT *, new_status <> 'NOT_DETECTED' AS f FROM new) n ON n.scan_id = o.scan_id AND n.declaration_type = o.declaration_type WHERE o.scan_id IS NOT NULL OR f""")
def snk2_full(spark, d):
    """A second machine run over reviewed and unreviewed rows, with everything a declaration holds of its best candidate."""
    of_type = derived(spark, d, "declarations")
    before = stored(spark, d).join(of_type.select("declaration_id", F.col("amount").cast("string").alias("normalized_value")), "declaration_id")
    again = fresh_snapshots(spark, d)
    return RV.upsert_declarations(before, again, "2").drop("declaration_id")


def fresh_snapshots(spark, d) -> DataFrame:
    """The second machine run of :func:`fresh`, with its snapshot columns."""
    run = derived(spark, d, "declarations").where("(scan_id + seq) % 7 <> 0")
    return run.select(
        "scan_id", F.when(F.col("scan_id") % 5 == 0, F.concat("declaration_type", F.lit("_NAME"))).otherwise(F.col("declaration_type")).alias("declaration_type"),
        F.when(F.col("scan_id") % 6 == 0, "NOT_DETECTED").otherwise("AUTO_RESOLVED").alias("resolution_status"), F.concat(F.lit("new "), "machine_value").alias("machine_value"),
        "confidence", "raw_text", "image_id", "has_conflict", "source_block_id", S.level_of(F.col("confidence")).alias("confidence_level"), F.lit("run 2").alias("resolution_reason"))


@query("jn13_existing_versus_new", with_tables("declarations") + ", " + _UPSERT.replace(
    "SELECT coalesce(o.scan_id", "SELECT resolution_status, reviewed, count(*) AS n FROM (SELECT coalesce(o.scan_id") + ") q GROUP BY ALL")
def jn13(spark, d):
    return RV.upsert_declarations(stored(spark, d), fresh(spark, d)).groupBy("resolution_status", "reviewed").agg(F.count("*").alias("n"))


def review_actions(spark, d) -> DataFrame:
    """Audit events as review actions: the user reviews declarations of scan = event id mod user."""
    e = read_table(spark, d, "events")
    return e.select(
        (F.col("user_id") * 10 + F.col("event_id") % 3).alias("declaration_id"),
        F.when(F.col("event_id") % 4 == 0, "CONFIRMED").when(F.col("event_id") % 4 == 1, "REJECTED").otherwise("CORRECTED").alias("action"),
        F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("fix "), F.col("event_id").cast("string"))).alias("value"),
        F.col("user_id").alias("reviewed_by"), F.col("ts").alias("acted_at"), F.col("event_id").alias("action_id"))


@query("sta2_review_fold", with_tables("declarations") + """,
act AS (SELECT user_id * 10 + event_id % 3 AS declaration_id, CASE event_id % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' ELSE 'CORRECTED' END AS action,
        CASE WHEN event_id % 4 = 2 THEN 'fix ' || CAST(event_id AS VARCHAR) END AS value, user_id, ts, event_id FROM events WHERE event_id % 4 <> 3),
last AS (SELECT declaration_id, arg_max(action, event_id) AS action, arg_max(value, event_id) FILTER (action = 'CORRECTED') AS fix, arg_max(user_id, event_id) AS reviewed_by, arg_max(ts, event_id) AS reviewed_at FROM act GROUP BY 1)
SELECT d.declaration_id, d.machine_value, coalesce(l.fix, CAST(d.amount AS VARCHAR)) AS normalized_value, l.reviewed_at, CASE WHEN l.action = 'REJECTED' THEN 'REJECTED' WHEN l.action IS NOT NULL THEN 'CONFIRMED' ELSE d.resolution_status END AS resolution_status,
  CASE l.action WHEN 'CONFIRMED' THEN d.machine_value WHEN 'CORRECTED' THEN l.fix END AS reviewed_value, coalesce(l.fix, d.machine_value) AS canonical_value, l.action IS NOT NULL AS reviewed, l.reviewed_by
FROM declarations d LEFT JOIN last l USING (declaration_id)""")
def sta2(spark, d):
    return RV.apply_reviews(unreviewed(spark, d), review_actions(spark, d)).drop("scan_id", "declaration_type")


def unreviewed(spark, d) -> DataFrame:
    """Declarations as the machine left them."""
    return derived(spark, d, "declarations").select(
        "declaration_id", "scan_id", "declaration_type", "machine_value", "resolution_status", F.lit(None).cast("string").alias("reviewed_value"),
        F.col("machine_value").alias("canonical_value"), F.col("amount").cast("string").alias("normalized_value"), F.lit(False).alias("reviewed"), F.lit(None).cast("bigint").alias("reviewed_by"))


def status_events(spark, d) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("upload", "process", "ocr_done", "extract", "last_image_deleted", "all_failed", "view")])
    return read_table(spark, d, "events").select(
        F.col("user_id").alias("scan_id"), F.element_at(names, ((F.col("event_id") * 5 + F.col("user_id")) % 7 + 1).cast("int")).alias("event"),
        "ts", F.col("event_id").alias("seq"))


@query("sta3_status_machine", """
WITH RECURSIVE ev AS (SELECT user_id AS scan_id, ['upload', 'process', 'ocr_done', 'extract', 'last_image_deleted', 'all_failed', 'view'][(event_id * 5 + user_id) % 7 + 1] AS e,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
run AS (SELECT DISTINCT scan_id, CAST(0 AS BIGINT) AS rn, n, 'CREATED' AS status FROM ev
  UNION ALL SELECT r.scan_id, ev.rn, r.n, CASE WHEN e = 'upload' AND status = 'CREATED' THEN 'IMAGES_UPLOADED' WHEN e = 'last_image_deleted' AND status = 'IMAGES_UPLOADED' THEN 'CREATED'
    WHEN e = 'process' THEN 'PROCESSING' WHEN e = 'ocr_done' THEN 'OCR_COMPLETED' WHEN e = 'all_failed' THEN 'FAILED'
    WHEN e = 'extract' AND status IN ('OCR_COMPLETED', 'IMAGES_UPLOADED', 'PROCESSING') THEN 'DECLARATIONS_EXTRACTED' ELSE status END
  FROM run r JOIN ev ON ev.scan_id = r.scan_id AND ev.rn = r.rn + 1)
SELECT scan_id, status, n AS n_events FROM run WHERE rn = n""")
def sta3(spark, d):
    return RV.fold_status(status_events(spark, d))


# ----------------------------------------------------------------------------- rules
@query("rul1_split_resolved", with_tables("declarations") + """
SELECT declaration_id, resolution_status IN ('AUTO_RESOLVED', 'CONFIRMED') AS is_resolved, resolution_status IN ('NEEDS_REVIEW', 'CONFLICT') AS needs_review FROM declarations""")
def rul1(spark, d):
    return RU.split_resolved(derived(spark, d, "declarations")).select("declaration_id", "is_resolved", "needs_review")


_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(f"'{r[k]}'" if isinstance(r[k], str) else str(r[k]) for k in (
        "rule_code", "name", "target", "min_confidence", "reason_pass", "reason_fail", "reason_review", "expected")) + ")" for r in V.RULES
) + ") r(rule_code, name, target, min_confidence, reason_pass, reason_fail, reason_review, expected))"
_FINDINGS = _RULES + """,
u AS (SELECT scan_id, declaration_type AS target, resolution_status IN ('AUTO_RESOLVED', 'CONFIRMED') AS ok, arg_max(raw_text, confidence) AS raw_text, max(confidence) AS confidence, arg_max(source_block_id, confidence) AS block, CAST(arg_max(amount, confidence) AS VARCHAR) AS normal
      FROM declarations GROUP BY ALL),
findings AS (SELECT s.scan_id, r.rule_code, CASE WHEN o.scan_id IS NOT NULL THEN 'REVIEW' WHEN k.scan_id IS NULL THEN 'FAIL' WHEN k.confidence < r.min_confidence THEN 'REVIEW' ELSE 'PASS' END AS status,
  CASE WHEN o.scan_id IS NOT NULL THEN 'MANUAL_REVIEW_TRIGGERED' WHEN k.scan_id IS NULL THEN reason_fail WHEN k.confidence < r.min_confidence THEN reason_review ELSE reason_pass END AS reason_code,
  CASE WHEN o.scan_id IS NOT NULL THEN 'Unresolved or insufficient evidence requires human review.' WHEN k.scan_id IS NULL THEN 'Missing required declaration: ' || name
       WHEN k.confidence < r.min_confidence THEN printf('Declaration extracted with low confidence (%.2f). Human review required.', k.confidence) ELSE 'Valid declaration detected: ' || k.raw_text END AS message,
  coalesce(o.raw_text, k.raw_text) AS detected_text, expected AS expected_requirement, coalesce(o.confidence, k.confidence, 1.0) AS confidence, coalesce(o.block, k.block) AS source_block_id, CASE WHEN o.scan_id IS NOT NULL THEN o.normal ELSE k.normal END AS detected_normalized
FROM (SELECT p_partkey AS scan_id FROM part) s CROSS JOIN rules r LEFT JOIN u o ON o.scan_id = s.scan_id AND o.target = r.target AND NOT o.ok LEFT JOIN u k ON k.scan_id = s.scan_id AND k.target = r.target AND k.ok)"""


def findings_of(spark, d) -> DataFrame:
    scans = read_table(spark, d, "part").select(F.col("p_partkey").alias("scan_id"))
    return RU.evaluate_presence(scans, derived(spark, d, "declarations").withColumn("normalized_value", F.col("amount").cast("string")))


@query("rul2_presence_findings", with_tables("declarations") + ", " + _FINDINGS + " SELECT scan_id, rule_code, status, reason_code, confidence FROM findings")
def rul2(spark, d):
    return findings_of(spark, d).select("scan_id", "rule_code", "status", "reason_code", "confidence")


@query("rul3_finding_snapshot", with_tables("declarations") + ", " + _FINDINGS + f" SELECT scan_id, rule_code, '{V.RULE_SET_VERSION}' AS rule_version, message, detected_text, detected_normalized, expected_requirement, source_block_id FROM findings")
def rul3(spark, d):
    return findings_of(spark, d).select("scan_id", "rule_code", "rule_version", "message", "detected_text", "detected_normalized", "expected_requirement", "source_block_id")


@query("jn9_rules_times_scans", with_tables("declarations") + ", " + _FINDINGS + " SELECT rule_code, status, count(*) AS n FROM findings GROUP BY ALL")
def jn9(spark, d):
    return findings_of(spark, d).groupBy("rule_code", "status").agg(F.count("*").alias("n"))


@query("win6_best_per_rule", with_tables("declarations") + """
SELECT scan_id, declaration_type, is_resolved, declaration_id FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, declaration_type, is_resolved ORDER BY confidence DESC, seq) AS rn FROM (
  SELECT *, resolution_status IN ('AUTO_RESOLVED', 'CONFIRMED') AS is_resolved FROM declarations) q) q WHERE rn = 1""")
def win6(spark, d):
    return RU.best_per_rule(derived(spark, d, "declarations")).select("scan_id", "declaration_type", "is_resolved", "declaration_id")


@query("rul4_conditions", with_tables("declarations") + """
SELECT declaration_id, coalesce(declaration_type IN ('MRP', 'NET_QUANTITY') AND amount >= 10 AND amount <= 950 AND regexp_matches(raw_text, '[0-9]') AND resolution_status <> 'REJECTED' AND image_id IS NOT NULL AND has_conflict = FALSE, FALSE) AS satisfied FROM declarations""")
def rul4(spark, d):
    checks = [{"field": "declaration_type", "operator": "in", "value": ["MRP", "NET_QUANTITY"]}, {"field": "amount", "operator": "gte", "value": 10},
              {"field": "amount", "operator": "lte", "value": 950}, {"field": "raw_text", "operator": "regex", "value": "[0-9]"},
              {"field": "resolution_status", "operator": "neq", "value": "REJECTED"}, {"field": "image_id", "operator": "exists"},
              {"field": "has_conflict", "operator": "eq", "value": False}]
    return RU.check_conditions(derived(spark, d, "declarations"), checks).select("declaration_id", "satisfied")


#: A rule row for each brand: JSON whose limits come from the brand's parts.
_RULE_JSON = """'{"type": "' || CASE k % 4 WHEN 0 THEN 'conditional' WHEN 1 THEN 'value_range' ELSE 'syntax' END || '", "target": "' || CASE k % 3 WHEN 0 THEN 'MRP' WHEN 1 THEN 'NET_QUANTITY' ELSE 'CONSUMER_CARE_PHONE' END
  || '", "conditions": [' || CASE k % 3 WHEN 0 THEN '{"field": "normalized_value.currency", "operator": "in", "value": ["INR", "EUR"]}, {"field": "normalized_value.amount", "operator": "lte", "value": ' || CAST(price % 900 AS STRING) || '}, {"field": "has_conflict", "value": false}'
    WHEN 1 THEN '{"field": "normalized_value.unit", "operator": "neq", "value": "kg"}, {"field": "normalized_value.amount", "operator": "gte", "value": ' || CAST(k % 20 AS STRING) || '.5}, {"operator": "regex", "value": "^[0-9]+ ?[a-z]+"}'
    ELSE '{"field": "image_id", "operator": "exists", "value": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '}, {"field": "raw_text", "operator": "gte", "value": "1' || CAST(k % 9 AS STRING) || '"}' END
  || ']' || CASE k % 5 WHEN 0 THEN '' ELSE ', "min_confidence": 0.' || CAST(4 + k % 5 AS STRING) END || '}'"""


@query("rul4_rules_from_json", with_tables("declarations") + f""",
r AS (SELECT p_brand AS rule_code, {_RULE_JSON.replace('STRING', 'VARCHAR')} AS rule FROM (SELECT p_brand, CAST(substr(p_brand, 7) AS INT) AS k, max(CAST(trunc(p_retailprice) AS INT)) AS price FROM part GROUP BY p_brand) b),
d AS (SELECT *, CASE WHEN raw_text LIKE 'MRP Rs.%' THEN 'INR' END AS currency, nullif(regexp_extract(raw_text, '[0-9] ?([a-z]+)$', 1), '') AS unit FROM declarations),
c AS (SELECT rule_code, unnest(json_extract(rule, '$.conditions[*]')) AS c FROM r),
t AS (SELECT rule_code, coalesce(c->>'$.field', 'raw_text') AS field, coalesce(c->>'$.operator', 'eq') AS op, c->'$.value' AS o FROM c),
j AS (SELECT d.declaration_id, t.rule_code, op, o, CASE field WHEN 'normalized_value.currency' THEN currency WHEN 'normalized_value.amount' THEN CAST(amount AS VARCHAR) WHEN 'normalized_value.unit' THEN unit
    WHEN 'image_id' THEN CAST(image_id AS VARCHAR) WHEN 'has_conflict' THEN CAST(has_conflict AS VARCHAR) ELSE raw_text END AS v
  FROM d JOIN r ON r.rule->>'$.target' = d.declaration_type JOIN t ON t.rule_code = r.rule_code),
m AS (SELECT declaration_id, rule_code, CAST(count(*) AS INT) AS n_conditions, CAST(count_if(coalesce(CASE op WHEN 'eq' THEN lower(v) = (o->>'$') WHEN 'neq' THEN v <> (o->>'$') WHEN 'in' THEN list_contains(o->>'$[*]', v) WHEN 'regex' THEN regexp_matches(v, o->>'$')
    WHEN 'exists' THEN (v IS NOT NULL) = ((o->>'$') <> 'false') WHEN 'gte' THEN CASE WHEN json_type(o) = 'VARCHAR' THEN v >= (o->>'$') ELSE TRY_CAST(v AS DOUBLE) >= CAST(o->>'$' AS DOUBLE) END WHEN 'lte' THEN TRY_CAST(v AS DOUBLE) <= CAST(o->>'$' AS DOUBLE) END, FALSE)) AS INT) AS n_met
  FROM j GROUP BY ALL)
SELECT m.rule_code, d.scan_id, declaration_id, n_conditions, n_met, CASE WHEN resolution_status IN ('NEEDS_REVIEW', 'CONFLICT') THEN 'REVIEW' WHEN n_met < n_conditions AND r.rule->>'$.type' = 'conditional' THEN 'NOT_APPLICABLE' WHEN n_met < n_conditions THEN 'FAIL'
  WHEN confidence < coalesce(CAST(r.rule->>'$.min_confidence' AS DOUBLE), 0.7) THEN 'REVIEW' ELSE 'PASS' END AS status
FROM m JOIN d USING (declaration_id) JOIN r USING (rule_code)""")
def rul4_rules(spark, d):
    brands = read_table(spark, d, "part").groupBy("p_brand").agg(F.substring("p_brand", 7, 9).cast("int").alias("k"), F.max(F.col("p_retailprice").cast("int")).alias("price"))
    rules = brands.select(F.col("p_brand").alias("rule_code"), F.expr(_RULE_JSON).alias("rule"))
    text = F.col("raw_text")
    value = F.struct(F.when(text.startswith("MRP Rs."), "INR").alias("currency"), F.col("amount"), F.nullif(F.regexp_extract(text, "[0-9] ?([a-z]+)$", 1), F.lit("")).alias("unit"))
    return RC.evaluate_rules(derived(spark, d, "declarations").withColumn("normalized_value", value), rules)


_VERSIONS = """
SELECT 'RULE_' || o_orderpriority AS rule_code, CAST(year(o_orderdate) AS STRING) AS rule_version, min(o_orderdate) AS valid_from,
       CASE WHEN year(o_orderdate) % 3 = 0 THEN NULL ELSE max(o_orderdate) END AS valid_to, year(o_orderdate) <> 1997 AS is_active
FROM {orders} GROUP BY o_orderpriority, year(o_orderdate)"""


@query("rul5_rule_version_as_of", f"WITH v AS ({_VERSIONS.replace('{orders}', 'orders')})" + """
SELECT o_orderkey AS inspection_id, rule_code, arg_max(rule_version, valid_from) AS rule_version
FROM (SELECT o_orderkey, 'RULE_' || o_orderpriority AS code, o_orderdate + INTERVAL 40 DAY AS seen FROM orders) o JOIN v ON v.rule_code = o.code AND is_active AND valid_from <= seen AND (valid_to IS NULL OR seen < valid_to) GROUP BY ALL""")
def rul5(spark, d):
    orders = read_table(spark, d, "orders")
    versions = spark.sql(_VERSIONS, orders=orders)
    inspections = orders.select(F.col("o_orderkey").alias("inspection_id"), F.concat(F.lit("RULE_"), "o_orderpriority").alias("rule_code"),
                                (F.col("o_orderdate") + F.expr("INTERVAL 40 DAY")).alias("inspected_at"))
    return RU.rules_as_of(inspections, versions)


_SUMMARY = _FINDINGS + """,
summary AS (SELECT f.scan_id, count(*) AS total_rules, count_if(status = 'PASS') AS passed, count_if(status = 'FAIL') AS failed, count_if(status = 'REVIEW') AS review, 0 AS not_applicable,
  CASE WHEN count_if(status = 'FAIL') > 0 THEN 'FAIL' WHEN count_if(status = 'REVIEW') > 0 OR coalesce(any_value(w.waiting), FALSE) THEN 'REVIEW' ELSE 'PASS' END AS overall_status
FROM findings f LEFT JOIN (SELECT scan_id, bool_or(resolution_status IN ('NEEDS_REVIEW', 'CONFLICT')) AS waiting FROM declarations GROUP BY 1) w USING (scan_id) GROUP BY f.scan_id)"""


@query("agg8_compliance_summary", with_tables("declarations") + ", " + _SUMMARY + " SELECT * FROM summary")
def agg8(spark, d):
    return RU.compliance_summary(findings_of(spark, d), derived(spark, d, "declarations"))


# ------------------------------------------------------------------------- analytics
@query("agg7_declaration_counts", with_tables("declarations") + """
SELECT scan_id, count(*) AS total, count_if(resolution_status IN ('NEEDS_REVIEW', 'CONFLICT')) AS unreviewed, count_if(resolution_status = 'CONFIRMED') AS confirmed, 0 AS corrected,
  count_if(resolution_status = 'REJECTED') AS rejected FROM declarations GROUP BY scan_id""")
def agg7(spark, d):
    return A.declaration_counts(derived(spark, d, "declarations"))


@query("agg7b_declaration_counts_ui", with_tables("declarations") + """
SELECT scan_id, count(*) AS total, count_if(resolution_status IN ('NEEDS_REVIEW', 'CONFLICT')) AS unreviewed, count_if(resolution_status IN ('CONFIRMED', 'AUTO_RESOLVED')) AS confirmed, 0 AS corrected,
  count_if(resolution_status = 'REJECTED') AS rejected FROM declarations GROUP BY scan_id""")
def agg7b(spark, d):
    return A.declaration_counts(derived(spark, d, "declarations"), auto_counts_as_confirmed=True)


_CHECK = "items AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{t}')" for i, ts in V.CHECKLIST for t in ts) + """) t(item, type)),
checked AS (SELECT s.scan_id, i.item, count(d.declaration_id) AS matching, CASE WHEN count(d.declaration_id) = 0 THEN 'NOT_DETECTED' WHEN bool_or(d.has_conflict) THEN 'CONFLICT'
  WHEN bool_or(d.resolution_status IN ('CONFIRMED', 'AUTO_RESOLVED')) THEN 'CONFIRMED' WHEN bool_and(d.resolution_status = 'REJECTED') THEN 'REJECTED' ELSE 'NEEDS_REVIEW' END AS status
FROM (SELECT p_partkey AS scan_id FROM part) s CROSS JOIN items i LEFT JOIN declarations d ON d.scan_id = s.scan_id AND d.declaration_type = i.type GROUP BY s.scan_id, i.item)"""


def _checklist(spark, d):
    return A.checklist(read_table(spark, d, "part").select(F.col("p_partkey").alias("scan_id")), derived(spark, d, "declarations"))


@query("jn15_checklist", with_tables("declarations") + ", " + _CHECK + " SELECT scan_id, item, status, matching FROM checked")
def jn15(spark, d):
    return _checklist(spark, d)


@query("agg19_completeness", with_tables("declarations") + ", " + _CHECK + " SELECT scan_id, count_if(status NOT IN ('NOT_DETECTED', 'REJECTED')) AS present, count(*) AS of_items FROM checked GROUP BY scan_id")
def agg19(spark, d):
    return A.completeness(_checklist(spark, d))


@query("agg16_kpi_summary", with_tables("declarations") + ", " + _SUMMARY + """
SELECT count(*) AS inspections, count_if(overall_status = 'PASS') AS passed, count_if(overall_status = 'FAIL') AS violations, count_if(overall_status = 'REVIEW') AS review_queue,
  round(count_if(overall_status = 'PASS') / count(*), 4) AS pass_rate FROM summary""")
def agg16(spark, d):
    return A.kpi_summary(RU.compliance_summary(findings_of(spark, d), derived(spark, d, "declarations")))


@query("agg17_violation_breakdown", with_tables("declarations") + ", " + _FINDINGS + """
SELECT CASE WHEN grouping(p_type) = 1 THEN 'ALL' ELSE p_type END AS category, CASE WHEN grouping(rule_code) = 1 THEN 'ALL' ELSE rule_code END AS rule_code, count(*) AS n
FROM findings JOIN part ON p_partkey = scan_id WHERE status = 'FAIL' GROUP BY CUBE (p_type, rule_code)""")
def agg17(spark, d):
    category = read_table(spark, d, "part").select(F.col("p_partkey").alias("scan_id"), F.col("p_type").alias("category"))
    return A.violation_breakdown(findings_of(spark, d), category)


@query("agg18_trend", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count_if(event_type = 'error') AS errors, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def agg18(spark, d):
    return A.trend(read_table(spark, d, "events"), "ts", "1 hour", F.count("*").alias("n"),
                   F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("total"))


# ------------------------------------------------------------------------ evaluation
_LABELLED = """
e AS (SELECT p_partkey AS record_id, 'MRP' AS type, p_size AS value FROM part UNION ALL SELECT p_partkey, 'NET_QUANTITY', p_size + 1 FROM part),
p AS (SELECT p_partkey AS record_id, 'MRP' AS type, CASE WHEN p_partkey % 5 = 0 THEN p_size + 9 ELSE p_size END AS value FROM part WHERE p_partkey % 3 <> 0
      UNION ALL SELECT p_partkey, 'NET_QUANTITY', p_size + 1 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'BEST_BEFORE', p_size FROM part WHERE p_partkey % 7 = 0),
o AS (SELECT coalesce(e.record_id, p.record_id) AS record_id, coalesce(e.type, p.type) AS type, CASE WHEN e.value = p.value THEN 'tp' WHEN p.value IS NOT NULL THEN 'fp' ELSE 'fn' END AS outcome
      FROM e FULL JOIN p ON e.record_id = p.record_id AND e.type = p.type)"""


@query("jn8_expected_versus_predicted", f"WITH {_LABELLED} SELECT CAST(record_id AS VARCHAR) AS record_id, type, outcome FROM o")
def jn8(spark, d):
    return EV.labelled_outcomes(labelled_rows(spark, d))


@query("set2_union_of_types", f"WITH {_LABELLED} SELECT CAST(record_id AS VARCHAR) AS record_id, count(DISTINCT type) AS n_types FROM o GROUP BY 1")
def set2(spark, d):
    return EV.labelled_outcomes(labelled_rows(spark, d)).groupBy("record_id").agg(F.countDistinct("type").alias("n_types"))


_PRF = """
SELECT type, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM (
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM (
SELECT coalesce(type, 'ALL') AS type, count_if(outcome = 'tp') AS tp, count_if(outcome = 'fp') AS fp, count_if(outcome = 'fn') AS fn FROM o GROUP BY ROLLUP (type)) a) b"""


@query("agg9_precision_recall", f"WITH {_LABELLED} {_PRF}")
def agg9(spark, d):
    return EV.prf(EV.labelled_outcomes(labelled_rows(spark, d)))


@query("agg9_quality_heuristic", """
WITH o AS (SELECT CASE lang WHEN 'en' THEN 'en' ELSE 'other' END AS type, CASE WHEN quality = 1 AND n_chars > 1000 THEN 'tp' WHEN n_chars > 1000 THEN 'fp' WHEN quality = 1 THEN 'fn' END AS outcome
  FROM labels JOIN documents USING (doc_id) WHERE n_chars > 1000 OR quality = 1) """ + _PRF)
def agg9_documents(spark, d):
    """Documented heuristic as prediction: a document longer than 1000 characters is of good quality."""
    docs = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    kind = F.when(F.col("lang") == "en", "en").otherwise("other")
    yes = F.lit("1")
    expected = docs.where("quality = 1").select(F.col("doc_id").alias("record_id"), kind.alias("type"), yes.alias("value"), F.lit(0).alias("pos"))
    predicted = docs.where("n_chars > 1000").select(F.col("doc_id").alias("record_id"), kind.alias("type"), yes.alias("value"), F.lit(0).alias("pos"))
    return EV.prf(EV.outcomes(expected, predicted))


@query("agg10_minimum_records_gate", """
SELECT count(*) AS labeled_packages, 50 AS threshold_required, CASE WHEN count(*) < 50 THEN 'benchmark dataset pending' ELSE 'COMPLETED' END AS status FROM labels""")
def agg10(spark, d):
    return EV.gate(read_table(spark, d, "labels"))


_TRUTH = "'MRP Rs ' || printf('%.2f', p_retailprice) || ' net weight ' || CAST(p_size AS STRING) || ' g ' || p_name"
_HYP = "CASE p_partkey % 4 WHEN 0 THEN 'MRP R5 ' || printf('%.2f', p_retailprice) || ' net weight ' || CAST(p_size AS STRING) || ' g ' || p_name WHEN 1 THEN 'MRP Rs net wei9ht g ' || p_name WHEN 2 THEN p_name || ' extra' ELSE '' END"


def _pairs(spark, d) -> DataFrame:
    return read_table(spark, d, "part").select(
        "p_partkey", F.expr(f"CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE {_TRUTH} END").alias("ground_truth"), F.expr(_HYP).alias("hypothesis"))


@query("agg13_character_error_rate", f"""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE {_TRUTH} END AS g, {_HYP} AS h FROM part)
SELECT p_partkey, CASE WHEN g IS NOT NULL THEN round(least(1.0, levenshtein(g, h) / length(g)), 4) END AS cer FROM t""")
def agg13(spark, d):
    return EV.error_rates(_pairs(spark, d)).select("p_partkey", "cer")


@query("agg14_word_error_rate", f"""
WITH t AS (SELECT p_partkey, string_split(CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE {_TRUTH} END, ' ') AS g, [w for w in string_split({_HYP}, ' ') if w <> ''] AS h FROM part),
v AS (SELECT *, list_distinct(list_concat(g, h)) AS vocab FROM t)
SELECT p_partkey, CASE WHEN g IS NOT NULL THEN round(least(1.0, levenshtein(array_to_string([chr(48 + CAST(list_position(vocab, w) AS INT)) for w in g], ''), array_to_string([chr(48 + CAST(list_position(vocab, w) AS INT)) for w in h], '')) / len(g)), 4) END AS wer FROM v""")
def agg14(spark, d):
    return EV.error_rates(_pairs(spark, d)).select("p_partkey", "wer")
