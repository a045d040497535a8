"""Queries over chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.operators import analytics as A
from packlens.operators import conversation as CV
from packlens.operators import quality as QL
from packlens.plans.decisions import _FINDINGS, findings_of
from packlens.plans.registry import ORACLES, query
from packlens.plans.sql_parts import table, with_tables
from packlens.plans.tables import _STATUS, _WARN
from packlens.session import shared_folder
from packlens.sources.corpus import derived


def _alt(patterns: list[str]) -> str:
    return "'" + "|".join(patterns).replace("'", "''") + "'"


def _m(patterns: list[str]) -> str:
    return f"regexp_matches(low, {_alt(patterns)})"


_FIELDS = "[x for x in [" + ", ".join(f"CASE WHEN {_m(p)} THEN '{f}' END" for f, p in V.FIELD_PATTERNS.items()) + "] if x IS NOT NULL]"
_PANEL = "CASE " + " ".join(f"WHEN {_m(p)} THEN '{k}'" for k, p in V.PANEL_PATTERNS.items()) + " END"
_INTENT = f"""
low AS (SELECT *, lower(trim(text, E' \\n\\t\\r')) AS low FROM utterances),
tagged AS (SELECT *, {_FIELDS} AS fields, {_PANEL} AS panel, len(regexp_extract_all(low, '\\w+')) AS n_words, product_name IS NOT NULL AS has_product, {_m(V.LEGAL_PATTERNS)} AS legal FROM low),
intents AS (SELECT *, CASE WHEN {_m(V.POLITENESS_PATTERNS)} AND n_words <= 4 AND len(fields) = 0 THEN 1 WHEN {_m(V.GREETING_PATTERNS)} AND n_words <= 5 AND len(fields) = 0 THEN 2
  WHEN {_m(V.CAPABILITY_PATTERNS)} AND len(fields) = 0 THEN 3 WHEN {_m(V.QUALITY_PATTERNS)} AND NOT (list_contains(fields, 'mrp') AND n_words > 8) THEN 4
  WHEN legal AND NOT has_product AND NOT (contains(low, 'this') OR contains(low, 'my') OR contains(low, 'it')) THEN 5 WHEN len(fields) > 0 THEN 6 WHEN legal THEN 7
  WHEN {_m(V.OVERVIEW_PATTERNS)} OR (has_product AND contains(low, lower(product_name))) THEN 8 ELSE 9 END AS step FROM tagged),
named AS (SELECT *, ['POLITENESS_OR_THANKS', 'GREETING_OR_CHITCHAT', 'SYSTEM_NAVIGATION_HELP', 'IMAGE_QUALITY_DIAGNOSTIC', 'LEGAL_REGULATION_INQUIRY', 'SPECIFIC_DECLARATION_CHECK',
  'LEGAL_REGULATION_INQUIRY', 'PRODUCT_COMPLIANCE_OVERVIEW', 'GENERAL_KNOWLEDGE'][step] AS intent,
  CASE WHEN step IN (4, 5, 6) THEN fields ELSE [] END AS target_fields, CASE WHEN step >= 4 THEN panel END AS panel_referenced,
  CASE WHEN step IN (4, 6, 8) THEN TRUE WHEN step IN (2, 9) THEN has_product ELSE FALSE END AS requires_scan_data, step >= 5 AS requires_legal_rules,
  CAST([0.98, 0.99, 0.95, 0.92, 0.94, 0.95, 0.9, 0.88, 0.75][step] AS DOUBLE) AS confidence FROM intents)"""


#: The same over the given messages, whose words may have accents.
_GIVEN = _INTENT.replace("FROM utterances", "FROM messages").replace("'\\w+'", "'[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'")


def classified(spark: SparkSession, d: str, source: str = "utterances") -> DataFrame:
    return CV.classify_intents(derived(spark, d, source))


@query("nlp1_target_fields", with_tables("utterances") + ", " + _INTENT + " SELECT conv_id, turn, array_to_string(fields, ',') AS fields FROM tagged")
def nlp1(spark, d, source="utterances"):
    rows = derived(spark, d, source).withColumn("low", F.lower("text"))
    return rows.select("conv_id", "turn", F.array_join(CV.target_fields(F.col("low")), ",").alias("fields"))


@query("nlp2_panel_reference", with_tables("utterances") + ", " + _INTENT + " SELECT conv_id, turn, panel FROM tagged")
def nlp2(spark, d, source="utterances"):
    rows = derived(spark, d, source).withColumn("low", F.lower("text"))
    return rows.select("conv_id", "turn", CV.panel_ref(F.col("low")).alias("panel"))


@query("nlp3_classify_intent", with_tables("utterances") + ", " + _INTENT + """
SELECT conv_id, turn, intent, array_to_string(target_fields, ',') AS target_fields, panel_referenced, requires_scan_data, requires_legal_rules, confidence FROM named""")
def nlp3(spark, d, source="utterances"):
    return classified(spark, d, source).select(
        "conv_id", "turn", "intent", F.array_join("target_fields", ",").alias("target_fields"), "panel_referenced",
        "requires_scan_data", "requires_legal_rules", "confidence")


@query("nlp4_rewrite_query", with_tables("utterances") + ", " + _INTENT + f"""
SELECT conv_id, turn, CASE WHEN step IN (6, 8) AND has_product THEN regexp_replace(trim(text, E' \\n\\t\\r'), '(?i){V.PRONOUNS}', '''' || product_name || '''', 'g') ELSE trim(text, E' \\n\\t\\r') END AS rewritten_query FROM named""")
def nlp4(spark, d, source="utterances"):
    return classified(spark, d, source).select("conv_id", "turn", "rewritten_query")


@query("win4_history_window", """
SELECT conv_id, turn, CASE WHEN lower(role) IN ('user', 'human') THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN length(trim(text, E' \\n\\t\\r')) > 400 THEN left(trim(text, E' \\n\\t\\r'), 400) || '... [truncated]' ELSE trim(text, E' \\n\\t\\r') END AS content
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) q WHERE rn <= 8""")
def win4(spark, d):
    from packlens.sources.tables import read_table

    return CV.prune_history(read_table(spark, d, "conversations"))


_QUESTIONS = ", questions AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id, conv_id AS scan_id, intent, target_fields, panel_referenced, requires_scan_data FROM named WHERE role = 'user')"
_MATCH = " OR ".join(
    f"(list_contains(q.target_fields, '{f}') AND (" + " OR ".join(f"contains(d.declaration_type, '{p}')" for p in parts) + "))"
    for f, parts in V.FIELD_TYPE_PARTS.items())


def questions(spark, d, source="utterances") -> DataFrame:
    return classified(spark, d, source).where("role = 'user'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.col("conv_id").alias("scan_id"), "intent", "target_fields",
        "panel_referenced", "requires_scan_data")


@query("nlp7_field_matches", with_tables("utterances", "declarations") + ", " + _INTENT + _QUESTIONS + f"""
SELECT q.question_id, d.declaration_id FROM questions q JOIN declarations d USING (scan_id) WHERE {_MATCH}""")
def nlp7(spark, d):
    pairs = questions(spark, d).where(F.size("target_fields") > 0).join(derived(spark, d, "declarations"), "scan_id")
    return pairs.where(CV.field_matches(F.col("target_fields"), F.col("declaration_type"))).select("question_id", "declaration_id")


@query("nlp6_context_header", with_tables("scans", "products") + """
SELECT s.scan_id, 'Active Product: ' || coalesce(nullif(trim(p.name), ''), s.scan_code) || CASE WHEN p.brand IS NOT NULL THEN ' (' || p.brand || ')' ELSE '' END || ' | Session Status: ' || s.status AS header
FROM scans s LEFT JOIN products p USING (product_id)""")
def nlp6(spark, d):
    rows = scan_context(spark, d)
    return rows.select("scan_id", CV.base_header(F.col("product"), F.col("brand"), F.col("status")).alias("header"))


def staged(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_context(spark, d) -> DataFrame:
    scans, products = derived(spark, d, "scans"), derived(spark, d, "products")
    return scans.join(products.hint("merge"), "product_id", "left").select(
        "scan_id", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "scan_code").alias("product"), "brand", "status")


_CTX = f"""
ctx AS (SELECT q.*, coalesce(nullif(trim(p.name), ''), s.scan_code) AS product, p.brand, s.status FROM questions q JOIN scans s ON s.scan_id = q.scan_id LEFT JOIN products p ON p.product_id = s.product_id
        WHERE NOT (intent IN ('SYSTEM_NAVIGATION_HELP', 'LEGAL_REGULATION_INQUIRY') AND NOT requires_scan_data)),
qual AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY image_id) AS pos, {_STATUS} AS qs, {_WARN} AS warns FROM images),
hits AS (SELECT q.question_id, d.*, row_number() OVER (PARTITION BY q.question_id ORDER BY d.seq) AS pos FROM ctx q JOIN declarations d USING (scan_id) WHERE intent = 'SPECIFIC_DECLARATION_CHECK' AND ({_MATCH})),
held AS (SELECT DISTINCT scan_id FROM declarations),
asked AS (SELECT * FROM ctx WHERE intent = 'SPECIFIC_DECLARATION_CHECK' AND scan_id IN (SELECT scan_id FROM held)),
broad AS (SELECT * FROM ctx WHERE intent NOT IN ('GREETING_OR_CHITCHAT', 'POLITENESS_OR_THANKS', 'IMAGE_QUALITY_DIAGNOSTIC') AND question_id NOT IN (SELECT question_id FROM asked)),
over AS (SELECT q.question_id, d.*, row_number() OVER (PARTITION BY q.question_id ORDER BY d.seq) AS pos FROM broad q JOIN declarations d USING (scan_id)),
rule_lines AS (SELECT scan_id, rule_code, status AS fs, '• Rule ' || rule_code || ' [' || status || ']: ' || message AS line FROM findings),
body AS (
SELECT c.question_id, 1 AS section, q.pos, CASE WHEN contains(image_type, panel_referenced) THEN '▶ ' ELSE '• ' END || image_type || ': Status=' || qs || printf(', BlurScore=%.1f (min 100), GlareRatio=%.1f%% (max 5.0%%)', blur_score, glare_score * 100)
  || CASE WHEN len(warns) > 0 THEN ', Flags: [''' || array_to_string(warns, ''', ''') || ''']' ELSE '' END AS line FROM ctx c JOIN qual q USING (scan_id) WHERE intent = 'IMAGE_QUALITY_DIAGNOSTIC' AND q.pos <= 5
UNION ALL
SELECT question_id, 2, pos, '• [' || declaration_type || '] ''' || raw_text || ''' (Confidence: ' || printf('%.2f', confidence) || ', Review: ' || resolution_status || ')' FROM hits WHERE pos <= 6
UNION ALL
SELECT question_id, 3, pos, line FROM (SELECT q.question_id, row_number() OVER (PARTITION BY q.question_id ORDER BY rule_code) AS pos, line FROM asked q JOIN rule_lines USING (scan_id)
  WHERE fs IN ('FAIL', 'REVIEW') OR len([x for x in q.target_fields if contains(rule_code, upper(x))]) > 0) z WHERE pos <= 3
UNION ALL
SELECT question_id, 4, pos, '• [' || declaration_type || ']: ''' || left(raw_text, 70) || ''' (Conf: ' || printf('%.2f', confidence) || ')' FROM over WHERE pos <= 8
UNION ALL
SELECT question_id, 5, pos, line FROM (SELECT q.question_id, row_number() OVER (PARTITION BY q.question_id ORDER BY rule_code) AS pos, line FROM broad q JOIN rule_lines USING (scan_id) WHERE fs IN ('FAIL', 'REVIEW')) z WHERE pos <= 5)
SELECT question_id, 0 AS section, 0 AS pos, 'Active Product: ' || product || CASE WHEN brand IS NOT NULL THEN ' (' || brand || ')' ELSE '' END || ' | Session Status: ' || status AS line FROM ctx
UNION ALL
SELECT question_id, 2, 0, '{V.CONTEXT_NOTE[0]}' || array_to_string(target_fields, ', ') || '{V.CONTEXT_NOTE[1]}' FROM asked WHERE question_id NOT IN (SELECT question_id FROM hits)
UNION ALL
SELECT DISTINCT question_id, section, 0, CASE section {" ".join(f"WHEN {k} THEN '{v}'" for k, v in V.CONTEXT_HEADINGS.items())} END FROM body
UNION ALL
SELECT * FROM body"""


@query("nlp5_select_context", with_tables("utterances", "scans", "products", "images", "declarations") + ", " + _INTENT + _QUESTIONS + ", " + _FINDINGS + ", " + _CTX)
def nlp5(spark, d, source="utterances"):
    quality = QL.classify(derived(spark, d, "images")).withColumn("seq", F.col("image_id")).withColumn("panel_type", F.col("image_type"))
    # both are read by several sections
    asked, findings = staged(questions(spark, d, source), "questions"), staged(findings_of(spark, d), "findings")
    return CV.select_context(asked, scan_context(spark, d), quality, derived(spark, d, "declarations"), findings, keep=lambda rows: staged(rows, "active"))


@query("agg20_context_savings", with_tables("utterances", "images", "declarations") + ", " + _INTENT + _QUESTIONS + ", " + _FINDINGS + f"""
SELECT q.question_id, CASE WHEN intent IN ('GREETING_OR_CHITCHAT', 'POLITENESS_OR_THANKS') THEN coalesce(nd, 0) * 30 + nq * 25 + coalesce(nf, 0) * 20 + 150
  WHEN intent IN ('SYSTEM_NAVIGATION_HELP', 'LEGAL_REGULATION_INQUIRY') THEN coalesce(nd, 0) * 30 + nq * 25 + 120
  WHEN intent = 'IMAGE_QUALITY_DIAGNOSTIC' THEN coalesce(nd, 0) * 30 + coalesce(nf, 0) * 20
  WHEN intent = 'SPECIFIC_DECLARATION_CHECK' AND nd IS NOT NULL THEN CASE WHEN nm IS NULL THEN 0 ELSE (nd - nm) * 30 END + nq * 25
  ELSE greatest(coalesce(nd, 0) - 8, 0) * 30 + CASE WHEN coalesce(nv, 0) > 0 THEN (nf - least(nv, 5)) * 20 ELSE 0 END END AS saved
FROM questions q JOIN (SELECT scan_id, count(*) AS nq FROM images GROUP BY 1) i USING (scan_id)
LEFT JOIN (SELECT scan_id, count(*) AS nd FROM declarations GROUP BY 1) d USING (scan_id)
LEFT JOIN (SELECT scan_id, count(*) AS nf, count_if(status IN ('FAIL', 'REVIEW')) AS nv FROM findings GROUP BY 1) f USING (scan_id)
LEFT JOIN (SELECT q.question_id, count(*) AS nm FROM questions q JOIN declarations d USING (scan_id) WHERE intent = 'SPECIFIC_DECLARATION_CHECK' AND ({_MATCH}) GROUP BY 1) m USING (question_id)""")
def agg20(spark, d, source="utterances"):
    counts = CV.context_counts(staged(questions(spark, d, source), "questions"), derived(spark, d, "images"), derived(spark, d, "declarations"), findings_of(spark, d))
    return counts.select("question_id", A.context_savings(F.col("intent"), F.col("n_decl"), F.col("n_quality"), F.col("n_findings"), F.col("n_matched"), F.col("n_violations")).alias("saved"))


@query("flt8_violations", with_tables("declarations") + ", " + _FINDINGS + """
SELECT scan_id, pos, '• Rule ' || rule_code || ' [' || status || ']: ' || message AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY rule_code) AS pos FROM findings WHERE status IN ('FAIL', 'REVIEW')) q WHERE pos <= 5""")
def flt8(spark, d):
    return CV.finding_lines(findings_of(spark, d))


def _over_messages(name: str, fn) -> None:
    """The query ``name`` over the messages as they were sent."""
    sql = ORACLES[name].replace(_INTENT, _GIVEN).replace(table("utterances"), table("messages"))
    query(f"{name}_given", sql)(lambda spark, d: fn(spark, d, "messages"))


for _name, _fn in (("nlp1_target_fields", nlp1), ("nlp2_panel_reference", nlp2), ("nlp3_classify_intent", nlp3), ("nlp4_rewrite_query", nlp4), ("nlp5_select_context", nlp5),
                   ("agg20_context_savings", agg20)):
    _over_messages(_name, _fn)
