"""Queries over layout, extraction and decision operators on the derived labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.functions import normalize as N
from packlens.functions import scores as S
from packlens.functions.text import found, title_case
from packlens.operators import consolidate as C
from packlens.operators import evidence as EVI
from packlens.operators import extract as E
from packlens.operators import layout as L
from packlens.operators import proximity as P
from packlens.operators.rules import compliance_summary, evaluate_presence
from packlens.plans import sql_candidates as Q
from packlens.plans.registry import query
from packlens.session import shared_folder
from packlens.plans.sql_parts import LINES, cap, conf, has, nutrition, rx, spans_sql
from packlens.sources.corpus import doc_blocks, label_blocks, label_blocks_sql, part_facts, PART_FACTS, sql_tables
from packlens.sources.tables import read_table

_B = f"WITH {label_blocks_sql()} "
_FACTS = f"WITH facts AS ({sql_tables(PART_FACTS)}) "


def ids_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def _span_rows(spans: DataFrame, *extra) -> DataFrame:
    ids = F.transform("blocks", lambda b: b["block_id"])
    return spans.select("image_id", "stage", ids_text(ids).alias("block_ids"), "text", "n_blocks", *extra)


# --------------------------------------------------------------------------- layout
@query("lay1_reading_order", _B + """
SELECT image_id, block_id, CAST(y1 / tol AS INT) AS band, row_number() OVER (PARTITION BY image_id ORDER BY CAST(floor(y1 / tol) AS INT), x1, block_order, block_id) - 1 AS reading_pos
FROM (SELECT *, greatest(10.0, avg(y2 - y1) OVER (PARTITION BY image_id) * 0.5) AS tol FROM blocks) q
""".replace("CAST(y1 / tol AS INT) AS band", "CAST(floor(y1 / tol) AS INT) AS band"))
def lay1(spark: SparkSession, d: str) -> DataFrame:
    return L.reading_order(label_blocks(spark, d)).select("image_id", "block_id", "band", "reading_pos")


@query("win1_reading_positions_documents", """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT doc_id AS image_id, doc_id * 2147483648 + pos - 1 AS block_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS reading_pos
FROM lines WHERE trim(line, E' \\n\\t\\r') <> ''
""")
def win1(spark, d):
    return L.reading_order(doc_blocks(spark, d)).select("image_id", "block_id", "reading_pos")


@query("lay2_reading_order_simple", _B + """
SELECT image_id, block_id, row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, block_order, block_id) - 1 AS reading_pos FROM blocks""")
def lay2(spark, d):
    return L.reading_order_simple(label_blocks(spark, d)).select("image_id", "block_id", "reading_pos")


@query("lay3_cluster_lines", _B + ", " + LINES + """
SELECT image_id, line_no, line_text AS text, array_to_string(ids, ',') AS block_ids, y1, y2 FROM chained""")
def lay3(spark, d):
    return L.lines_of_images(label_blocks(spark, d)).select(
        "image_id", "line_no", "text", ids_text(F.transform("blocks", lambda b: b["block_id"])).alias("block_ids"), "y1", "y2")


@query("lay4_proximate_lines", _B + ", " + LINES + """
SELECT image_id, line_no, round(height, 4) AS height, y1 - lag(y2) OVER w AS gap_above,
       coalesce(y1 - lag(y2) OVER w <= (height + lag(height) OVER w) / 2 * 1.8, FALSE) AS follows
FROM lines WINDOW w AS (PARTITION BY image_id ORDER BY line_no)""")
def lay4(spark, d):
    return line_gaps(L.lines_of_images(label_blocks(spark, d)))


def line_gaps(lines: DataFrame) -> DataFrame:
    return lines.select(
        "image_id", "line_no", F.round("height", 4).alias("height"), (F.col("y1") - F.col("up.y2")).alias("gap_above"),
        F.coalesce(L.proximate(F.col("up"), F.struct("y1", "y2", "height")), F.lit(False)).alias("follows"))


@query("lay4_document_lines_in_strips", """
WITH lines AS (SELECT doc_id, pos, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) q
  WHERE trim(text, E' \\n\\t\\r') <> '')
SELECT doc_id AS image_id, line_no, CAST(16 AS DOUBLE) AS height, 20 * (pos - lag(pos) OVER w) - 16 AS gap_above,
       coalesce(20 * (pos - lag(pos) OVER w) - 16 <= 28.8, FALSE) AS follows FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def lay4_documents(spark, d):
    # strips of 16 lines, so that most documents have several
    return line_gaps(L.lines_of_images(doc_blocks(spark, d), px=320))


@query("lay5_single_spans", _B + """
SELECT image_id, 0 AS stage, CAST(block_id AS VARCHAR) AS block_ids, trim(text) AS text, 1 AS n_blocks FROM blocks""")
def lay5(spark, d):
    return _span_rows(L.single_spans(label_blocks(spark, d)))


@query("lay6_line_spans", spans_sql() + """
SELECT image_id, stage, block_ids, text, n_blocks, b, c FROM spans WHERE stage = 1""")
def lay6(spark, d):
    return _span_rows(L.candidate_spans(label_blocks(spark, d), kinds=("line",)), "b", "c")


@query("lay7_multi_line_spans", spans_sql() + """
SELECT image_id, stage, block_ids, text, n_blocks FROM spans WHERE stage = 2""")
def lay7(spark, d):
    return _span_rows(L.candidate_spans(label_blocks(spark, d), kinds=("multi",)))


@query("lay8_span_confidence", spans_sql() + """
SELECT image_id, stage, block_ids, round(ocr, 6) AS ocr_conf FROM spans""")
def lay8(spark, d):
    return _span_rows(L.candidate_spans(label_blocks(spark, d)), F.round(S.mean_confidence(F.col("blocks")), 6).alias("ocr_conf")).drop("text", "n_blocks")


@query("lay9_union_bbox", spans_sql() + "SELECT image_id, stage, block_ids, x1, y1, x2, y2 FROM spans")
def lay9(spark, d):
    spans = L.candidate_spans(label_blocks(spark, d)).withColumn("box", S.union_bbox(F.col("blocks")))
    return _span_rows(spans, "box.*").drop("text", "n_blocks")


@query("lay10_average_confidence", _B + """
SELECT image_id, y1, count(*) AS n, round(avg(confidence), 4) AS avg_confidence FROM blocks GROUP BY image_id, y1""")
def lay10(spark, d):
    return L.cluster_lines(label_blocks(spark, d)).select(
        "image_id", "y1", F.size("blocks").alias("n"), S.average_ocr_confidence(F.col("blocks")).alias("avg_confidence"))


@query("lay11_evidence", spans_sql() + ", " + Q.C_MRP.replace("c_mrp AS (", "c_mrp AS MATERIALIZED (") + """
SELECT c.image_id, c.block_ids, s.n_blocks AS contributing_blocks, s.x1, s.y1, s.x2, s.y2, round(s.ocr, 4) AS average_ocr_confidence
FROM c_mrp c JOIN spans s USING (image_id, block_ids, stage)""")
def lay11(spark, d):
    cand = E.extract_candidates(label_blocks(spark, d), ("mrp",))
    return cand.select("image_id", ids_text(F.col("block_ids")).alias("block_ids"), F.size("block_ids").alias("contributing_blocks"),
                       "x1", "y1", "x2", "y2", F.col("breakdown.ocr_confidence").alias("average_ocr_confidence"))


@query("lay11_evidence_payload", spans_sql() + ", " + Q.C_MRP.replace("c_mrp AS (", "c_mrp AS MATERIALIZED (") + """,
e AS (SELECT image_id, block_ids, unnest(string_split(block_ids, ',')) AS block_id, generate_subscripts(string_split(block_ids, ','), 1) - 1 AS position FROM c_mrp)
SELECT e.image_id, image_type, block_ids, CAST(position AS INT) AS position, b.block_id, text, confidence, x1, y1, x2, y2, len(string_split(block_ids, ',')) AS n_blocks FROM e JOIN blocks b ON b.image_id = e.image_id AND CAST(b.block_id AS VARCHAR) = e.block_id""")
def lay11_payload(spark, d):
    blocks = label_blocks(spark, d)
    found = EVI.evidence_payload(E.extract_candidates(blocks, ("mrp",)), blocks)
    rows = found.select("image_id", "evidence.image_type", ids_text(F.col("block_ids")).alias("block_ids"), F.col("evidence.contributing_blocks_count").cast("long").alias("n_blocks"), F.posexplode("evidence.blocks").alias("position", "b"))
    return rows.select("image_id", "image_type", "block_ids", "position", F.col("b.id").alias("block_id"), "b.text", "b.confidence", "b.bbox.*", "n_blocks")


_RAW_OCR = """
SELECT p_partkey AS image_id, p_partkey AS block_id, ' ' || p_name || ' ' AS text,
       CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE CAST((p_partkey % 120) / CAST(100 AS DOUBLE) AS STRING) END AS score,
       CAST(1 + p_partkey % 3 AS DOUBLE) AS scale, 300 + p_size AS width, 200 + p_size AS height,
       CAST(p_partkey % 400 - 20 AS DOUBLE) AS px, CAST(p_size * 9 AS DOUBLE) AS py FROM {part}"""


@query("lay12_ocr_polygon_to_block", "WITH raw AS (" + sql_tables(_RAW_OCR) + """),
pts AS (SELECT *, [[px, py], [px + 100.5, py], [px + 100.5, py + 30.2], [px, py + 30.2]] AS poly FROM raw),
q AS (SELECT *, [round(greatest(0.0, least(CAST(width AS DOUBLE), p[1] / scale)), 1) for p in poly] AS xs,
      [round(greatest(0.0, least(CAST(height AS DOUBLE), p[2] / scale)), 1) for p in poly] AS ys FROM pts)
SELECT image_id, block_id, trim(text) AS text, round(greatest(0.0, least(1.0, coalesce(TRY_CAST(score AS DOUBLE), 0.5))), 4) AS confidence,
       CAST(trunc(list_min(xs)) AS INT) AS x1, CAST(trunc(list_min(ys)) AS INT) AS y1, CAST(trunc(list_max(xs)) AS INT) AS x2, CAST(trunc(list_max(ys)) AS INT) AS y2 FROM q""")
def lay12(spark, d):
    raw = spark.sql(_RAW_OCR, part=read_table(spark, d, "part"))

    def pt(dx, dy):
        return F.array(F.col("px") + dx, F.col("py") + dy)

    raw = raw.withColumn("polygon", F.array(pt(0.0, 0.0), pt(100.5, 0.0), pt(100.5, 30.2), pt(0.0, 30.2)))
    return L.blocks_from_ocr(raw).select("image_id", "block_id", "text", "confidence", "x1", "y1", "x2", "y2")


@query("jn5_neighborhood", _B + f""",
a AS MATERIALIZED (SELECT image_id, block_id, x1, y1, x2, y2 FROM blocks WHERE {has('text', V.DATE_ANCHORS['DATE_OF_PACKING'])} OR {has('text', V.BATCH)}),
v AS MATERIALIZED (SELECT image_id, block_id, x1, y1, x2, y2 FROM blocks WHERE image_id IN (SELECT image_id FROM a))
SELECT a.image_id, a.block_id AS anchor_id, v.block_id, greatest(v.x1 - a.x2, a.x1 - v.x2, 0) AS dx, greatest(v.y1 - a.y2, a.y1 - v.y2, 0) AS dy
FROM a JOIN v ON a.image_id = v.image_id
WHERE a.block_id <> v.block_id AND greatest(v.x1 - a.x2, a.x1 - v.x2, 0) <= 250 AND greatest(v.y1 - a.y2, a.y1 - v.y2, 0) <= 80""")
def jn5(spark, d):
    blocks = label_blocks(spark, d)
    text = F.col("text")
    anchors = blocks.where(found(text, V.DATE_ANCHORS["DATE_OF_PACKING"]) | found(text, V.BATCH)).select(
        "image_id", F.col("block_id").alias("anchor_id"), F.array("block_id").alias("block_ids"), "x1", "y1", "x2", "y2")
    return P.neighborhood(anchors, blocks).select("image_id", "anchor_id", "block_id", "dx", "dy")


@query("srt3_neighbours_by_distance", _B + """
SELECT image_id, anchor_id, block_id, row_number() OVER (PARTITION BY anchor_id ORDER BY d, block_order, block_id) AS rank FROM (
SELECT a.image_id, a.block_id AS anchor_id, v.block_id, v.block_order, greatest(v.x1 - a.x2, a.x1 - v.x2, 0) + greatest(v.y1 - a.y2, a.y1 - v.y2, 0) AS d
FROM blocks a JOIN blocks v ON a.image_id = v.image_id AND a.block_id <> v.block_id
 AND greatest(v.x1 - a.x2, a.x1 - v.x2, 0) <= 250 AND greatest(v.y1 - a.y2, a.y1 - v.y2, 0) <= 80
WHERE """ + f"{has('a.text', V.EMAIL)}) q")
def srt3(spark, d):
    blocks = label_blocks(spark, d)
    anchors = blocks.where(F.contains("text", F.lit("@")) & found(F.col("text"), V.EMAIL)).select(
        "image_id", F.col("block_id").alias("anchor_id"), F.array("block_id").alias("block_ids"), "x1", "y1", "x2", "y2")
    w = W.partitionBy("anchor_id").orderBy(F.col("dx") + F.col("dy"), "block_order", "block_id")
    return P.neighborhood(anchors, blocks).select("image_id", "anchor_id", "block_id", F.row_number().over(w).alias("rank"))


@query("jn6_nutrition_mask", _B + f"""
SELECT b.image_id, b.block_id, {nutrition('b.text')} OR EXISTS (SELECT 1 FROM blocks n WHERE n.image_id = b.image_id AND {nutrition('n.text')}
   AND NOT (b.y2 < n.y1 - 10 OR b.y1 > n.y2 + 10)) AS nutrition FROM blocks b""")
def jn6(spark, d):
    return L.nutrition_mask(label_blocks(spark, d)).select("image_id", "block_id", "nutrition")


# ----------------------------------------------------------------------- extraction
_KEY = ("image_id", "stage", "block_ids", "declaration_type", "raw_value", "confidence")


def _candidates(spark, d, *families) -> DataFrame:
    return E.extract_candidates(label_blocks(spark, d), families).withColumn("block_ids", ids_text(F.col("block_ids")))


def _fields(df: DataFrame, *fields: str) -> DataFrame:
    return df.select(*_KEY, *[F.col(f"normalized.{f}").alias(f) for f in fields])


_KEYS = ", ".join(_KEY)


@query("ext0_extract_candidates", Q.candidates_sql() + """
SELECT declaration_type, stage, count(*) AS n, count(DISTINCT raw_value) AS n_values, round(avg(confidence), 4) AS avg_confidence,
       count(DISTINCT block_ids) AS n_block_sets FROM cand GROUP BY declaration_type, stage""")
def ext0(spark, d):
    return _candidates(spark, d, *E.FAMILIES).groupBy("declaration_type", "stage").agg(
        F.count("*").alias("n"), F.countDistinct("raw_value").alias("n_values"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.countDistinct("block_ids").alias("n_block_sets"))


@query("ext1_mrp_labelled", Q.from_family("mrp", f"SELECT {_KEYS}, amount, taxes AS taxes_inclusive FROM c_mrp WHERE labelled"))
def ext1(spark, d):
    return _fields(_candidates(spark, d, "mrp").where("breakdown.has_explicit_label"), "amount", "taxes_inclusive")


@query("ext2_mrp_currency_only", Q.from_family("mrp", f"SELECT {_KEYS}, amount, taxes AS taxes_inclusive FROM c_mrp WHERE NOT labelled"))
def ext2(spark, d):
    return _fields(_candidates(spark, d, "mrp").where("NOT breakdown.has_explicit_label"), "amount", "taxes_inclusive")


_Q = f"SELECT {_KEYS}, value, unit, canonical_value, canonical_unit FROM c_qty WHERE how = "
_QF = ("value", "unit", "canonical_value", "canonical_unit")


@query("ext3_quantity_multipack", Q.from_family("quantity", _Q + "'multipack'"))
def ext3(spark, d):
    return _fields(_candidates(spark, d, "quantity").where("normalized.is_multipack"), *_QF)


@query("ext4_quantity_labelled", Q.from_family("quantity", _Q + "'labelled'"))
def ext4(spark, d):
    return _fields(_candidates(spark, d, "quantity").where("NOT normalized.is_multipack AND breakdown.has_explicit_label"), *_QF)


_COUNTED = "NOT normalized.is_multipack AND NOT breakdown.has_explicit_label AND coalesce(normalized.unit IN ('%s'), false)" % "', '".join(V.COUNT_UNITS)


@query("ext5_quantity_count", Q.from_family("quantity", _Q + "'counted'"))
def ext5(spark, d):
    return _fields(_candidates(spark, d, "quantity").where(_COUNTED), *_QF)


@query("ext6_quantity_standalone", Q.from_family("quantity", _Q + "'alone'"))
def ext6(spark, d):
    return _fields(_candidates(spark, d, "quantity").where(_COUNTED.replace("AND coalesce", "AND NOT coalesce")), *_QF)


@query("ext7_country_of_origin", Q.from_family("country", f"SELECT {_KEYS}, country, is_recognized FROM c_country"))
def ext7(spark, d):
    return _fields(_candidates(spark, d, "country"), "country", "is_recognized")


@query("ext8_dates", Q.from_family("dates", f"SELECT {_KEYS}, date, relative_duration, nearby FROM c_dates"))
def ext8(spark, d):
    c = _candidates(spark, d, "dates")
    return c.select(*_KEY, "normalized.date", "normalized.relative_duration", F.col("spatial_relation").isNotNull().alias("nearby"))


@query("jn7_nearest_value", Q.from_family("dates", f"SELECT {_KEYS} FROM c_dates WHERE nearby").replace("c_dates AS (", "c_dates AS MATERIALIZED ("))
def jn7(spark, d):
    return _candidates(spark, d, "dates").where("spatial_relation = 'nearby_block'").select(*_KEY)


@query("ext9_organisations", Q.from_family("organisations", f"SELECT {_KEYS}, name, address, pincode FROM c_orgs"))
def ext9(spark, d):
    return _fields(_candidates(spark, d, "organisations"), "name", "address", "pincode")


@query("ext10_consumer_care_phone", Q.from_family("care", f"SELECT {_KEYS}, digits FROM c_phone"))
def ext10(spark, d):
    return _fields(_candidates(spark, d, "care").where("declaration_type = 'CONSUMER_CARE_PHONE'"), "digits")


@query("ext11_consumer_care_email", Q.from_family("care", f"SELECT {_KEYS}, email FROM c_email"))
def ext11(spark, d):
    return _fields(_candidates(spark, d, "care").where("declaration_type = 'CONSUMER_CARE_EMAIL'"), "email")


@query("ext12_consumer_care_address", Q.from_family("care", f"SELECT {_KEYS} FROM c_care"))
def ext12(spark, d):
    return _candidates(spark, d, "care").where("declaration_type = 'CONSUMER_CARE_ADDRESS'").select(*_KEY)


@query("ext13_batch_number", Q.from_family("batch", f"SELECT {_KEYS}, nearby FROM c_batch"))
def ext13(spark, d):
    return _candidates(spark, d, "batch").select(*_KEY, F.col("spatial_relation").isNotNull().alias("nearby"))


@query("ext14_commodity_name", Q.from_family("commodity", f"SELECT {_KEYS} FROM c_commodity"))
def ext14(spark, d):
    return _candidates(spark, d, "commodity").select(*_KEY)


_USP = "'Unit Sale Price: Rs. ' || printf('%.2f', p_retailprice / 10) || CASE p_partkey % 3 WHEN 0 THEN ' per g' WHEN 1 THEN '/kg' ELSE ' each' END"


@query("ext15_unit_sale_price", f"""
WITH t AS (SELECT p_partkey, {_USP} AS text FROM part)
SELECT p_partkey, TRY_CAST(regexp_extract({cap('text', V.UNIT_SALE_PRICE)}, '([0-9]+(\\.[0-9]{{1,2}})?)', 1) AS DOUBLE) AS amount,
       lower({cap('text', V.UNIT_SALE_PRICE, 2)}) AS unit FROM t""")
def ext15(spark, d):
    rows = read_table(spark, d, "part").select("p_partkey", F.expr(_USP).alias("text"))
    return rows.withColumn("u", E.unit_sale_price(F.col("text"))).select("p_partkey", "u.amount", "u.unit")


@query("ext16_licence_numbers", f"""
SELECT source, count(*) AS n_docs, count_if(regexp_matches(text, '{V.FSSAI_NUMBER}')) AS with_number,
       count_if(regexp_matches(text, '{V.PINCODE}')) AS with_pin FROM documents GROUP BY source""")
def ext16(spark, d):
    text = F.col("text")
    return read_table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if(N.has_licence_number(text)).alias("with_number"),
        F.count_if(text.rlike("(?Ud)" + V.PINCODE)).alias("with_pin"))


_DOC_LINES = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
"""


@query("ext11_emails_in_documents", _DOC_LINES + f"""
SELECT doc_id AS image_id, doc_id * 2147483648 + pos - 1 AS block_id, {cap('text', V.EMAIL)} AS raw_value FROM lines WHERE contains(text, '@') AND {has('text', V.EMAIL)}""")
def ext11_documents(spark, d):
    spans = L.single_spans(doc_blocks(spark, d))
    cand = E.candidates_from_spans(spans, ("care",)).where("declaration_type = 'CONSUMER_CARE_EMAIL'")
    return cand.select("image_id", F.col("block_ids")[0].alias("block_id"), "raw_value")


@query("ext10_phones_in_documents")
def ext10_documents(spark, d):
    spans = L.single_spans(doc_blocks(spark, d))
    cand = E.candidates_from_spans(spans, ("care",)).where("declaration_type = 'CONSUMER_CARE_PHONE'")
    return cand.select("image_id", F.col("block_ids")[0].alias("block_id"), "raw_value", "normalized.number")


@query("ext0_documents_as_panels")
def ext0_documents(spark, d):
    cand = E.extract_candidates(doc_blocks(spark, d))
    return cand.groupBy("declaration_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


@query("set1_candidate_union", Q.candidates_sql() + "SELECT scan_id, declaration_type, count(*) AS n FROM cand GROUP BY scan_id, declaration_type")
def set1(spark, d):
    return candidates_table(spark, d).groupBy("scan_id", "declaration_type").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------- decisions
_staged: dict[tuple[str, str], str] = {}


def candidates_table(spark, d) -> DataFrame:
    """Candidates as a table in the shared folder, written once per session.

    The decision operators read candidates several times; a written table cuts the lineage, survives
    lost executors and keeps the span pipeline from running once per reader.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _staged:
        path = shared_folder(spark) + "/candidates"
        E.extract_candidates(label_blocks(spark, d)).write.parquet(path)
        _staged[key] = path
    return spark.read.parquet(_staged[key])


def _arbitrated(spark, d, *columns: str) -> DataFrame:
    """Candidates after arbitration, of their columns those that the query reads (all if none are named)."""
    found = candidates_table(spark, d)
    return C.arbitrate(C.narrowed(found, *columns) if columns else found)


_LABEL = ("breakdown.has_explicit_label", "normalized.is_multipack")
#: What the resolver reads of a candidate, beside what it is ranked by.
_DECIDING = (*_LABEL, *[f"breakdown.{c}_confidence" for c in V.AUTO_RESOLVE_MIN], "normalized.value", "normalized.name", "raw_text", "raw_value", "x1", "y1", "x2", "y2")


@query("agg1_arbitrate", ", ".join([Q.candidates_sql(), Q.ARBITRATED]) + f" SELECT {_KEYS} FROM arb")
def agg1(spark, d):
    return _arbitrated(spark, d).withColumn("block_ids", ids_text(F.col("block_ids"))).select(*_KEY)


_M = ", ".join([Q.candidates_sql(), Q.ARBITRATED, Q.MERGED]) + " "
_MC = ("scan_id", "declaration_type", "raw_value", "image_id", "confidence")


@query("agg2_merge_same_value", _M + "SELECT scan_id, declaration_type, raw_value, image_id, confidence, n_merged, n_cross FROM merged")
def agg2(spark, d):
    return C.merge_same_value(_arbitrated(spark, d, "raw_value")).select(*_MC, "n_merged", "n_cross")


@query("set4_merged_evidence", _M + """
SELECT DISTINCT scan_id, declaration_type, sig_no, unnest(string_split(block_ids, ','))::BIGINT AS block_id FROM (
  SELECT a.scan_id, a.declaration_type, a.block_ids, m.raw_value || '@' || m.image_id AS sig_no FROM arb a JOIN merged m USING (scan_id, declaration_type, sig)) q""")
def set4(spark, d):
    cand = _arbitrated(spark, d, "raw_value")
    keys = C.merge_same_value(cand).select("scan_id", "declaration_type", "signature", F.concat_ws("@", "raw_value", "image_id").alias("sig_no"))
    return C.merged_evidence(cand).join(keys, ["scan_id", "declaration_type", "signature"]).select("scan_id", "declaration_type", "sig_no", "block_id").distinct()


@query("agg3_prune_unanchored", _M + ", " + Q.ANCHORED + "SELECT scan_id, declaration_type, raw_value, image_id, confidence FROM pruned")
def agg3(spark, d):
    return C.prune_unanchored(C.merge_same_value(_arbitrated(spark, d, "raw_value", *_LABEL))).select(*_MC)


_RANKED_ALL = f"""
tops AS (SELECT *, row_number() OVER (PARTITION BY scan_id, declaration_type ORDER BY {Q._RANK}) AS pos,
  first(confidence) OVER (PARTITION BY scan_id, declaration_type ORDER BY {Q._RANK}) AS top FROM merged)"""


@query("agg4_drop_weak", _M + ", " + _RANKED_ALL + f"""
SELECT scan_id, declaration_type, raw_value, image_id, confidence FROM tops WHERE NOT (top >= {V.STRONG_MIN} AND confidence < {V.LEVEL_MEDIUM} AND pos > 1)""")
def agg4(spark, d):
    return C.drop_weak(C.merge_same_value(_arbitrated(spark, d, "raw_value"))).select(*_MC)


@query("agg5_detect_conflict", Q.consolidated_sql() + "SELECT scan_id, declaration_type, raw_value, image_id, confidence, has_conflict, n_credible FROM cons")
def agg5(spark, d):
    values = C.drop_weak(C.prune_unanchored(C.merge_same_value(_arbitrated(spark, d, "raw_value", *_LABEL))))
    return C.detect_conflict(values).select(*_MC, "has_conflict", "n_credible")


@query("agg5_consolidate", Q.consolidated_sql() + """
SELECT scan_id, declaration_type, raw_value, image_id, confidence, has_conflict,
  CASE WHEN has_conflict THEN 'MEDIUM' WHEN confidence >= 0.82 AND NOT (how = 'labelled' AND declaration_type = 'NET_QUANTITY' AND n_cross = 0 AND sig LIKE '%None') THEN 'HIGH' WHEN confidence >= 0.58 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level FROM cons""")
def agg5_full(spark, d):
    return C.consolidate(_arbitrated(spark, d, "raw_value", *_LABEL)).select(*_MC, "has_conflict", "confidence_level")


_RESOLVED = Q.consolidated_sql() + f""",
valid AS (SELECT *, row_number() OVER (PARTITION BY scan_id, declaration_type ORDER BY {Q._ORDER}) AS rn FROM {{source}}),
pair AS (SELECT b.scan_id, b.declaration_type, b.raw_value AS raw_value, b.confidence AS c1, s.confidence AS c2, b.raw_value AS v1, s.raw_value AS v2
         FROM valid b LEFT JOIN valid s ON s.scan_id = b.scan_id AND s.declaration_type = b.declaration_type AND s.rn = 2 WHERE b.rn = 1)
"""


@query("agg6_resolve", _RESOLVED.replace("{source}", "(SELECT * FROM cons WHERE NOT has_conflict)") + """
SELECT g.scan_id, g.declaration_type, g.n_candidates, p.raw_value,
  CASE WHEN p.scan_id IS NULL THEN 'NOT_DETECTED' WHEN coalesce(auto, FALSE) THEN 'AUTO_RESOLVED' ELSE 'NEEDS_REVIEW' END AS resolution_status,
  coalesce(p.c1, 0.0) AS confidence
FROM (SELECT scan_id, declaration_type, count(*) AS n_candidates FROM cons GROUP BY ALL) g
LEFT JOIN (SELECT p.*, p.declaration_type NOT IN ('COUNTRY_OF_ORIGIN', 'NET_QUANTITY', 'MRP') OR p.declaration_type = 'COUNTRY_OF_ORIGIN' AND v.known
             OR p.declaration_type = 'MRP' AND v.labelled OR p.declaration_type = 'NET_QUANTITY' AND v.how IN ('multipack', 'labelled') AND v.sig NOT LIKE '%None' AS auto
           FROM pair p JOIN (SELECT *, sig IN (SELECT v FROM aliases) AS known FROM cons WHERE NOT has_conflict) v USING (scan_id, declaration_type)) p
USING (scan_id, declaration_type)""")
def agg6(spark, d):
    return C.resolve(C.consolidate(_arbitrated(spark, d, *_DECIDING))).select(
        "scan_id", "declaration_type", "n_candidates", "raw_value", "resolution_status", "confidence")


@query("win2_best_candidate", Q.candidates_sql() + f"""
SELECT scan_id, declaration_type, raw_value, image_id, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, declaration_type ORDER BY {Q._ORDER}) AS rn FROM cand) q WHERE rn = 1""")
def win2(spark, d):
    cand = candidates_table(spark, d)
    w = W.partitionBy("scan_id", "declaration_type").orderBy(C.candidate_rank())
    return cand.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*_MC)


@query("win3_best_versus_second", Q.candidates_sql() + f"""
SELECT b.scan_id, b.declaration_type, b.confidence AS best, s.confidence AS second, round(b.confidence - s.confidence, 4) AS gap
FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, declaration_type ORDER BY {Q._ORDER}) AS rn FROM cand) b
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY scan_id, declaration_type ORDER BY {Q._ORDER}) AS rn FROM cand) s
  ON s.scan_id = b.scan_id AND s.declaration_type = b.declaration_type AND s.rn = 2 WHERE b.rn = 1""")
def win3(spark, d):
    cand = candidates_table(spark, d)
    w = W.partitionBy("scan_id", "declaration_type").orderBy(C.candidate_rank())
    two = cand.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("scan_id", "declaration_type").agg(
        F.max(F.when(F.col("rn") == 1, F.col("confidence"))).alias("best"), F.max(F.when(F.col("rn") == 2, F.col("confidence"))).alias("second"))
    return two.withColumn("gap", F.round(F.col("best") - F.col("second"), 4))


@query("agg5_conflict_peers", Q.consolidated_sql() + "SELECT scan_id, declaration_type, image_id, confidence FROM cons WHERE has_conflict")
def agg5_peers(spark, d):
    return C.conflict_peers(C.consolidate(_arbitrated(spark, d, "image_type", "raw_text", *_LABEL))).select("scan_id", "declaration_type", "image_id", "confidence")


# ---------------------------------------------------------------- flagship: price rule
_P0 = f"""
price AS (SELECT *, {cap('text', V.MRP_EXPLICIT)} AS raw, {conf('confidence', '1', '1', '1', '1')} AS score FROM blocks WHERE NOT {nutrition('text')}),
best AS (SELECT scan_id, max(score) AS score FROM price WHERE {Q.amount('raw')} > 0 GROUP BY scan_id),
verdict AS (SELECT p.p_partkey AS scan_id, CASE WHEN score IS NULL THEN 'FAIL' WHEN score < 0.8 THEN 'REVIEW' ELSE 'PASS' END AS status
            FROM part p LEFT JOIN best ON best.scan_id = p.p_partkey)"""


@query("flagship_price_rule", f"WITH {label_blocks_sql()}, {_P0} SELECT status, count(*) AS n_scans FROM verdict GROUP BY status")
def flagship(spark, d):
    """Blocks -> labelled prices of single-block spans -> presence rule -> status counts."""
    cand = E.candidates_from_spans(L.single_spans(label_blocks(spark, d)), ("mrp",)).where("breakdown.has_explicit_label")
    best = cand.groupBy("scan_id").agg(F.max("confidence").alias("confidence"))
    scans = read_table(spark, d, "part").select(F.col("p_partkey").alias("scan_id"))
    status = F.when(F.col("confidence").isNull(), "FAIL").when(F.col("confidence") < 0.8, "REVIEW").otherwise("PASS")
    return scans.join(best, "scan_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n_scans"))


@query("flagship_label_to_compliance", _RESOLVED.replace("{source}", "(SELECT * FROM cons WHERE NOT has_conflict)") + """,
rules AS (SELECT * FROM (VALUES ('LMR_2011_R06_MRP', 'MRP', 0.8), ('LMR_2011_R06_NET_QTY', 'NET_QUANTITY', 0.8),
   ('LMR_2011_R06_MANUFACTURER', 'MANUFACTURER', 0.75), ('LMR_2011_R06_CONSUMER_CARE', 'CONSUMER_CARE_PHONE', 0.75)) r(rule_code, target, min_conf)),
settled AS (SELECT p.scan_id, p.declaration_type AS target, p.c1,
   p.declaration_type = 'CONSUMER_CARE_PHONE' OR p.declaration_type = 'MRP' AND v.labelled
     OR p.declaration_type = 'NET_QUANTITY' AND v.how IN ('multipack', 'labelled') AND v.sig NOT LIKE '%None' AS auto
   FROM pair p JOIN (SELECT * FROM cons WHERE NOT has_conflict) v USING (scan_id, declaration_type))
SELECT rule_code, CASE WHEN s.scan_id IS NULL THEN 'FAIL' WHEN NOT auto THEN 'REVIEW' WHEN c1 < min_conf THEN 'REVIEW' ELSE 'PASS' END AS status, count(*) AS n_scans
FROM rules CROSS JOIN (SELECT p_partkey AS scan_id FROM part) p LEFT JOIN settled s USING (scan_id, target) GROUP BY ALL""")
def flagship_full(spark, d):
    """The whole path: blocks, lines, spans, candidates, arbitration, consolidation, resolution, findings.

    The candidates are written on first use, because consolidation and resolution read them more than once.
    """
    resolved = C.resolve(C.consolidate(_arbitrated(spark, d, *_DECIDING))).where("resolution_status <> 'NOT_DETECTED'").withColumn("seq", F.lit(0))
    scans = read_table(spark, d, "part").select(F.col("p_partkey").alias("scan_id"))
    return evaluate_presence(scans, resolved).groupBy("rule_code", "status").agg(F.count("*").alias("n_scans"))
