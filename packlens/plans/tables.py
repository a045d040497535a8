"""Queries over sources, sinks, filters, projections and joins of the scan tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.functions import scores as S
from packlens.operators import quality as QL
from packlens.operators import scans as SC
from packlens.operators.consolidate import output_types
from packlens.operators.layout import number_rows, reading_order
from packlens.operators.evaluate import hypothesis_text
from packlens.plans.registry import query
from packlens.plans.sql_parts import with_tables
from packlens.session import shared_folder
from packlens.sources import tables as T
from packlens.sources.corpus import derived, label_blocks
from packlens.sources.tables import read_table


# --------------------------------------------------------------------------- sources
@query("src1_read_ocr_blocks", with_tables("blocks") + """
SELECT scan_id, image_id, image_type, block_id, block_order, text, confidence, x1, y1, x2, y2 FROM blocks""")
def src1(spark: SparkSession, d: str) -> DataFrame:
    return label_blocks(spark, d).drop("image_seq")


@query("src2_read_scan_images", with_tables("images") + """
SELECT scan_id, image_id, row_number() OVER (PARTITION BY scan_id ORDER BY display_order, image_id) AS pos FROM images""")
def src2(spark, d):
    path = shared_folder(spark) + "/images"
    derived(spark, d, "images").write.parquet(path)
    w = W.partitionBy("scan_id").orderBy("display_order", "image_id")
    return T.read_scan_images(spark, path).select("scan_id", "image_id", F.row_number().over(w).alias("pos"))


_RULE_VALUES = ", ".join(f"('{r['rule_code']}', '{r['target']}', {r['min_confidence']})" for r in V.RULES)


@query("src3_rule_catalog", with_tables("declarations") + f"""
SELECT rule_code, count(d.declaration_id) AS n_declarations, count_if(d.confidence >= min_confidence) AS n_confident
FROM (VALUES {_RULE_VALUES}) r(rule_code, target, min_confidence) LEFT JOIN declarations d ON d.declaration_type = r.target GROUP BY rule_code""")
def src3(spark, d):
    rules = T.rule_catalog(spark)  # four fixed rows
    joined = derived(spark, d, "declarations").join(F.broadcast(rules), F.col("target") == F.col("declaration_type"))
    counts = joined.groupBy("rule_code").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= F.col("min_confidence")).alias("k"))
    return rules.join(counts, "rule_code", "left").select("rule_code", F.coalesce("n", F.lit(0)).alias("n_declarations"), F.coalesce("k", F.lit(0)).alias("n_confident"))


_RULE_TEXT = """
'{"type": "presence", "target": "' || CASE p_partkey % 2 WHEN 0 THEN 'MRP' ELSE 'NET_QUANTITY' END || '", "conditions": [{"field": "normalized_value.currency", "operator": "eq", "value": "INR"}]'
|| CASE p_partkey % 3 WHEN 0 THEN ', "min_confidence": 0.8' ELSE '' END || ', "on_missing": "FAIL"}'
"""


@query("src4_parse_rule_json", f"""
WITH r AS (SELECT p_partkey, {_RULE_TEXT} AS rule FROM part)
SELECT p_partkey, json_extract_string(rule, '$.target') AS target, coalesce(CAST(json_extract_string(rule, '$.min_confidence') AS DOUBLE), 0.7) AS min_confidence,
       CAST(json_array_length(rule, '$.conditions') AS INT) AS n_conditions, json_extract_string(rule, '$.conditions[0].operator') AS operator,
       'REVIEW' AS on_low_confidence FROM r""")
def src4(spark, d):
    rules = read_table(spark, d, "part").select("p_partkey", F.expr(_RULE_TEXT).alias("rule"))
    return rules.withColumn("r", T.parse_rule_json(F.col("rule"))).select(
        "p_partkey", "r.target", "r.min_confidence", F.size("r.conditions").alias("n_conditions"),
        F.col("r.conditions")[0]["operator"].alias("operator"), "r.on_low_confidence")


def labelled_rows(spark, d) -> DataFrame:
    """Labelled packages: price and quantity expected from the part, predictions off for some."""
    def entry(t, key, value):
        return F.struct(F.lit(t).alias("type"), F.create_map(F.lit("v"), value.cast("string")).alias(key))

    p = F.col("p_partkey")
    size = F.col("p_size")
    exp = F.array(entry("MRP", "normalized_expected", size), entry("NET_QUANTITY", "normalized_expected", size + 1))
    wrong = F.when(p % 5 == 0, size + 9).otherwise(size)
    pred = F.array_compact(F.array(
        F.when(p % 3 != 0, entry("MRP", "normalized_value", wrong)),
        F.when(p % 2 == 0, entry("NET_QUANTITY", "normalized_value", size + 1)),
        F.when(p % 7 == 0, entry("BEST_BEFORE", "normalized_value", size))))
    return read_table(spark, d, "part").select(
        p.cast("string").alias("scan_id"), exp.alias("expected_declarations"), pred.alias("predicted_declarations"))


@query("src5_read_labelled", """
SELECT CAST(p_partkey AS VARCHAR) AS scan_id, 2 AS n_expected, CAST(p_partkey % 3 <> 0 AS INT) + CAST(p_partkey % 2 = 0 AS INT) + CAST(p_partkey % 7 = 0 AS INT) AS n_predicted,
       CAST(p_size AS VARCHAR) AS first_expected FROM part""")
def src5(spark, d):
    path = shared_folder(spark) + "/labelled"
    labelled_rows(spark, d).write.json(path)
    return T.read_labelled(spark, path).select(
        "scan_id", F.size("expected_declarations").alias("n_expected"), F.size("predicted_declarations").alias("n_predicted"),
        F.col("expected_declarations")[0]["normalized_expected"]["v"].alias("first_expected"))


@query("src8_list_files")
def src8(spark, d):
    return T.list_images(spark, d, ["parquet"]).select("filename", "length")


# ----------------------------------------------------------------------------- sinks
@query("snk1_replace_by_key", with_tables("blocks") + """
SELECT image_id, block_id, CASE WHEN image_id % 3 = 0 THEN upper(text) ELSE text END AS text FROM blocks""")
def snk1(spark, d):
    target = label_blocks(spark, d).select("image_id", "block_id", "text")
    new = target.where("image_id % 3 = 0").withColumn("text", F.upper("text"))
    return T.replace_by_key(T.replace_by_key(target, new), new)  # a second run changes nothing


def _bridge(decls: DataFrame) -> DataFrame:
    pair = F.array("source_block_id", F.col("image_id") * 100 + 9, F.col("image_id") * 100 + 9)
    return T.evidence_bridge(decls.where("image_id is not null").withColumn("block_ids", pair))


_BRIDGE = """bridge AS (SELECT DISTINCT declaration_id, unnest([source_block_id, image_id * 100 + 9]) AS block_id FROM declarations WHERE image_id IS NOT NULL)"""


@query("snk3_evidence_bridge", with_tables("declarations") + ", " + _BRIDGE + " SELECT declaration_id, block_id FROM bridge")
def snk3(spark, d):
    return _bridge(derived(spark, d, "declarations"))


@query("snk4_append_audit", """
SELECT event_type AS action, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type""")
def snk4(spark, d):
    path = shared_folder(spark) + "/audit"
    log = read_table(spark, d, "events").select(F.col("event_type").alias("action"), "user_id", "ts", "props")
    T.append_rows(log.where("user_id % 2 = 0"), path)
    T.append_rows(log.where("user_id % 2 <> 0"), path)
    return spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("snk5_write_results_json", with_tables("images") + """
SELECT image_id, CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) AS dimensions, CAST((blur_score < 100) AS INT) AS blurry FROM images""")
def snk5(spark, d):
    path = shared_folder(spark) + "/results"
    rows = derived(spark, d, "images").select(
        "image_id", F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")).alias("dimensions"),
        (F.col("blur_score") < 100).cast("int").alias("blurry"))
    T.write_results_json(rows, path)
    return spark.read.schema("image_id bigint, dimensions string, blurry int").json(path)


# --------------------------------------------------------------------------- filters
@query("flt1_visible_scans", with_tables("scans", "users") + """
SELECT u.user_id, u.role, CASE WHEN role = 'INSPECTOR' THEN (SELECT count(*) FROM scans s WHERE s.inspector_id = u.user_id) ELSE (SELECT count(*) FROM scans) END AS n_visible FROM users u""")
def flt1(spark, d):
    return SC.visible_scan_counts(derived(spark, d, "scans"), derived(spark, d, "users"))


@query("flt1_visible_scan_rows", with_tables("scans") + "SELECT scan_id, inspector_id FROM scans WHERE inspector_id = 1")
def flt1_rows(spark, d):
    return SC.visible_scans(derived(spark, d, "scans"), 1, "INSPECTOR").select("scan_id", "inspector_id")


@query("flt2_lookup_scan", with_tables("scans") + "SELECT scan_id, scan_code, status FROM scans WHERE CAST(scan_id AS VARCHAR) = '7' OR scan_code = '7'")
def flt2(spark, d):
    return SC.lookup_scan(derived(spark, d, "scans"), "7").select("scan_id", "scan_code", "status")


@query("flt3_lookup_barcode", with_tables("products") + "SELECT product_id, barcode FROM products WHERE barcode = '00000042'")
def flt3(spark, d):
    return SC.lookup_barcode(derived(spark, d, "products"), " 00000042 ").select("product_id", "barcode")


@query("flt4_code_prefix", with_tables("scans") + "SELECT scan_id, scan_code FROM scans WHERE scan_code LIKE 'SCAN-2025-%'")
def flt4(spark, d):
    return SC.with_prefix(derived(spark, d, "scans"), "SCAN-2025-").select("scan_id", "scan_code")


@query("flt5_in_list", with_tables("images", "declarations") + """
SELECT image_id, blur_score FROM images WHERE image_id IN (SELECT image_id FROM declarations WHERE declaration_type = 'MRP')""")
def flt5(spark, d):
    keys = derived(spark, d, "declarations").where("declaration_type = 'MRP'")
    return SC.in_keys(derived(spark, d, "images"), keys, "image_id").select("image_id", "blur_score")


@query("flt6_declaration_filter", with_tables("declarations") + """
SELECT mode, declaration_id FROM declarations, (VALUES ('ALL'), ('NEEDS_REVIEW'), ('CONFIRMED'), ('AUTO_RESOLVED'), ('REJECTED'), ('CONFLICT')) m(mode)
WHERE mode = 'ALL' OR resolution_status = mode OR (mode = 'CONFLICT' AND has_conflict)""")
def flt6(spark, d):
    decls = derived(spark, d, "declarations")
    modes = [F.when(SC.declaration_mode(mode), F.lit(mode)) for mode in ("ALL", "NEEDS_REVIEW", "CONFIRMED", "AUTO_RESOLVED", "REJECTED", "CONFLICT")]
    return decls.select(F.explode(F.array_compact(F.array(*modes))).alias("mode"), "declaration_id")


@query("flt7_sanitize_metadata", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'note=' || event_type ELSE 'dims=' || event_type || ';user=' || CAST(user_id AS VARCHAR) END AS safe FROM events""")
def flt7(spark, d):
    e = F.col("event_id") % 3
    meta = (
        F.when(e == 0, F.create_map(F.lit("API_Key"), F.col("event_type")))
        .when(e == 1, F.create_map(F.lit("note"), F.col("event_type"), F.lit("accessToken"), F.col("props")))
        .otherwise(F.create_map(F.lit("dims"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("myPassword"), F.lit("x"))))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(SC.sanitize_metadata(meta))), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    return read_table(spark, d, "events").select("event_id", text.alias("safe"))


# ----------------------------------------------------------------------- projections
@query("prj1_declaration_view", with_tables("declarations") + ", " + _BRIDGE + """
SELECT declaration_id, scan_id, declaration_type, (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (
    SELECT block_id AS x FROM bridge b WHERE b.declaration_id = d.declaration_id UNION SELECT d.source_block_id) u WHERE x IS NOT NULL) AS source_blocks,
  '/api/v1/scans/' || CAST(scan_id AS VARCHAR) || '/images/' || CAST(image_id AS VARCHAR) || '/content' AS evidence_url FROM declarations d""")
def prj1(spark, d):
    decls = derived(spark, d, "declarations")
    view = SC.declaration_view(decls, _bridge(decls))
    ids = F.array_join(F.transform(F.array_sort("source_blocks"), lambda x: x.cast("string")), ",")
    return view.withColumn("source_blocks", F.nullif(ids, F.lit("")))


@query("prj2_image_view", with_tables("images") + """
SELECT image_id, scan_id, image_type, display_order, '/api/v1/scans/' || CAST(scan_id AS VARCHAR) || '/images/' || CAST(image_id AS VARCHAR) || '/file' AS preview_url FROM images""")
def prj2(spark, d):
    return SC.image_view(derived(spark, d, "images"))


_INCOMING = """
SELECT CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE lpad(CAST(p_partkey * 2 AS STRING), 8, '0') END AS barcode,
       CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN '' ELSE ' New ' || p_name END AS name,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS brand, CAST(NULL AS STRING) AS category,
       CASE WHEN p_partkey % 14 = 0 THEN 'Inc ' || p_brand ELSE '' END AS manufacturer_name FROM {part}"""


@query("prj3_fill_missing_product", with_tables("products") + f", incoming AS ({_INCOMING.replace('{part}', 'part')})" + """
SELECT e.product_id, nullif(trim(i.barcode), '') AS barcode,
  coalesce(nullif(trim(e.name), ''), nullif(trim(i.name), ''), 'Untitled Packaging Capture') AS name,
  coalesce(nullif(trim(e.brand), ''), nullif(trim(i.brand), '')) AS brand, coalesce(nullif(trim(e.category), ''), nullif(trim(i.category), '')) AS category,
  coalesce(nullif(trim(e.manufacturer_name), ''), nullif(trim(i.manufacturer_name), '')) AS manufacturer_name
FROM incoming i LEFT JOIN products e ON trim(i.barcode) = e.barcode
WHERE coalesce(nullif(trim(i.name), ''), nullif(trim(i.brand), ''), nullif(trim(i.category), ''), nullif(trim(i.manufacturer_name), ''), nullif(trim(i.barcode), '')) IS NOT NULL""")
def prj3(spark, d):
    incoming = spark.sql(_INCOMING, part=read_table(spark, d, "part"))
    return SC.merge_products(derived(spark, d, "products"), incoming)


@query("prj4_email_key", with_tables("users") + "SELECT user_id, lower(trim(email)) AS email FROM users")
def prj4(spark, d):
    return derived(spark, d, "users").select("user_id", SC.email_key(F.col("email")).alias("email"))


# ----------------------------------------------------------------------------- joins
@query("jn1_images_with_blocks", with_tables("images", "blocks") + """
SELECT i.image_id, i.display_order, b.block_id, b.text FROM images i LEFT JOIN blocks b USING (image_id)""")
def jn1(spark, d):
    return SC.images_with_blocks(derived(spark, d, "images"), label_blocks(spark, d)).select("image_id", "display_order", "block_id", "text")


@query("jn2_declaration_evidence", with_tables("declarations", "blocks") + ", " + _BRIDGE + """
SELECT d.declaration_id, d.declaration_type, b.block_id, k.text, k.confidence FROM declarations d LEFT JOIN bridge b USING (declaration_id) LEFT JOIN blocks k USING (block_id)""")
def jn2(spark, d):
    decls = derived(spark, d, "declarations")
    return SC.decl_evidence(decls, _bridge(decls), label_blocks(spark, d))


@query("jn3_scan_dossier", with_tables("scans", "products", "users", "images") + """
SELECT s.scan_id, s.scan_code, s.status, p.name, p.brand, u.role AS inspector_role, p3.image_ids, coalesce(p3.n, 0) AS n_images
FROM scans s LEFT JOIN products p ON p.product_id = s.product_id LEFT JOIN users u ON u.user_id = s.inspector_id
LEFT JOIN (SELECT scan_id, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY display_order, image_id) AS image_ids, count(*) AS n FROM images GROUP BY scan_id) p3 ON p3.scan_id = s.scan_id""")
def jn3(spark, d):
    return SC.scan_dossier(*[derived(spark, d, n) for n in ("scans", "products", "users", "images")])


@query("jn4_image_dossier", with_tables("images", "blocks") + """
SELECT i.image_id, i.scan_id, i.image_type, CASE WHEN width < 300 OR height < 300 OR blur_score < 40 OR glare_score > 0.175 THEN 'RECAPTURE_RECOMMENDED'
   WHEN width < 400 OR height < 400 OR blur_score < 100 OR glare_score > 0.05 OR (foreground_ratio < 0.02 AND background_ratio > 0.95) THEN 'REVIEW' ELSE 'ACCEPTED' END AS quality_status,
   coalesce(b.n, 0) AS n_blocks, b.avg_confidence, b.first_text
FROM images i LEFT JOIN (SELECT image_id, count(*) AS n, round(avg(confidence), 4) AS avg_confidence, arg_min(text, block_order) AS first_text FROM blocks GROUP BY image_id) b USING (image_id)""")
def jn4(spark, d):
    images = derived(spark, d, "images")
    return SC.image_dossier(images, QL.classify(images), label_blocks(spark, d))


_DICT_TEXT = "CASE p_partkey % 5 WHEN 0 THEN 'GM' WHEN 1 THEN 'Kilograms' WHEN 2 THEN 'litre' WHEN 3 THEN 'tabs' ELSE 'furlong' END"


@query("jn10_dictionary_lookup", f"""
WITH u AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in V.UNIT_ALIASES.items())}) t(k, v)),
m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in V.MONTHS.items())}) t(k, v))
SELECT p_partkey, coalesce(u.v, lower({_DICT_TEXT})) AS unit, m.v AS month
FROM part LEFT JOIN u ON u.k = lower({_DICT_TEXT}) LEFT JOIN m ON m.k = upper(left(p_type, 3))""")
def jn10(spark, d):
    from packlens.functions.normalize import unit_of
    from packlens.functions.text import lookup

    return read_table(spark, d, "part").select(
        "p_partkey", unit_of(F.expr(_DICT_TEXT)).alias("unit"), lookup(V.MONTHS, F.upper(F.left("p_type", F.lit(3)))).alias("month"))


@query("jn11_country_substring", """
WITH a AS (SELECT k, v, row_number() OVER () AS pos FROM (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in V.COUNTRY_ALIASES.items()) + """) t(k, v)),
t AS (SELECT c_custkey, upper(n_name) || ' ' || c_mktsegment AS place FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, (SELECT arg_min(v, pos) FROM a WHERE contains(regexp_replace(place, '[^A-Z ]', '', 'g'), k)) AS country FROM t""")
def jn11(spark, d):
    from packlens.functions.normalize import norm_country

    nation = read_table(spark, d, "nation")
    places = read_table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey", F.concat_ws(" ", F.upper("n_name"), "c_mktsegment").alias("place"))
    c = norm_country(F.col("place"))
    return places.withColumn("c", c).select("c_custkey", F.when(F.col("c.is_recognized"), F.col("c.country")).alias("country"))


@query("jn12_duplicate_images", with_tables("images") + """
SELECT scan_id, image_id, sha256, row_number() OVER (PARTITION BY scan_id, sha256 ORDER BY display_order, image_id) > 1 AS is_duplicate FROM images""")
def jn12(spark, d):
    return QL.first_of_duplicates(derived(spark, d, "images")).select("scan_id", "image_id", "sha256", "is_duplicate")


@query("jn14_assistant_context", with_tables("scans", "products", "images", "declarations") + """
SELECT s.scan_id, coalesce(p.name, s.scan_code) AS active_product, s.status, coalesce(q.n, 0) AS n_quality, coalesce(d.n, 0) AS n_declarations
FROM scans s LEFT JOIN products p ON p.product_id = s.product_id LEFT JOIN (SELECT scan_id, count(*) AS n FROM images GROUP BY 1) q ON q.scan_id = s.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM declarations GROUP BY 1) d ON d.scan_id = s.scan_id""")
def jn14(spark, d):
    return SC.assistant_context(*[derived(spark, d, n) for n in ("scans", "products", "images", "declarations")])


# --------------------------------------------------------------------- sorts, sets, windows
@query("srt1_scans_newest_first", with_tables("scans") + "SELECT scan_id, row_number() OVER (PARTITION BY inspector_id ORDER BY created_at DESC, scan_id) AS pos FROM scans")
def srt1(spark, d):
    scans = derived(spark, d, "scans").withColumn("slice", -F.floor(F.unix_timestamp("created_at") / 86400))
    return number_rows(scans, ["inspector_id"], "slice", [F.desc("created_at"), F.col("scan_id")], "pos", 1).select("scan_id", "pos")


@query("srt2_declarations_oldest_first", with_tables("declarations") + "SELECT declaration_id, row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS pos FROM declarations")
def srt2(spark, d):
    return derived(spark, d, "declarations").select("declaration_id", F.row_number().over(W.partitionBy("scan_id").orderBy("seq")).alias("pos"))


@query("topk1_capped_rows", with_tables("declarations") + """
SELECT scan_id, declaration_id, rank FROM (SELECT scan_id, declaration_id, row_number() OVER (PARTITION BY scan_id ORDER BY confidence DESC, seq) AS rank FROM declarations) q WHERE rank <= 3""")
def topk1(spark, d):
    return SC.top_k(derived(spark, d, "declarations"), ["scan_id"], 3, F.desc("confidence"), F.col("seq")).select("scan_id", "declaration_id", "rank")


_SUBMITTED = "SELECT scan_id, CASE WHEN scan_id % 5 = 0 AND image_id % 4 = 1 THEN image_id - 1 ELSE image_id END AS image_id FROM images WHERE NOT (scan_id % 7 = 0 AND image_id % 4 = 2)"


@query("set3_reorder_check", with_tables("images") + f""", sub AS ({_SUBMITTED}),
a AS (SELECT scan_id, count(*) AS n, count(DISTINCT image_id) AS u FROM sub GROUP BY 1), b AS (SELECT scan_id, count(*) AS n FROM images GROUP BY 1),
c AS (SELECT i.scan_id, count(*) AS k FROM images i WHERE EXISTS (SELECT 1 FROM sub s WHERE s.scan_id = i.scan_id AND s.image_id = i.image_id) GROUP BY 1)
SELECT b.scan_id, coalesce(a.n = b.n AND a.u = b.n AND c.k = b.n, FALSE) AS is_valid FROM b LEFT JOIN a USING (scan_id) LEFT JOIN c USING (scan_id)""")
def set3(spark, d):
    images = derived(spark, d, "images")
    wrong = F.when((F.col("scan_id") % 5 == 0) & (F.col("image_id") % 4 == 1), F.col("image_id") - 1).otherwise(F.col("image_id"))
    submitted = images.where("NOT (scan_id % 7 = 0 AND image_id % 4 = 2)").select("scan_id", wrong.alias("image_id"))
    return SC.reorder_check(submitted, images)


@query("set5_output_types", with_tables("scans") + "SELECT scan_id, t AS declaration_type FROM scans, (SELECT unnest(["
       + ", ".join(f"'{t}'" for t in V.DECLARATION_TYPES if t not in V.PLACEHOLDER_TYPES) + "]) AS t) x")
def set5(spark, d):
    return output_types(derived(spark, d, "scans"))


@query("win5_renumber", with_tables("images") + """
SELECT scan_id, image_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY image_id DESC) - 1 AS INT) AS display_order FROM images""")
def win5(spark, d):
    order = derived(spark, d, "images").groupBy("scan_id").agg(F.reverse(F.array_sort(F.collect_list("image_id"))).alias("image_ids"))
    return SC.renumber(order)


# -------------------------------------------------------------------------- roll-ups
@query("agg11_scan_rollup", with_tables("images", "blocks") + """
SELECT i.scan_id, count(*) AS n_images, coalesce(any_value(b.n), 0) AS n_blocks, count(*) > 8 AS over_limit, coalesce(any_value(b.n), 0) = 0 AS no_text,
  CASE WHEN bool_and(processing_status = 'FAILED') THEN 'FAILED' ELSE 'OCR_COMPLETED' END AS scan_status
FROM images i LEFT JOIN (SELECT scan_id, count(*) AS n FROM blocks GROUP BY 1) b USING (scan_id) GROUP BY i.scan_id""")
def agg11(spark, d):
    return SC.scan_rollup(derived(spark, d, "images"), label_blocks(spark, d))


@query("agg12_next_numbers", with_tables("scans") + """
SELECT year, next_number, printf('SCAN-%d-%06d', year, next_number) AS next_code FROM (
  SELECT CAST(string_split(scan_code, '-')[2] AS INT) AS year, max(CAST(string_split(scan_code, '-')[3] AS INT)) + 1 AS next_number FROM scans GROUP BY 1) q""")
def agg12(spark, d):
    return SC.next_numbers(derived(spark, d, "scans"))


@query("agg12_assign_codes", with_tables("scans") + """
, incoming AS (SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INT) + 32 AS year FROM orders),
taken AS (SELECT CAST(string_split(scan_code, '-')[2] AS INT) AS year, max(CAST(string_split(scan_code, '-')[3] AS BIGINT)) AS last FROM scans GROUP BY 1),
numbered AS (SELECT o_orderkey, year, row_number() OVER (PARTITION BY year ORDER BY o_orderdate, o_orderkey) + coalesce(last, 0) AS number FROM incoming LEFT JOIN taken USING (year))
SELECT o_orderkey, number, printf('SCAN-%d-%06d', year, CAST(number AS BIGINT)) AS scan_code FROM numbered""")
def agg12_codes(spark, d):
    """Every order as a new scan; its years overlap those of the given scans."""
    incoming = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.year("o_orderdate") + 32).alias("year"))
    return SC.assign_codes(incoming, derived(spark, d, "scans"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "number", "scan_code")


@query("agg12_next_display_order", with_tables("images") + "SELECT scan_id, max(display_order) + 1 AS next_order FROM images GROUP BY scan_id")
def agg12_order(spark, d):
    return SC.next_display_order(derived(spark, d, "images"))


@query("sc16_scan_code", "SELECT o_orderkey, printf('SCAN-%d-%06d', CAST(year(o_orderdate) AS INT), CAST(o_orderkey AS INT)) AS code FROM orders")
def sc16(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", SC.scan_code(F.year("o_orderdate"), F.col("o_orderkey")).alias("code"))


@query("sc17_content_hash", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def sc17(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


@query("sc19_megapixels", with_tables("images") + "SELECT image_id, round(CAST(width AS DOUBLE) * height / 1000000.0, 3) AS mp FROM images")
def sc19(spark, d):
    return derived(spark, d, "images").select("image_id", S.megapixels(F.col("width"), F.col("height")).alias("mp"))


@query("sc20_confidence_tier", with_tables("declarations") + """
SELECT declaration_id, CASE WHEN confidence >= 0.8 THEN 'green' WHEN confidence >= 0.6 THEN 'amber' ELSE 'red' END AS tier FROM declarations""")
def sc20(spark, d):
    return derived(spark, d, "declarations").select("declaration_id", S.confidence_tier(F.col("confidence")).alias("tier"))


# --------------------------------------------------------------------------- quality
_WARN = """[x for x in [CASE WHEN width < 400 OR height < 400 THEN 'LOW_RESOLUTION' END, CASE WHEN blur_score < 100 THEN 'BLUR' END, CASE WHEN glare_score > 0.05 THEN 'GLARE' END] if x IS NOT NULL]"""


@query("qlt1_warnings", with_tables("images") + f"SELECT image_id, array_to_string({_WARN}, ',') AS warnings FROM images")
def qlt1(spark, d):
    return derived(spark, d, "images").select("image_id", F.array_join(QL.quality_warnings(), ",").alias("warnings"))


_STATUS = f"""CASE WHEN blur_score < 40 OR glare_score > 0.175 OR width < 300 OR height < 300 THEN 'RECAPTURE_RECOMMENDED' WHEN len({_WARN}) > 0 THEN 'REVIEW'
 WHEN foreground_ratio < 0.02 AND background_ratio > 0.95 THEN 'REVIEW' ELSE 'ACCEPTED' END"""


@query("jn4_image_dossier_rows", with_tables("images", "blocks") + f"""
SELECT i.image_id, i.scan_id, i.image_type, i.processing_status, {_STATUS} AS quality_status, i.blur_score, i.glare_score, array_to_string({_WARN}, ',') AS warnings,
  b.block_id, b.block_order, b.text, b.confidence, b.x1, b.y1, b.x2, b.y2
FROM images i LEFT JOIN blocks b ON b.image_id = i.image_id""")
def jn4_rows(spark, d):
    images = derived(spark, d, "images")
    return SC.image_dossier_rows(images, QL.classify(images), label_blocks(spark, d))


@query("jn14_assistant_context_rows", with_tables("scans", "products", "images", "declarations") + f""",
items AS (
  SELECT scan_id, 'quality' AS section, image_id AS item_id, {_STATUS} AS label, NULL AS raw_text, NULL AS confidence, NULL AS review_status, blur_score, glare_score, array_to_string({_WARN}, ',') AS warnings FROM images
  UNION ALL SELECT scan_id, 'declaration', declaration_id, declaration_type, raw_text, confidence, resolution_status, NULL, NULL, NULL FROM declarations)
SELECT s.scan_id, s.scan_code, coalesce(p.name, s.scan_code) AS active_product, s.status, p.brand, p.barcode,
  i.section, i.item_id, i.label, i.raw_text, i.confidence, i.review_status, i.blur_score, i.glare_score, i.warnings
FROM scans s LEFT JOIN products p ON p.product_id = s.product_id LEFT JOIN items i ON i.scan_id = s.scan_id""")
def jn14_rows(spark, d):
    images = derived(spark, d, "images")
    return SC.assistant_context_rows(derived(spark, d, "scans"), derived(spark, d, "products"), QL.classify(images), derived(spark, d, "declarations"))


@query("qlt2_status", with_tables("images") + f"SELECT image_id, {_STATUS} AS quality_status FROM images")
def qlt2(spark, d):
    return derived(spark, d, "images").select("image_id", QL.quality_status().alias("quality_status"))


@query("qlt3_processing_status", with_tables("images") + f"""
SELECT image_id, CASE WHEN {_STATUS} = 'RECAPTURE_RECOMMENDED' THEN 'RECAPTURE_RECOMMENDED' ELSE 'COMPLETED' END AS image_status FROM images""")
def qlt3(spark, d):
    return QL.classify(derived(spark, d, "images")).select("image_id", "image_status")


@query("qlt4_intake_flags", with_tables("images") + """
SELECT scan_id, image_id, file_size > 10485760 AS too_large, mime_type NOT IN ('image/jpeg', 'image/png', 'image/webp') AS bad_type,
  count(*) OVER (PARTITION BY scan_id) > 8 AS too_many FROM images""")
def qlt4(spark, d):
    return QL.intake_flags(derived(spark, d, "images"))


@query("qlt5_resize_plan", with_tables("images") + """, s AS (SELECT image_id, greatest(width, height) AS edge, width, height FROM images),
q AS (SELECT *, CASE WHEN edge > 3500 THEN CAST(floor(width * (CAST(3500 AS DOUBLE) / edge)) AS INT) ELSE width END AS stored_width,
  CASE WHEN edge > 3500 THEN CAST(floor(height * (CAST(3500 AS DOUBLE) / edge)) AS INT) ELSE height END AS stored_height FROM s)
SELECT image_id, stored_width, stored_height, CASE WHEN greatest(stored_width, stored_height) < 1800 THEN round(least(CAST('2.5' AS DOUBLE), CAST(1800 AS DOUBLE) / greatest(stored_width, stored_height)), 6) ELSE CAST(1 AS DOUBLE) END AS ocr_scale FROM q""")
def qlt5(spark, d):
    return QL.resize_plan(derived(spark, d, "images")).select(
        "image_id", "stored_width", "stored_height", F.round("ocr_scale", 6).alias("ocr_scale"))


@query("agg15_hypothesis_text", with_tables("blocks") + """
SELECT image_id, string_agg(text, ' ' ORDER BY y1, x1) AS hypothesis, count(*) AS n_blocks FROM blocks GROUP BY image_id""")
def agg15(spark, d):
    return hypothesis_text(reading_order(label_blocks(spark, d)))
