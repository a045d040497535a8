"""Label corpora derived from the given tables.

The tables hold no label photographs, so every part becomes one scanned package with a FRONT, a BACK
and a SIDE panel whose text blocks are computed from its name, price, size, supplier and ship dates.
The expressions are plain SQL understood by Spark and by the checking engine alike, so both sides
derive the same corpus from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.session import shared_folder
from packlens.sources.tables import BLOCK_SCHEMA, read_ocr_blocks, read_table

# one row per part: supplier and a ship date (the last one for every third part)
PART_FACTS = """
SELECT p.p_partkey, p.p_name, p.p_brand, p.p_type, p.p_size, p.p_retailprice, f.suppkey, s.s_name,
       CASE WHEN p.p_partkey % 3 = 0 THEN f.last_ship ELSE f.first_ship END AS d
FROM {part} p
LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS suppkey, min(l_shipdate) AS first_ship,
                  max(l_shipdate) AS last_ship FROM {lineitem} GROUP BY l_partkey) f
  ON f.l_partkey = p.p_partkey
LEFT JOIN {supplier} s ON s.s_suppkey = f.suppkey
"""

_MM_YYYY = "lpad(CAST(month(d) AS STRING), 2, '0') || '/' || CAST(year(d) AS STRING)"
_MM = "lpad(CAST(p_partkey % 12 + 1 AS STRING), 2, '0')"
_YYYY = "CAST(2020 + p_partkey % 10 AS STRING)"
_PRICE = "'MRP Rs. ' || printf('%.2f', {price}) || ' (Incl. of all taxes)'"

# (panel, order, text, x1, y1, x2, y2); a null text drops the block
BLOCKS = [
    ("FRONT", 0, "'Generic Name: ' || p_name", 10, 20, 300, 40),
    ("FRONT", 1, _PRICE.format(price="p_retailprice"), 10, 60, 320, 80),
    ("FRONT", 2, "'Net'", 10, 100, 40, 120),
    ("FRONT", 3, "'Qty'", 45, 100, 75, 120),
    ("FRONT", 4, "CAST(p_size AS STRING)", 80, 100, 100, 120),
    ("FRONT", 5, "'g'", 105, 100, 115, 120),
    ("BACK", 0, _PRICE.format(price="p_retailprice + CASE WHEN p_partkey % 7 = 0 THEN 10.0 ELSE 0.0 END"), 10, 20, 320, 40),
    ("BACK", 1, "'NET WEIGHT ' || CAST(p_size AS STRING) || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'g' "
                "WHEN 1 THEN 'kg' WHEN 2 THEN 'mg' ELSE 'gm' END", 10, 60, 200, 80),
    ("BACK", 2, "'PKD.'", 10, 100, 50, 120),
    ("BACK", 3, _MM_YYYY, 60, 100, 150, 120),
    ("BACK", 4, "'Marketed By:'", 10, 140, 150, 160),
    ("BACK", 5, "s_name || ' LTD.,'", 10, 180, 250, 200),
    ("BACK", 6, "'PLOT ' || CAST(suppkey AS STRING) || ' ROAD, PUNE 411001'", 10, 220, 250, 240),
    ("BACK", 7, "'Consumer Care: 1800-425-4449'", 10, 300, 300, 320),
    ("BACK", 8, "'Email: care' || CAST(suppkey AS STRING) || '@example.com'", 10, 360, 300, 380),
    ("BACK", 9, "CASE WHEN p_partkey % 5 = 0 THEN 'Batch No. printed on the pack' "
                "ELSE 'Batch No. AB' || CAST(p_partkey AS STRING) END", 10, 420, 250, 440),
    ("BACK", 10, "'Total Sugars 20.5g'", 10, 600, 250, 620),
    ("SIDE", 0, "'Country of Origin: ' || CASE p_partkey % 6 WHEN 0 THEN 'India' WHEN 1 THEN 'VIETNAM' "
                "WHEN 2 THEN 'Made In Taiwan' WHEN 3 THEN 'blue valley' WHEN 4 THEN 'USA' ELSE 'South Korea' END",
     10, 20, 300, 40),
    ("SIDE", 1, f"'Mfg. Date: ' || {_MM} || '/' || {_YYYY}", 10, 60, 200, 80),
    ("SIDE", 2, "'Best Before ' || CAST(p_partkey % 24 + 1 AS STRING) || ' Months From Manufacture'", 10, 100, 300, 120),
    ("SIDE", 3, f"CASE WHEN p_partkey % 4 = 0 THEN 'EXP AUG 26' ELSE 'EXP 15/' || {_MM} || '/' || {_YYYY} END",
     10, 140, 200, 160),
    ("SIDE", 4, "'Imported By: Global Trade ' || CAST(suppkey AS STRING) || ' Ltd., PLOT ' || "
                "CAST(p_partkey % 50 AS STRING) || ' ROAD, MUMBAI 400001'", 10, 220, 400, 240),
    ("SIDE", 5, "'Manufactured By:'", 10, 320, 150, 340),
    ("SIDE", 6, "'Acme Foods ' || CAST(suppkey AS STRING) || ' Private Limited'", 10, 350, 250, 370),
    ("SIDE", 7, "'Sector 5, Gurugram, Haryana - 122001'", 10, 380, 280, 400),
    ("SIDE", 8, "'Packed By: PackCo Enterprises ' || CAST(p_partkey % 9 AS STRING)", 10, 480, 280, 500),
    ("SIDE", 9, "CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey % 12 + 1 AS STRING) || ' N x 50 g = ' || "
                "CAST(50 * (p_partkey % 12 + 1) AS STRING) || ' g' "
                "WHEN 1 THEN CAST(p_partkey % 60 + 1 AS STRING) || ' Tablets' "
                "ELSE CAST(p_size AS STRING) || ' ml' END", 10, 580, 250, 600),
    ("SIDE", 10, "'Rs. ' || CAST(p_partkey % 500 + 1 AS STRING) || '/-'", 10, 680, 100, 700),
    ("SIDE", 11, "'Imp. Date: 0' || CAST(p_partkey % 9 + 1 AS STRING) || '/2024'", 10, 780, 200, 800),
    ("SIDE", 12, "'Lic. No. 10012022000213'", 10, 880, 250, 900),
    ("SIDE", 13, "'For Complaints Contact Us'", 10, 980, 250, 1000),
    ("SIDE", 14, "'Care Desk, Tower ' || CAST(p_partkey % 30 AS STRING) || ', Andheri'", 10, 1010, 250, 1030),
    ("SIDE", 15, "'Lot No.'", 10, 1300, 60, 1320),
    ("SIDE", 16, "CASE WHEN p_partkey % 2 = 0 THEN 'L' || CAST(p_partkey AS STRING) || 'X9' END", 70, 1300, 150, 1320),
]
PANELS = ["FRONT", "BACK", "SIDE"]
_CONFIDENCE = "CAST('0.9' AS DOUBLE) + (p_partkey % 10) / CAST(100 AS DOUBLE)"
_SKIP = "p_partkey % 11 = 0"  # FRONT panel missing

SCANS = """
SELECT p_partkey AS scan_id, 'SCAN-' || CAST(2024 + p_partkey % 3 AS STRING) || '-' || lpad(CAST(p_partkey AS STRING), 6, '0') AS scan_code,
       p_partkey AS product_id, suppkey AS inspector_id,
       CASE p_partkey % 9 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'IMAGES_UPLOADED' WHEN 2 THEN 'PROCESSING'
         WHEN 3 THEN 'OCR_COMPLETED' WHEN 4 THEN 'DECLARATIONS_EXTRACTED' WHEN 5 THEN 'COMPLIANCE_EVALUATED'
         WHEN 6 THEN 'REVIEW_REQUIRED' WHEN 7 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
       d AS created_at
FROM ({facts}) facts
"""
PRODUCTS = """
SELECT p_partkey AS product_id, CASE WHEN p_partkey % 10 = 0 THEN '  ' ELSE p_name END AS name,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand, p_type AS category,
       lpad(CAST(p_partkey AS STRING), 8, '0') AS barcode,
       CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Maker ' || p_brand END AS manufacturer_name
FROM {part}
"""
USERS = """
SELECT s_suppkey AS user_id, CASE s_suppkey % 3 WHEN 0 THEN 'INSPECTOR' WHEN 1 THEN 'ADMIN' ELSE 'REVIEWER' END AS role,
       ' User' || CAST(s_suppkey AS STRING) || '@Example.COM ' AS email
FROM {supplier}
"""
IMAGES = """
SELECT p_partkey AS scan_id, p_partkey * 4 + k.panel AS image_id,
       CASE k.panel WHEN 0 THEN 'FRONT' WHEN 1 THEN 'BACK' ELSE 'SIDE' END AS image_type,
       CAST((k.panel + p_partkey) % 3 AS INT) AS display_order,
       'sha-' || CAST(p_partkey AS STRING) || '-' || CAST(k.panel % (1 + p_partkey % 3) AS STRING) AS sha256,
       CASE p_partkey % 4 WHEN 3 THEN 'image/gif' ELSE 'image/jpeg' END AS mime_type,
       CAST(p_retailprice * 10000 AS BIGINT) AS file_size,
       CAST(250 + 100 * p_size AS INT) AS width, CAST(300 + 50 * p_size AS INT) AS height,
       p_retailprice - CAST(850 AS DOUBLE) + 10 * k.panel AS blur_score,
       (p_partkey % 40) / CAST(200 AS DOUBLE) AS glare_score,
       CASE WHEN p_partkey % 13 = 0 THEN CAST('0.01' AS DOUBLE) ELSE CAST('0.4' AS DOUBLE) END AS foreground_ratio,
       CASE WHEN p_partkey % 13 = 0 THEN CAST('0.99' AS DOUBLE) ELSE CAST('0.6' AS DOUBLE) END AS background_ratio,
       CASE WHEN p_partkey % 17 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS processing_status
FROM (SELECT *, {fan3} AS panel FROM {part}) k
"""
# stored declarations of earlier runs: four types per scan, statuses and values from the part
DECLARATIONS = """
SELECT p_partkey AS scan_id, p_partkey * 10 + k.t AS declaration_id,
       CASE k.t WHEN 0 THEN 'MRP' WHEN 1 THEN 'NET_QUANTITY' WHEN 2 THEN 'CONSUMER_CARE_PHONE' WHEN 3 THEN 'MANUFACTURER'
         ELSE 'BEST_BEFORE' END AS declaration_type,
       CASE k.t WHEN 0 THEN 'MRP Rs. ' || printf('%.2f', p_retailprice) WHEN 1 THEN CAST(p_size AS STRING) || ' g'
         WHEN 2 THEN '1800-425-4449' WHEN 3 THEN 'Maker ' || p_brand ELSE '9 MONTHS' END AS raw_text,
       CASE k.t WHEN 0 THEN printf('%.2f', p_retailprice) WHEN 1 THEN CAST(p_size AS STRING)
         WHEN 2 THEN '1800-4254-449' WHEN 3 THEN p_brand ELSE '9' END AS machine_value,
       CASE k.t WHEN 0 THEN p_retailprice WHEN 1 THEN CAST(p_size AS DOUBLE) END AS amount,
       CAST('0.5' AS DOUBLE) + ((p_partkey * 7 + k.t * 11) % 50) / CAST(100 AS DOUBLE) AS confidence,
       CASE (p_partkey + k.t) % 6 WHEN 0 THEN 'AUTO_RESOLVED' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'CONFLICT'
         WHEN 3 THEN 'NOT_DETECTED' WHEN 4 THEN 'CONFIRMED' ELSE 'REJECTED' END AS resolution_status,
       (p_partkey + k.t) % 8 = 0 AS has_conflict,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey * 4 + k.t % 3 END AS image_id,
       (p_partkey * 4 + k.t % 3) * 100 + k.t AS source_block_id,
       k.t AS seq
FROM (SELECT *, {fan5} AS t FROM {part}) k
WHERE (p_partkey + k.t) % 4 <> 3
"""
UTTERANCES = """
SELECT conv_id, turn, role, CASE WHEN role <> 'user' THEN text ELSE CASE (conv_id + turn) % 8
    WHEN 0 THEN 'Hello there!' WHEN 1 THEN 'What is the MRP printed on the box?'
    WHEN 2 THEN 'Check if the net weight in grams is valid'
    WHEN 3 THEN 'Is the customer care helpline and email present?'
    WHEN 4 THEN 'The back photo is blurry and has too much glare'
    WHEN 5 THEN 'What are the mandatory provisions under Rule 6 of LMR 2011?'
    WHEN 6 THEN 'What is the price of it?' ELSE 'thanks a lot' END END AS text,
    CASE WHEN conv_id % 2 = 1 THEN 'Product ' || CAST(conv_id AS STRING) END AS product_name
FROM {conversations}
"""
#: The messages as they were sent.
MESSAGES = """
SELECT conv_id, turn, role, text, CASE WHEN conv_id % 2 = 1 THEN 'Product ' || CAST(conv_id AS STRING) END AS product_name FROM {conversations}
"""
_TABLES = ["part", "lineitem", "supplier", "conversations", "nation", "events", "documents", "labels", "customer", "orders"]


def run_sql(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    sql = sql.replace("{fan3}", "explode(array(0, 1, 2))").replace("{fan5}", "explode(array(0, 1, 2, 3, 4))")
    names = [t for t in _TABLES if "{%s}" % t in sql]
    return spark.sql(sql, **{t: read_table(spark, folder, t) for t in names})


def part_facts(spark: SparkSession, folder: str) -> DataFrame:
    return run_sql(spark, folder, PART_FACTS)


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A corpus table by name: scans, products, users, images, declarations, utterances, messages."""
    sql = {"scans": SCANS, "products": PRODUCTS, "users": USERS, "images": IMAGES,
           "declarations": DECLARATIONS, "utterances": UTTERANCES, "messages": MESSAGES}[name]
    return run_sql(spark, folder, sql.replace("{facts}", PART_FACTS))


def label_block_rows(facts: DataFrame) -> DataFrame:
    """Blocks of every part: one row per part fans out into its blocks, without a join."""
    entries = []
    for panel, order, text, x1, y1, x2, y2 in BLOCKS:
        keep = f"CASE WHEN {_SKIP} THEN NULL ELSE {text} END" if panel == "FRONT" else text
        entries.append(
            f"named_struct('panel', {PANELS.index(panel)}, 'ord', {order}, 'text', {keep}, "
            f"'x1', {x1}, 'y1', {y1}, 'x2', {x2}, 'y2', {y2})")
    return (
        facts.withColumn("confidence", F.expr(_CONFIDENCE))
        .select("p_partkey", "confidence", F.expr(f"inline(array({', '.join(entries)}))"))
        .where("text is not null")
        .select(
            F.col("p_partkey").cast("bigint").alias("scan_id"),
            (F.col("p_partkey") * 4 + F.col("panel")).cast("bigint").alias("image_id"),
            F.element_at(F.array(*[F.lit(p) for p in PANELS]), F.col("panel") + 1).alias("image_type"),
            F.col("panel").cast("int").alias("image_seq"),
            ((F.col("p_partkey") * 4 + F.col("panel")) * 100 + F.col("ord")).cast("bigint").alias("block_id"),
            F.col("ord").cast("int").alias("block_order"),
            "text", "confidence", "x1", "y1", "x2", "y2",
        )
    )


_staged: dict[tuple[str, str], str] = {}


def label_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The block table of the derived scans, stored once per session in the shared folder.

    Recognised blocks are a stored table in practice; staging them keeps the derivation out of the
    operators' plans and gives the scans real Parquet filters.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _staged:
        path = shared_folder(spark) + "/label_blocks"
        rows = label_block_rows(part_facts(spark, folder))
        # keep the blocks of an image in one file, and one file per core at least
        rows.repartition(max(spark.sparkContext.defaultParallelism, 8), "image_id").write.parquet(path)
        _staged[key] = path
    return read_ocr_blocks(spark, _staged[key])


def doc_blocks(spark: SparkSession, folder: str, lang: str | None = None) -> DataFrame:
    """Documents as very tall panels: one block per non-blank line, 20 px per line."""
    docs = read_table(spark, folder, "documents")
    if lang:
        docs = docs.where(F.col("lang") == lang)
    return (
        docs.select("doc_id", "n_chars", F.posexplode(F.split("text", "\n")).alias("line", "text"))
        .select(
            F.col("doc_id").alias("scan_id"), F.col("doc_id").alias("image_id"), F.lit("OTHER").alias("image_type"),
            F.lit(0).alias("image_seq"),
            (F.col("doc_id") * 2147483648 + F.col("line")).alias("block_id"), F.col("line").alias("block_order"),
            "text", (1.0 - (F.col("n_chars") % 10) / F.lit(100.0)).alias("confidence"),
            F.lit(0).alias("x1"), (F.col("line") * 20).alias("y1"), F.lit(400).alias("x2"),
            (F.col("line") * 20 + 16).alias("y2"),
        )
        .where(F.regexp_replace("text", r"(?U)\s", "") != "")
    )


# ------------------------------------------------------------------ the same corpus as plain SQL
def sql_tables(sql: str) -> str:
    """Replace the ``{table}`` marks by plain names for an engine with registered views."""
    sql = sql.replace("{facts}", PART_FACTS).replace("{fan3}", "unnest([0, 1, 2])").replace("{fan5}", "unnest([0, 1, 2, 3, 4])")
    for t in _TABLES:
        sql = sql.replace("{%s}" % t, t)
    return sql


def label_blocks_sql() -> str:
    selects = []
    for panel, order, text, x1, y1, x2, y2 in BLOCKS:
        k = PANELS.index(panel)
        where = f" AND NOT ({_SKIP})" if panel == "FRONT" else ""
        selects.append(
            f"SELECT p_partkey AS scan_id, p_partkey*4+{k} AS image_id, '{panel}' AS image_type, {k} AS image_seq, "
            f"(p_partkey*4+{k})*100+{order} AS block_id, {order} AS block_order, {text} AS text, "
            f"{_CONFIDENCE} AS confidence, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 "
            f"FROM facts WHERE ({text}) IS NOT NULL{where}")
    return f"facts AS ({sql_tables(PART_FACTS)}), blocks AS ({' UNION ALL '.join(selects)})"
