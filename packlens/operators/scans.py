"""Scan, image and product tables: filters, projections, joins and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.functions.normalize import fill_missing
from packlens.functions.text import blank_to_null
from packlens.session import shared_folder


# --------------------------------------------------------------------------- filters
def visible_scans(scans: DataFrame, user_id, role: str) -> DataFrame:
    """FLT1: inspectors see their own scans, other roles see all."""
    return scans.where((F.lit(role) != "INSPECTOR") | (F.col("inspector_id") == F.lit(user_id)))


def visible_scan_counts(scans: DataFrame, users: DataFrame) -> DataFrame:
    """FLT1 for all users at once: scans each user may see.

    Counted instead of paired: a user x scan product would be quadratic, while the two counts are not.
    """
    own = scans.groupBy(F.col("inspector_id").alias("user_id")).agg(F.count("*").alias("own"))
    total = scans.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return (
        users.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")  # one row
        .join(own, "user_id", "left")
        .select("user_id", "role", F.when(F.col("role") == "INSPECTOR", F.coalesce("own", F.lit(0))).otherwise(F.col("total")).alias("n_visible"))
    )


def lookup_scan(scans: DataFrame, key: str) -> DataFrame:
    """FLT2: by id or by scan code."""
    return scans.where((F.col("scan_id").cast("string") == key) | (F.col("scan_code") == key))


def lookup_barcode(products: DataFrame, code: str) -> DataFrame:
    """FLT3: exact text match after trimming; leading zeros count."""
    if not code.strip():
        raise ValueError("barcode must not be empty")
    return products.where(F.col("barcode") == code.strip())


def with_prefix(scans: DataFrame, prefix: str) -> DataFrame:
    """FLT4."""
    return scans.where(F.col("scan_code").startswith(prefix))


def in_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """FLT5: rows whose key occurs in another table."""
    return rows.join(keys.select(key), key, "left_semi")


def declaration_mode(mode: str) -> Column:
    """FLT6: condition of a list filter mode."""
    if mode in ("NEEDS_REVIEW", "CONFIRMED", "AUTO_RESOLVED", "REJECTED"):
        return F.col("resolution_status") == mode
    if mode == "CONFLICT":
        return (F.col("resolution_status") == "CONFLICT") | F.col("has_conflict")
    return F.lit(True)


def filter_declarations(decls: DataFrame, mode: str) -> DataFrame:
    """FLT6: list filter modes."""
    return decls.where(declaration_mode(mode))


def sanitize_metadata(metadata: Column) -> Column:
    """FLT7: drop sensitive keys; an empty map becomes null."""
    safe = F.map_filter(metadata, lambda k, v: ~F.lower(k).rlike("|".join(V.SENSITIVE_KEYS)))
    return F.when(F.size(safe) > 0, safe)


# ----------------------------------------------------------------------- projections
def declaration_view(decls: DataFrame, bridge: DataFrame) -> DataFrame:
    """PRJ1, JN2: declarations with their distinct source blocks and the evidence link."""
    ids = bridge.groupBy("declaration_id").agg(F.array_sort(F.collect_set("block_id")).alias("ids"))
    first = F.when(F.col("source_block_id").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("source_block_id"))
    return decls.join(ids, "declaration_id", "left").select(
        "declaration_id", "scan_id", "declaration_type",
        F.array_union(F.coalesce("ids", F.array().cast("array<bigint>")), first).alias("source_blocks"),
        F.when(F.col("image_id").isNotNull(), F.concat(
            F.lit("/api/v1/scans/"), F.col("scan_id").cast("string"), F.lit("/images/"), F.col("image_id").cast("string"), F.lit("/content")
        )).alias("evidence_url"))


def image_view(images: DataFrame) -> DataFrame:
    """PRJ2."""
    return images.select(
        "image_id", "scan_id", "image_type", "display_order",
        F.concat(F.lit("/api/v1/scans/"), F.col("scan_id").cast("string"), F.lit("/images/"),
                 F.col("image_id").cast("string"), F.lit("/file")).alias("preview_url"))


def merge_products(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """PRJ3: incoming product data completes stored products by barcode; all-blank rows vanish."""
    fields = ["name", "brand", "category", "manufacturer_name"]
    filled = F.coalesce(*[blank_to_null(F.col(f"i.{f}")) for f in [*fields, "barcode"]]).isNotNull()
    joined = incoming.alias("i").join(existing.alias("e"), F.trim(F.col("i.barcode")) == F.col("e.barcode"), "left").where(filled)
    cols = {f: fill_missing(F.col(f"e.{f}"), F.col(f"i.{f}")) for f in fields}
    cols["name"] = F.coalesce(cols["name"], F.lit("Untitled Packaging Capture"))
    return joined.select(
        F.col("e.product_id").alias("product_id"), blank_to_null(F.col("i.barcode")).alias("barcode"),
        *[c.alias(f) for f, c in cols.items()])


def email_key(email: Column) -> Column:
    """PRJ4."""
    return F.lower(F.trim(email))


# ----------------------------------------------------------------------------- joins
def images_with_blocks(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN1: images keep a row when they have no block."""
    return images.join(blocks.drop("scan_id", "image_type"), "image_id", "left")


def scan_dossier(scans: DataFrame, products: DataFrame, users: DataFrame, images: DataFrame) -> DataFrame:
    """JN3: scan, product, inspector and the image ids in display order (at most eight per scan by intake)."""
    pics = images.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("display_order", "image_id"))).alias("p"))
    return (
        scans.join(products.select("product_id", "name", "brand"), "product_id", "left")
        .join(users.select(F.col("user_id").alias("inspector_id"), F.col("role").alias("inspector_role")), "inspector_id", "left")
        .join(pics, "scan_id", "left")
        .select("scan_id", "scan_code", "status", "name", "brand", "inspector_role",
                F.array_join(F.transform("p", lambda x: x["image_id"].cast("string")), ",").alias("image_ids"),
                F.coalesce(F.size("p"), F.lit(0)).alias("n_images"))
    )


def image_dossier(images: DataFrame, metrics: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN4: image, its quality row and block totals (the blocks themselves stay rows, see JN1)."""
    totals = blocks.groupBy("image_id").agg(
        F.count("*").alias("n_blocks"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.min(F.struct("block_order", "block_id", "text"))["text"].alias("first_text"))
    return (
        images.select("image_id", "scan_id", "image_type")
        .join(metrics.select("image_id", "quality_status"), "image_id", "left").join(totals, "image_id", "left")
        .withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    )


def image_dossier_rows(images: DataFrame, metrics: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN4 in full: image, quality and its blocks, one row a block in ``block_order``; an image without blocks keeps one row.

    ``metrics``: as :func:`packlens.operators.quality.classify` gives them.
    """
    quality = metrics.select("image_id", "quality_status", "blur_score", "glare_score", F.array_join("warnings", ",").alias("warnings"))
    of_block = blocks.select("image_id", "block_id", "block_order", "text", "confidence", "x1", "y1", "x2", "y2")
    return (
        images.select("image_id", "scan_id", "image_type", "processing_status")
        .join(quality, "image_id", "left").join(of_block, "image_id", "left")
    )


def decl_evidence(decls: DataFrame, bridge: DataFrame, blocks: DataFrame) -> DataFrame:
    """JN2: declaration, bridge, block."""
    return decls.select("declaration_id", "declaration_type").join(bridge, "declaration_id", "left").join(
        blocks.select("block_id", "text", "confidence"), "block_id", "left")


def assistant_context(scans: DataFrame, products: DataFrame, metrics: DataFrame, decls: DataFrame) -> DataFrame:
    """JN14: per scan the product name and the sizes of its quality and declaration context."""
    q = metrics.groupBy("scan_id").agg(F.count("*").alias("n_quality"))
    d = decls.groupBy("scan_id").agg(F.count("*").alias("n_declarations"))
    return (
        scans.join(products.select("product_id", "name"), "product_id", "left")
        .join(q, "scan_id", "left").join(d, "scan_id", "left")
        .select("scan_id", F.coalesce("name", "scan_code").alias("active_product"), "status",
                F.coalesce("n_quality", F.lit(0)).alias("n_quality"), F.coalesce("n_declarations", F.lit(0)).alias("n_declarations"))
    )


def assistant_context_rows(scans: DataFrame, products: DataFrame, metrics: DataFrame, decls: DataFrame) -> DataFrame:
    """JN14 in full: per scan one row for each quality metric and each declaration, with the scan's header; one bare row if it has neither.

    Both kinds of item are put into one shape and meet the scans in a single join, so no list per scan is built.
    """
    text = lambda c: c.cast("string")
    shape = ["scan_id", "section", "item_id", "label", "raw_text", "confidence", "review_status", "blur_score", "glare_score", "warnings"]
    nothing = lambda kind: F.lit(None).cast(kind)
    quality = metrics.select(
        "scan_id", F.lit("quality"), "image_id", "quality_status", nothing("string"), nothing("double"), nothing("string"),
        "blur_score", "glare_score", F.array_join("warnings", ",")).toDF(*shape)
    found = decls.select(
        "scan_id", F.lit("declaration"), "declaration_id", "declaration_type", text(F.col("raw_text")), "confidence", "resolution_status",
        nothing("double"), nothing("double"), nothing("string")).toDF(*shape)
    header = scans.join(products.select("product_id", "name", "brand", "barcode"), "product_id", "left").select(
        "scan_id", "scan_code", F.coalesce("name", "scan_code").alias("active_product"), "status", "brand", "barcode")
    return header.join(quality.unionByName(found), "scan_id", "left")


def reorder_check(submitted: DataFrame, stored: DataFrame) -> DataFrame:
    """SET3: does a submitted order name exactly the stored images? Both: scan_id, image_id.

    Compared as counts of a full outer join, so no id list is built.
    """
    a = submitted.groupBy("scan_id", "image_id").agg(F.count("*").alias("times"))
    both = a.join(stored.select("scan_id", "image_id", F.lit(1).alias("known")), ["scan_id", "image_id"], "full_outer")
    return both.groupBy("scan_id").agg(
        F.bool_and(F.coalesce(F.col("times") == 1, F.lit(False)) & F.col("known").isNotNull()).alias("is_valid"))


def renumber(order: DataFrame) -> DataFrame:
    """WIN5: display order = position in the submitted list (scan_id, image_ids array)."""
    return order.select("scan_id", F.posexplode("image_ids").alias("display_order", "image_id"))


# -------------------------------------------------------------------------- roll-ups
def scan_rollup(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """AGG11: block and image totals and the scan status they imply."""
    per_scan = images.groupBy("scan_id").agg(
        F.count("*").alias("n_images"), F.bool_and(F.col("processing_status") == "FAILED").alias("all_failed"))
    n_blocks = blocks.groupBy("scan_id").agg(F.count("*").alias("n_blocks"))
    return per_scan.join(n_blocks, "scan_id", "left").select(
        "scan_id", "n_images", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        (F.col("n_images") > V.INTAKE["max_images"]).alias("over_limit"),
        F.coalesce(F.col("n_blocks") == 0, F.lit(True)).alias("no_text"),
        F.when(F.col("all_failed"), "FAILED").otherwise("OCR_COMPLETED").alias("scan_status"))


def scan_code(year: Column, number: Column) -> Column:
    """SC16."""
    return F.format_string("SCAN-%d-%06d", year, number)


def next_numbers(scans: DataFrame) -> DataFrame:
    """AGG12: next free sequence number and code per year."""
    suffix = F.substring_index("scan_code", "-", -1).try_cast("int")
    year = F.split("scan_code", "-")[1].cast("int")
    return scans.groupBy(year.alias("year")).agg((F.max(suffix) + 1).alias("next_number")).withColumn(
        "next_code", scan_code(F.col("year"), F.col("next_number")))


def assign_codes(incoming: DataFrame, scans: DataFrame, order: list[str]) -> DataFrame:
    """AGG12 in bulk: ``incoming`` (with ``year``) plus dense ``number`` and ``scan_code`` after each year's highest code.

    Rows are numbered in ``order``, which must be unique, in two steps: ranges of rows count themselves, running sums over
    the ranges give each one its first number. No task holds a whole year. The dealt ranges are written, so a lost
    executor cannot deal them anew between the steps. Years without codes start at 1; rows without a year get no code.
    """
    spark = incoming.sparkSession
    path = shared_folder(spark) + "/ranges"
    incoming.repartitionByRange("year", *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before = W.partitionBy("year").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("year", "_range").agg(F.count("*").alias("n"))
    taken = next_numbers(scans).select(F.col("year").alias("_year"), "next_number")
    first = counts.join(taken, F.col("year") == F.col("_year"), "left").select(
        "year", "_range", (F.coalesce("next_number", F.lit(1)) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("_first"))
    numbered = dealt.withColumn("_row", F.row_number().over(W.partitionBy("year", "_range").orderBy(*order)))
    number = F.when(F.col("year").isNotNull(), F.col("_first") + F.col("_row") - 1)
    named = first.withColumnsRenamed({"year": "_y", "_range": "_r"})
    joined = numbered.join(named, F.col("year").eqNullSafe(F.col("_y")) & (F.col("_range") == F.col("_r")))
    return joined.select(*incoming.columns, number.alias("number"), F.when(number.isNotNull(), scan_code(F.col("year"), number)).alias("scan_code"))


def next_display_order(images: DataFrame) -> DataFrame:
    """AGG12: next free display order per scan."""
    return images.groupBy("scan_id").agg((F.coalesce(F.max("display_order"), F.lit(-1)) + 1).alias("next_order"))


def top_k(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """TOPK1: capped rows per key; Spark limits every task to k rows per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
