"""Evidence of candidates: the blocks they rest on, with text, confidence and box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.session import shared_folder

#: Columns that tell candidates of an image apart.
CANDIDATE = ["image_id", "declaration_type", "stage", "a", "b", "c", "ext_seq"]


def evidence_blocks(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each candidate and block of its evidence, in order: ``position`` (from 0), id, text, confidence, box.

    Only ids travel with the candidates; texts are fetched from the blocks by (image_id, block_id).
    """
    named = candidates.select(*CANDIDATE, "image_type", F.posexplode("block_ids").alias("position", "block_id"))
    return named.join(blocks.select("image_id", "block_id", "text", "confidence", "x1", "y1", "x2", "y2"), ["image_id", "block_id"])


def evidence_payload(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """LAY11: candidates with one ``evidence`` struct: image and its type, block ids, count, union box, mean confidence, and each block.

    A block id that the blocks do not hold counts in the ids only. Lists are as long as a candidate's evidence (a few lines of text).
    The candidates are read twice, so they are written first; else their whole extraction would run twice.
    """
    spark = candidates.sparkSession
    path = shared_folder(spark) + "/evidence_candidates"
    candidates.write.parquet(path)
    candidates = spark.read.parquet(path)
    block = F.struct("position", F.col("block_id").alias("id"), "text", F.col("confidence").cast("double").alias("confidence"), F.struct("x1", "y1", "x2", "y2").alias("bbox"))
    found = evidence_blocks(candidates, blocks).groupBy(*CANDIDATE).agg(
        F.array_sort(F.collect_list(block)).alias("rows"), F.min("x1").alias("bx1"), F.min("y1").alias("by1"), F.max("x2").alias("bx2"), F.max("y2").alias("by2"))
    joined = candidates.join(found, CANDIDATE, "left")
    rows = F.col("rows")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean = F.round(F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["confidence"]) / F.size(rows), 4)
    evidence = F.struct(
        F.col("image_id").alias("scan_image_id"), "image_type", F.col("block_ids").alias("ocr_block_ids"), F.when(rows.isNull(), 0).otherwise(F.size(rows)).alias("contributing_blocks_count"),
        F.struct(zero("bx1").alias("x1"), zero("by1").alias("y1"), zero("bx2").alias("x2"), zero("by2").alias("y2")).alias("bounding_box"),
        F.coalesce(mean, F.lit(0.0)).alias("average_ocr_confidence"), F.transform(rows, lambda r: r.dropFields("position")).alias("blocks"))
    return joined.select(*candidates.columns, evidence.alias("evidence"))
