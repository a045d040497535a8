"""Image quality classes and intake checks over metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V

Q = V.QUALITY


def quality_warnings() -> Column:
    """QLT1: warnings in fixed order."""
    w, h = F.col("width"), F.col("height")
    return F.array_compact(F.array(
        F.when((w < Q["min_side"]) | (h < Q["min_side"]), "LOW_RESOLUTION"),
        F.when(F.col("blur_score") < Q["blur"], "BLUR"),
        F.when(F.col("glare_score") > Q["glare"], "GLARE"),
    ))


def quality_status() -> Column:
    """QLT2."""
    w, h = F.col("width"), F.col("height")
    severe = (
        (F.col("blur_score") < Q["severe_blur"]) | (F.col("glare_score") > Q["severe_glare"])
        | (w < Q["severe_side"]) | (h < Q["severe_side"])
    )
    empty = (F.col("foreground_ratio") < Q["min_foreground"]) & (F.col("background_ratio") > Q["max_background"])
    return (
        F.when(severe, "RECAPTURE_RECOMMENDED").when(F.size(quality_warnings()) > 0, "REVIEW")
        .when(empty, "REVIEW").otherwise("ACCEPTED")
    )


def processing_status(status: Column) -> Column:
    """QLT3."""
    return F.when(status == "RECAPTURE_RECOMMENDED", "RECAPTURE_RECOMMENDED").otherwise("COMPLETED")


def classify(metrics: DataFrame) -> DataFrame:
    return (
        metrics.withColumn("warnings", quality_warnings()).withColumn("quality_status", quality_status())
        .withColumn("image_status", processing_status(F.col("quality_status")))
    )


def intake_flags(images: DataFrame) -> DataFrame:
    """QLT4: size, type and per-scan count limits, as flags instead of errors."""
    counts = images.groupBy("scan_id").agg(F.count("*").alias("n_images"))
    return images.join(counts, "scan_id").select(
        "scan_id", "image_id",
        (F.col("file_size") > V.INTAKE["max_bytes"]).alias("too_large"),
        (~F.col("mime_type").isin(V.INTAKE["mime"])).alias("bad_type"),
        (F.col("n_images") > V.INTAKE["max_images"]).alias("too_many"),
    )


def resize_plan(images: DataFrame) -> DataFrame:
    """QLT5: stored size (longest edge at most 3500) and OCR upscaling (short of 1800)."""
    edge = F.greatest("width", "height")
    ratio = F.lit(float(V.INTAKE["max_edge"])) / edge
    shrink = edge > V.INTAKE["max_edge"]
    stored = F.greatest("stored_width", "stored_height")
    return (
        images.withColumn("stored_width", F.when(shrink, (F.col("width") * ratio).cast("int")).otherwise(F.col("width")))
        .withColumn("stored_height", F.when(shrink, (F.col("height") * ratio).cast("int")).otherwise(F.col("height")))
        .withColumn("ocr_scale", F.when(stored < V.INTAKE["ocr_edge"], F.least(
            F.lit(V.INTAKE["ocr_max_scale"]), F.lit(float(V.INTAKE["ocr_edge"])) / stored)).otherwise(1.0))
    )


def first_of_duplicates(images: DataFrame) -> DataFrame:
    """JN12: flags repeated content inside a scan; the first image in upload order stays.

    The first image is a running minimum per (scan, hash), so a hash repeated millions of times is combined map-side.
    """
    firsts = images.groupBy("scan_id", "sha256").agg(F.min(F.struct("display_order", "image_id")).alias("__first"))
    return images.join(firsts, ["scan_id", "sha256"]).withColumn(
        "is_duplicate", F.col("image_id") != F.col("__first.image_id")).drop("__first")


def last_n_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
