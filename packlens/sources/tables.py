"""Readers and writers of the label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packlens.functions import fixed_values as V

BLOCK_SCHEMA = (
    "scan_id bigint, image_id bigint, image_type string, image_seq int, block_id bigint, block_order int, "
    "text string, confidence double, x1 int, y1 int, x2 int, y2 int"
)
RULE_SCHEMA = (
    "rule_code string, name string, target string, min_confidence double, on_missing string, "
    "on_low_confidence string, reason_pass string, reason_fail string, reason_review string, expected string"
)
RULE_JSON = (
    "type string, target string, conditions array<struct<field:string,operator:string,value:string>>, "
    "on_missing string, on_low_confidence string, min_confidence double, expected_format string, "
    "parameters map<string,string>"
)
CASE_SCHEMA = (
    "id string, description string, image_condition string, expected_pipeline_behavior struct<"
    "image_quality:string,ocr_confidence_tier:string,declaration_extraction:string,rule_engine_action:string>"
)
LABELLED_SCHEMA = (
    "scan_id string, expected_declarations array<struct<type:string,normalized_expected:map<string,string>>>, "
    "predicted_declarations array<struct<type:string,normalized_value:map<string,string>>>"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_ocr_blocks(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: blocks by explicit schema; reading order is a column, not a physical sort."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def read_scan_images(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: one row per image of a scan."""
    return spark.read.parquet(path)


def rule_structs() -> Column:
    """The rule table as an array literal: joining rules to scans is an explode, never a cross join."""
    fields = T._parse_datatype_string(RULE_SCHEMA).fields
    return F.array(*[
        F.struct(*[F.lit(rule[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for rule in V.RULES
    ])


def rule_catalog(spark: SparkSession) -> DataFrame:
    """SRC3: the built-in presence rules."""
    fields = [f.name for f in T._parse_datatype_string(RULE_SCHEMA).fields]
    return spark.createDataFrame([tuple(rule[f] for f in fields) for rule in V.RULES], RULE_SCHEMA)


def parse_rule_json(text: Column) -> Column:
    """SRC4: JSON rule definition -> typed struct with the documented defaults."""
    r = F.from_json(text, RULE_JSON)
    return F.struct(
        F.coalesce(r["type"], F.lit("presence")).alias("type"),
        r["target"].alias("target"),
        F.coalesce(r["conditions"], F.from_json(F.lit("[]"), "array<struct<field:string,operator:string,value:string>>")).alias("conditions"),
        F.coalesce(r["on_missing"], F.lit("FAIL")).alias("on_missing"),
        F.coalesce(r["on_low_confidence"], F.lit("REVIEW")).alias("on_low_confidence"),
        F.coalesce(r["min_confidence"], F.lit(0.70)).alias("min_confidence"),
        r["expected_format"].alias("expected_format"),
    )


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: labelled packages with two nested lists."""
    return spark.read.schema(LABELLED_SCHEMA).json(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: ``<stem>.txt`` files, one row per file."""
    name = F.col("_metadata.file_name")
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(name, r"\.txt$", "").alias("stem"),
        F.regexp_replace(F.col("value"), r"(?U)^\s+|\s+$", "").alias("ground_truth"),
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: multi-line JSON list of scenario cases."""
    return spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)


def list_images(spark: SparkSession, path: str, suffixes: list[str] | None = None) -> DataFrame:
    """SRC8: files by suffix, metadata only (the content column is never read)."""
    glob = "*.{%s}" % ",".join(s for x in (suffixes or V.IMAGE_SUFFIXES) for s in {x.lower(), x.upper()})
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "modificationTime")
    )


# ------------------------------------------------------------------------------ sinks
def replace_by_key(target: DataFrame, new: DataFrame, key: str = "image_id") -> DataFrame:
    """SNK1: reprocessing an image replaces its rows; running it twice changes nothing."""
    keys = new.select(key).distinct()
    return target.join(keys, key, "left_anti").unionByName(new)


def evidence_bridge(decls: DataFrame) -> DataFrame:
    """SNK3: one row per (declaration, source block)."""
    return decls.select("declaration_id", F.explode("block_ids").alias("block_id")).distinct()


def append_rows(df: DataFrame, path: str) -> None:
    """SNK4: append-only log."""
    df.write.mode("append").parquet(path)


def write_results_json(df: DataFrame, path: str) -> None:
    """SNK5: one JSON record per image."""
    df.write.mode("overwrite").json(path)
