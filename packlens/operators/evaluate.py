"""Accuracy: precision, recall and F1 of declarations, error rates of recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.functions.scores import cer, wer


def outcomes(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """JN8, SET2: expected and predicted values per (record, type). Both sides: record_id, type, value, pos.

    Several entries of a type in a record: the last one counts.
    """
    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("record_id", "type").agg(F.max(F.struct("pos", "value")).alias("v")).select(
            "record_id", "type", F.col("v.value").alias(name), F.lit(True).alias(f"has_{name}"))

    both = last(expected, "expected").join(last(predicted, "predicted"), ["record_id", "type"], "full_outer")
    has_e, has_p = F.coalesce("has_expected", F.lit(False)), F.coalesce("has_predicted", F.lit(False))
    return both.select(
        "record_id", "type",
        F.when(has_e & has_p & F.col("expected").eqNullSafe(F.col("predicted")), "tp")
        .when(has_p, "fp").otherwise("fn").alias("outcome"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def prf(results: DataFrame) -> DataFrame:
    """AGG9: metrics per type plus the micro average in the row whose type is ``ALL``."""
    counts = results.rollup("type").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")], F.grouping("type").alias("__all"))
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        F.when(F.col("__all") == 1, "ALL").otherwise(F.col("type")).alias("type"), "tp", "fp", "fn",
        F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(_ratio(2 * p * r, p + r), 4).alias("f1"))


def gate(records: DataFrame, minimum: int = V.MIN_LABELLED) -> DataFrame:
    """AGG10: whether there are enough labelled records for metrics."""
    return records.agg(F.count("*").alias("labeled_packages")).select(
        "labeled_packages", F.lit(minimum).alias("threshold_required"),
        F.when(F.col("labeled_packages") < minimum, "benchmark dataset pending").otherwise("COMPLETED").alias("status"))


def labelled_outcomes(labelled: DataFrame) -> DataFrame:
    """SRC5 + JN8: outcomes straight from nested labelled records."""
    def side(col: str, field: str) -> DataFrame:
        return labelled.select(F.col("scan_id").alias("record_id"), F.posexplode(col).alias("pos", "d")).select(
            "record_id", "pos", F.col("d.type").alias("type"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(f"d.{field}")))).alias("value"))

    return outcomes(side("expected_declarations", "normalized_expected"), side("predicted_declarations", "normalized_value"))


def hypothesis_text(ordered_blocks: DataFrame) -> DataFrame:
    """AGG15: text of an image in reading order (one row of the output is the whole text by definition)."""
    pieces = F.array_sort(F.collect_list(F.struct("reading_pos", "text")))
    return ordered_blocks.groupBy("image_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), " ").alias("hypothesis"), F.count("*").alias("n_blocks"))


def error_rates(pairs: DataFrame) -> DataFrame:
    """AGG13, AGG14: CER and WER; images without ground truth keep null metrics."""
    have = F.col("ground_truth").isNotNull()
    hyp = F.coalesce("hypothesis", F.lit(""))
    return pairs.withColumn("cer", F.when(have, cer(F.col("ground_truth"), hyp))).withColumn(
        "wer", F.when(have, wer(F.col("ground_truth"), hyp)))
