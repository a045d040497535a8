"""Compliance rules over resolved declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.sources.tables import rule_structs


def split_resolved(decls: DataFrame) -> DataFrame:
    """RUL1: flags for settled declarations and for those waiting for a reviewer."""
    return decls.withColumn(
        "is_resolved", F.col("resolution_status").isin("AUTO_RESOLVED", "CONFIRMED")
    ).withColumn("needs_review", F.col("resolution_status").isin("NEEDS_REVIEW", "CONFLICT"))


def best_per_rule(decls: DataFrame) -> DataFrame:
    """WIN6: the strongest settled and the strongest unsettled declaration per (scan, type)."""
    flagged = split_resolved(decls)
    w = W.partitionBy("scan_id", "declaration_type", "is_resolved").orderBy(F.desc("confidence"), "seq")
    return flagged.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def evaluate_presence(scans: DataFrame, decls: DataFrame, version: str = V.RULE_SET_VERSION,
                      target_aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """RUL2, RUL3, JN9: one finding per (scan, rule), also for rules without any declaration.

    ``scans``: scan_id. ``decls``: scan_id, declaration_type, raw_text, confidence, resolution_status,
    source_block_id, seq and, where it is kept, normalized_value; text and normalised value of the declaration behind a
    finding are its snapshot (``detected_text``, ``detected_normalized``). The rules fan out of each scan row by an explode of a literal array.
    ``target_aliases`` maps further declaration types onto a rule target (off by default).
    """
    if target_aliases:
        to_target = {t: target for target, types in target_aliases.items() for t in types}
        mapped = F.create_map(*[F.lit(x) for kv in to_target.items() for x in kv])
        decls = decls.withColumn("declaration_type", F.coalesce(
            F.try_element_at(mapped, F.col("declaration_type")), F.col("declaration_type")))
    targets = [r["target"] for r in V.RULES]
    best = best_per_rule(decls.where(F.col("declaration_type").isin(targets)))
    normal = F.col("normalized_value") if "normalized_value" in decls.columns else F.lit(None).cast("string")
    row = F.struct("raw_text", "confidence", "source_block_id", normal.alias("normalized_value"))
    per_type = best.groupBy("scan_id", F.col("declaration_type").alias("target")).agg(
        F.max(F.when(F.col("is_resolved"), row)).alias("settled"),
        F.max(F.when(~F.col("is_resolved"), row)).alias("open"))
    rules = scans.select("scan_id", F.explode(rule_structs()).alias("rule")).select("scan_id", "rule.*")
    joined = rules.join(per_type, ["scan_id", "target"], "left")
    is_open, settled = F.col("open").isNotNull(), F.col("settled")
    missing = ~is_open & settled.isNull()
    low = settled["confidence"] < F.col("min_confidence")
    used = F.when(is_open, F.col("open")).otherwise(settled)
    return joined.select(
        "scan_id", "rule_code", F.lit(version).alias("rule_version"),
        F.when(is_open, "REVIEW").when(missing, F.col("on_missing")).when(low, F.col("on_low_confidence"))
        .otherwise("PASS").alias("status"),
        F.when(is_open, "MANUAL_REVIEW_TRIGGERED").when(missing, F.col("reason_fail")).when(low, F.col("reason_review"))
        .otherwise(F.col("reason_pass")).alias("reason_code"),
        F.when(is_open, "Unresolved or insufficient evidence requires human review.")
        .when(missing, F.concat(F.lit("Missing required declaration: "), "name"))
        .when(low, F.format_string("Declaration extracted with low confidence (%.2f). Human review required.", settled["confidence"]))
        .otherwise(F.concat(F.lit("Valid declaration detected: "), settled["raw_text"])).alias("message"),
        F.when(~missing, used["raw_text"]).alias("detected_text"),
        F.when(~missing, used["normalized_value"]).alias("detected_normalized"),
        F.col("expected").alias("expected_requirement"),
        F.when(missing, 1.0).otherwise(used["confidence"]).alias("confidence"),
        F.when(~missing, used["source_block_id"]).alias("source_block_id"),
    )


def compliance_summary(findings: DataFrame, decls: DataFrame | None = None) -> DataFrame:
    """AGG8: counts and overall status; open declarations of any type keep a scan from passing."""
    counts = findings.groupBy("scan_id").agg(
        F.count("*").alias("total_rules"),
        *[F.count_if(F.col("status") == s).alias(a) for s, a in (
            ("PASS", "passed"), ("FAIL", "failed"), ("REVIEW", "review"), ("NOT_APPLICABLE", "not_applicable"))])
    if decls is None:
        waiting = F.lit(False)
    else:
        flags = split_resolved(decls).groupBy("scan_id").agg(F.bool_or("needs_review").alias("waiting"))
        counts = counts.join(flags, "scan_id", "left")
        waiting = F.coalesce(F.col("waiting"), F.lit(False))
    overall = F.when(F.col("failed") > 0, "FAIL").when((F.col("review") > 0) | waiting, "REVIEW").otherwise("PASS")
    return counts.withColumn("overall_status", overall).drop("waiting")


def condition(value: Column, operator: str, operand: object) -> Column:
    """RUL4: eq, neq, in, regex, gte, lte, exists on one normalised field."""
    ops = {
        "eq": lambda: value == F.lit(operand),
        "neq": lambda: value != F.lit(operand),
        "in": lambda: value.isin(list(operand)),
        "regex": lambda: value.cast("string").rlike(str(operand)),
        "gte": lambda: value >= F.lit(operand),
        "lte": lambda: value <= F.lit(operand),
        "exists": lambda: value.isNotNull() if operand in (True, None) else value.isNull(),
    }
    if operator not in ops:
        raise ValueError(f"unknown operator {operator!r}")
    return F.coalesce(ops[operator](), F.lit(False))


def check_conditions(decls: DataFrame, conditions: list[dict]) -> DataFrame:
    """RUL4: all conditions compiled into one boolean column ``satisfied``."""
    ok = F.lit(True)
    for c in conditions:
        ok = ok & condition(F.col(c["field"]), c["operator"], c.get("value"))
    return decls.withColumn("satisfied", ok)


def rules_as_of(inspections: DataFrame, rules: DataFrame) -> DataFrame:
    """RUL5: the active rule version at inspection time; the newest start wins where ranges overlap.

    Versions are cut into calendar months between the first and last inspection, so the join key is (rule_code, month)
    and a rule with very many inspections is dealt over its months. The validity range stays as the exact test.
    """
    first, last = inspections.agg(F.min("inspected_at"), F.max("inspected_at")).first()

    def month(c: Column) -> Column:
        return F.trunc(c.cast("date"), "MM")

    start, stop = F.greatest("valid_from", F.lit(first)), F.least(F.coalesce("valid_to", F.lit(last)), F.lit(last))
    known = rules.where("is_active").where((F.col("valid_from") <= F.lit(last)) & (stop >= start))
    dealt = known.withColumn("month", F.explode(F.sequence(month(start), month(stop), F.expr("INTERVAL 1 MONTH"))))
    inside = (F.col("r.valid_from") <= F.col("i.inspected_at")) & (
        F.col("r.valid_to").isNull() | (F.col("i.inspected_at") < F.col("r.valid_to")))
    seen = inspections.withColumn("month", month(F.col("inspected_at")))
    joined = seen.alias("i").join(
        dealt.alias("r"), (F.col("i.rule_code") == F.col("r.rule_code")) & (F.col("i.month") == F.col("r.month")) & inside)
    return joined.groupBy(F.col("i.inspection_id").alias("inspection_id"), F.col("i.rule_code").alias("rule_code")).agg(
        F.max(F.struct(F.col("r.valid_from"), F.col("r.rule_version"))).alias("v")
    ).select("inspection_id", "rule_code", F.col("v.rule_version").alias("rule_version"))
