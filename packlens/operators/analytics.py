"""Dashboards: counts, checklist, KPIs, breakdowns and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V


def declaration_counts(decls: DataFrame, auto_counts_as_confirmed: bool = False) -> DataFrame:
    """AGG7 (and AGG7b with ``auto_counts_as_confirmed``)."""
    s = F.col("resolution_status")
    confirmed = ["CONFIRMED", "AUTO_RESOLVED"] if auto_counts_as_confirmed else ["CONFIRMED"]
    return decls.groupBy("scan_id").agg(
        F.count("*").alias("total"), F.count_if(s.isin("NEEDS_REVIEW", "CONFLICT")).alias("unreviewed"),
        F.count_if(s.isin(confirmed)).alias("confirmed"), F.lit(0).alias("corrected"),
        F.count_if(s == "REJECTED").alias("rejected"))


def checklist(scans: DataFrame, decls: DataFrame) -> DataFrame:
    """JN15: status of the 19 checklist items per scan."""
    to_item = {t: item for item, types in V.CHECKLIST for t in types}
    item_of = F.create_map(*[F.lit(x) for kv in to_item.items() for x in kv])
    s = F.col("resolution_status")
    facts = (
        decls.withColumn("item", F.try_element_at(item_of, F.col("declaration_type"))).where("item is not null")
        .groupBy("scan_id", "item").agg(
            F.count("*").alias("n"), F.bool_or("has_conflict").alias("conflict"),
            F.bool_or(s.isin("CONFIRMED", "AUTO_RESOLVED")).alias("confirmed"), F.bool_and(s == "REJECTED").alias("rejected"))
    )
    # one row a scan with at most 19 entries meets the scans; items fan out behind the join, so they are neither shuffled nor sorted
    entry = F.struct("item", F.struct("n", "conflict", "confirmed", "rejected"))
    per_scan = facts.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(entry)).alias("facts"))
    items = (
        scans.select("scan_id").join(per_scan, "scan_id", "left")
        .select("scan_id", "facts", F.explode(F.array(*[F.lit(i) for i, _ in V.CHECKLIST])).alias("item"))
        .select("scan_id", "item", F.try_element_at("facts", F.col("item")).alias("f"))
    )
    return items.select(
        "scan_id", "item",
        F.when(F.col("f.n").isNull(), "NOT_DETECTED").when(F.col("f.conflict"), "CONFLICT").when(F.col("f.confirmed"), "CONFIRMED")
        .when(F.col("f.rejected"), "REJECTED").otherwise("NEEDS_REVIEW").alias("status"),
        F.coalesce("f.n", F.lit(0)).alias("matching"))


def completeness(items: DataFrame) -> DataFrame:
    """AGG19."""
    present = F.count_if(~F.col("status").isin("NOT_DETECTED", "REJECTED"))
    return items.groupBy("scan_id").agg(present.alias("present"), F.count("*").alias("of_items"))


def kpi_summary(summaries: DataFrame) -> DataFrame:
    """AGG16: totals over scan results (scan_id, overall_status)."""
    s = F.col("overall_status")
    return summaries.agg(
        F.count("*").alias("inspections"), F.count_if(s == "PASS").alias("passed"),
        F.count_if(s == "FAIL").alias("violations"), F.count_if(s == "REVIEW").alias("review_queue"),
    ).withColumn("pass_rate", F.when(F.col("inspections") > 0, F.round(F.col("passed") / F.col("inspections"), 4)))


def violation_breakdown(findings: DataFrame, scan_category: DataFrame) -> DataFrame:
    """AGG17: failures by commodity category and rule, with all subtotals."""
    rows = findings.where("status = 'FAIL'").groupBy("scan_id", "rule_code").agg(F.count("*").alias("k"))
    return (
        rows.join(scan_category, "scan_id").cube("category", "rule_code")
        .agg(F.sum("k").alias("n"), F.grouping_id().alias("gid"))
        .select(F.when(F.col("gid").bitwiseAND(2) > 0, "ALL").otherwise(F.col("category")).alias("category"),
                F.when(F.col("gid").bitwiseAND(1) > 0, "ALL").otherwise(F.col("rule_code")).alias("rule_code"), "n")
    )


def trend(rows: DataFrame, ts: str, width: str, *aggs: Column) -> DataFrame:
    """AGG18: metrics per time window."""
    return rows.groupBy(F.window(ts, width).alias("w")).agg(*aggs).select(
        F.col("w.start").alias("window_start"), "*").drop("w")


def context_savings(intent: Column, n_decl: Column, n_quality: Column, n_findings: Column, n_matched: Column, n_violations: Column) -> Column:
    """AGG20: estimated tokens saved by the context that the intent leaves out."""
    t = V.TOKENS_PER
    return (
        F.when(intent.isin("GREETING_OR_CHITCHAT", "POLITENESS_OR_THANKS"),
               n_decl * t["declaration"] + n_quality * t["quality"] + n_findings * t["finding"] + t["small_talk"])
        .when(intent.isin("SYSTEM_NAVIGATION_HELP", "LEGAL_REGULATION_INQUIRY"),
              n_decl * t["declaration"] + n_quality * t["quality"] + t["help"])
        .when(intent == "IMAGE_QUALITY_DIAGNOSTIC", n_decl * t["declaration"] + n_findings * t["finding"])
        .when((intent == "SPECIFIC_DECLARATION_CHECK") & (n_decl > 0),
              F.when(n_matched > 0, (n_decl - n_matched) * t["declaration"]).otherwise(0) + n_quality * t["quality"])
        .otherwise(F.greatest(n_decl - V.CONTEXT_CAPS["overview"], F.lit(0)) * t["declaration"]
                   + F.when(n_violations > 0, (n_findings - F.least(n_violations, F.lit(V.CONTEXT_CAPS["violations"]))) * t["finding"]).otherwise(0))
    )
