"""Review-preserving persistence: upserts, review actions and the scan status machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V

KEY = ["scan_id", "declaration_type"]
#: Snapshot columns of the best candidate, with what they become when a run finds no candidate for a reviewed declaration.
SNAPSHOT = {"raw_text": "", "raw_value": "", "image_id": None, "bounding_box": None, "has_conflict": False, "conflict_details": None,
            "source_block_id": None, "candidate_details": None, "confidence_breakdown": None, "confidence_level": "LOW"}


def upsert_declarations(existing: DataFrame, resolved: DataFrame, extractor_version: str | None = None) -> DataFrame:
    """STA1, SNK2, JN13: merge fresh machine results into stored declarations.

    ``existing``: scan_id, declaration_type, declaration_id, resolution_status, reviewed, reviewed_value, machine_value.
    ``resolved``: scan_id, declaration_type, resolution_status, machine_value, confidence.
    Reviewed rows keep status and reviewed value while the machine snapshot refreshes; unreviewed rows
    are replaced; a type that is no longer detected leaves no unreviewed row behind.

    Columns of ``SNAPSHOT`` that ``resolved`` has are refreshed with it. ``normalized_value`` of a reviewed row stays (of ``existing``, if
    it has that column), a new row takes the machine value. ``resolution_reason`` of a reviewed row says that the review was preserved.
    ``extractor_version`` stamps every row.
    """
    held = F.coalesce(F.col("reviewed"), F.lit(False)) | F.col("resolution_status").isin("CONFIRMED", "REJECTED")
    snapshot = [c for c in SNAPSHOT if c in resolved.columns]
    normal = F.col("normalized_value") if "normalized_value" in existing.columns else F.lit(None).cast("string")
    old = existing.where(held).select(
        *KEY, F.col("declaration_id").alias("old_id"), F.col("resolution_status").alias("old_status"), "reviewed_value", normal.alias("old_normal"))
    new = resolved.select(
        *KEY, F.col("resolution_status").alias("new_status"), "machine_value", "confidence", *snapshot, *[c for c in ("resolution_reason",) if c in resolved.columns])
    kept, seen = F.col("old_status").isNotNull(), F.col("new_status").isNotNull()
    found = seen & (F.col("new_status") != "NOT_DETECTED")
    more = [F.when(seen, F.col(c)).otherwise(F.lit(SNAPSHOT[c])).alias(c) for c in snapshot]
    if "resolution_reason" in resolved.columns:
        more.append(F.when(kept, V.REVIEW_PRESERVED).otherwise(F.col("resolution_reason")).alias("resolution_reason"))
    if "normalized_value" in existing.columns:
        more.append(F.when(kept, F.col("old_normal")).when(found, F.col("machine_value")).alias("normalized_value"))
    if extractor_version is not None:
        more.append(F.lit(extractor_version).alias("extractor_version"))
    return (
        old.join(new, KEY, "full_outer").where(kept | found)
        .select(
            *KEY, F.col("old_id").alias("declaration_id"),
            F.when(kept, F.col("old_status")).otherwise(F.col("new_status")).alias("resolution_status"),
            F.when(found, F.col("machine_value")).alias("machine_value"),
            F.when(kept, F.col("reviewed_value")).alias("reviewed_value"),
            F.coalesce(F.nullif(F.when(kept, F.col("reviewed_value")), F.lit("")), F.when(found, F.col("machine_value"))).alias("canonical_value"),
            F.coalesce(F.when(found, F.col("confidence")), F.lit(0.0)).alias("confidence"),
            F.coalesce(kept, F.lit(False)).alias("reviewed"), *more,
        )
    )


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key in the given order; ranked per task before the shuffle."""
    return (
        df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        .where("__rn = 1").drop("__rn")
    )


def valid_actions(actions: DataFrame) -> DataFrame:
    """Review actions that count: known ones, and of corrections those with a value."""
    return actions.where(F.col("action").isin("CONFIRMED", "REJECTED") | ((F.col("action") == "CORRECTED") & (F.length(F.coalesce("value", F.lit(""))) > 0)))


def fold_actions(actions: DataFrame) -> DataFrame:
    """The last action and the last correction of each declaration: ``declaration_id, last, fix``; two such folds merge by maximum."""
    when = F.struct("acted_at", "action_id")
    return valid_actions(actions).groupBy("declaration_id").agg(
        F.max(F.struct(when.alias("t"), "action", "value", "reviewed_by")).alias("last"),
        F.max(F.when(F.col("action") == "CORRECTED", F.struct(when.alias("t"), "value"))).alias("fix"))


def apply_folds(decls: DataFrame, folds: DataFrame) -> DataFrame:
    """Declarations after their reviews. A correction sets canonical and normalised value; both outlive a later rejection or confirmation."""
    action = F.col("last.action")
    corrected = F.coalesce(F.col("fix.value"), F.col("canonical_value"))
    more = [F.coalesce(F.col("fix.value"), F.col("normalized_value")).alias("normalized_value")] if "normalized_value" in decls.columns else []
    at = F.coalesce(F.col("last.t.acted_at"), F.col("reviewed_at")) if "reviewed_at" in decls.columns else F.col("last.t.acted_at")
    return (
        decls.join(folds, "declaration_id", "left")
        .select(
            "declaration_id", "scan_id", "declaration_type", "machine_value",
            F.when(action == "REJECTED", "REJECTED").when(action.isNotNull(), "CONFIRMED")
            .otherwise(F.col("resolution_status")).alias("resolution_status"),
            F.when(action == "CONFIRMED", F.coalesce(F.nullif("machine_value", F.lit("")), corrected))
            .when(action == "CORRECTED", F.col("last.value"))
            .when(action.isNull(), F.col("reviewed_value")).alias("reviewed_value"),
            corrected.alias("canonical_value"),
            (F.col("reviewed") | action.isNotNull()).alias("reviewed"),
            F.coalesce(F.col("last.reviewed_by"), F.col("reviewed_by")).alias("reviewed_by"),
            at.alias("reviewed_at"), *more,
        )
    )


def apply_reviews(decls: DataFrame, actions: DataFrame) -> DataFrame:
    """STA2: fold review actions into declarations; the machine value never changes.

    Actions: declaration_id, action (CONFIRMED, CORRECTED, REJECTED), value, reviewed_by, acted_at, action_id.
    A correction needs a value. Every action overwrites status and reviewed value, so the last valid
    action decides, except that canonical and normalised value keep the last correction.
    """
    return apply_folds(decls, fold_actions(actions))


# ------------------------------------------------------------------- status machine (STA3)
STATUS_EVENTS = {  # event -> {status before: status after}; statuses not listed stay as they are
    "upload": {"CREATED": "IMAGES_UPLOADED"},
    "last_image_deleted": {"IMAGES_UPLOADED": "CREATED"},
    "process": {s: "PROCESSING" for s in V.SCAN_STATUSES},
    "ocr_done": {s: "OCR_COMPLETED" for s in V.SCAN_STATUSES},
    "all_failed": {s: "FAILED" for s in V.SCAN_STATUSES},
    "extract": {s: "DECLARATIONS_EXTRACTED" for s in ("OCR_COMPLETED", "IMAGES_UPLOADED", "PROCESSING")},
}


def _transition(event: Column) -> Column:
    """The event as a table: position = status before, value = position of the status after."""
    index = {s: i for i, s in enumerate(V.SCAN_STATUSES)}
    same = F.array(*[F.lit(i) for i in range(len(V.SCAN_STATUSES))])
    out = None
    for name, moves in STATUS_EVENTS.items():
        table = F.array(*[F.lit(index[moves.get(s, s)]) for s in V.SCAN_STATUSES])
        out = F.when(event == name, table) if out is None else out.when(event == name, table)
    return out.otherwise(same)


_IDENTITY = list(range(len(V.SCAN_STATUSES)))


def event_tables(events: DataFrame) -> DataFrame:
    """Each event as its transition table (scan_id, ts, seq, t, n)."""
    return events.select(
        "scan_id", "ts", "seq", _transition(F.col("event")).alias("t"), F.lit(1).cast("bigint").alias("n"))


def composed_in_order(*order: str) -> Column:
    """Aggregate that composes the transition tables ``t`` of a group in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "t")))
    return F.aggregate(
        rows, F.array(*[F.lit(i) for i in _IDENTITY]),
        lambda acc, e: F.transform(acc, lambda s: F.element_at(e["t"], s + 1)))


def _fold(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Compose the transition tables ``t`` of every key in the given order."""
    return df.groupBy(*keys).agg(composed_in_order(*order).alias("t"), F.sum("n").alias("n"))


def transitions(events: DataFrame, buckets: tuple[str, ...] = ("1 minute", "1 day")) -> DataFrame:
    """All events of a scan as one transition table (scan_id, t, n). Events: scan_id, event, ts, seq.

    Transitions compose, so events are folded level by level: per (scan, minute) into one table,
    minutes into days, days into the scan. A scan with a third of all events is spread over its
    buckets, and what finally meets in one place is nine integers per day.
    """
    folded = event_tables(events)
    order = ["ts", "seq"]
    for width in buckets:
        bucketed = folded.withColumn("bucket", F.window("ts", width)["start"])
        folded = _fold(bucketed, ["scan_id", "bucket"], order).withColumnRenamed("bucket", "ts")
        order = ["ts"]
    return _fold(folded, ["scan_id"], order)


def status_of(tables: DataFrame, start: str = "CREATED") -> DataFrame:
    """Status a transition table leads to from ``start``."""
    names = F.array(*[F.lit(s) for s in V.SCAN_STATUSES])
    return tables.select(
        "scan_id", F.element_at(names, F.element_at("t", V.SCAN_STATUSES.index(start) + 1) + 1).alias("status"),
        F.col("n").alias("n_events"))


def fold_status(events: DataFrame, start: str = "CREATED") -> DataFrame:
    """STA3: final status per scan from its ordered events."""
    return status_of(transitions(events), start)


def fold_buckets(buckets: DataFrame, start: str = "CREATED") -> DataFrame:
    """STA3 over closed event-time buckets (scan_id, ts, t, n), composed in the order of their times, day by day first."""
    days = _fold(buckets.withColumn("bucket", F.window("ts", "1 day")["start"]), ["scan_id", "bucket"], ["ts"])
    return status_of(_fold(days, ["scan_id"], ["bucket"]), start)
