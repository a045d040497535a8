"""Incremental forms of the stateful operators (Structured Streaming).

State stores, watermarks and exactly-once bookkeeping are Spark's; checkpoints live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packlens.operators.review import composed_in_order, event_tables, upsert_declarations, valid_actions
from packlens.session import shared_folder
from packlens.streaming.keyed_table import KeyedTable


def dedupe_images(images: DataFrame, idle: str = "1 hour") -> DataFrame:
    """STA4: the first upload of each (scan, content hash) among those that arrive within ``idle``.

    The watermark follows arrival, not the time of upload: no upload is late, whatever its time, and the state of a hash expires ``idle`` after
    it came, about when its scan's session ends. The state so holds recent arrivals only; repeats that come later are known from the table
    that :func:`keep_first_uploads` keeps.
    """
    arrived = images.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", idle)
    return arrived.dropDuplicatesWithinWatermark(["scan_id", "sha256"]).drop("__arrived")


def keep_first_uploads(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink for :func:`dedupe_images`: adds uploads whose (scan, hash) the table, keyed by scan_id, does not hold; null is a value like others."""

    def merged(current: DataFrame, batch: DataFrame) -> DataFrame:
        held = current.select(F.col("scan_id").alias("__scan"), F.col("sha256").alias("__hash"))
        new = F.col("scan_id").eqNullSafe(F.col("__scan")) & F.col("sha256").eqNullSafe(F.col("__hash"))
        return current.unionByName(batch.join(held, new, "left_anti").dropDuplicates(["scan_id", "sha256"]))

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch_id, merged)

    return apply


def action_trend(events: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """STA5: audit actions per event-time window, for update mode; keep the counts with :func:`keep_windows`.

    A window leaves the state, with its last count, once the watermark (greatest time seen, less ``delay``) has passed its end. Rows of such
    a window are late and ignored. As Spark judges lateness by the watermark of the batch before, a row of batch k is late if its window ended
    at or before the greatest time of batches 0 to k-2, less ``delay``.
    """
    return (
        events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), "action").agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "action", "n")
    )


def keep_windows(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink for :func:`action_trend`: the newest count of each window and action, in a table keyed by window_start.

    A batch changes recent windows, so it writes the few buckets that these lie in.
    """

    def merged(current: DataFrame, batch: DataFrame) -> DataFrame:
        changed = batch.select(F.col("window_start").alias("__start"), F.col("action").alias("__action"))
        same = (F.col("window_start") == F.col("__start")) & F.col("action").eqNullSafe(F.col("__action"))
        return current.join(changed, same, "left_anti").unionByName(batch)

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch_id, merged)

    return apply


def status_buckets(events: DataFrame, delay: str = "2 hours", width: str = "1 minute") -> DataFrame:
    """STA3 as a stream of closed buckets (scan_id, ts, t, n): the events of a scan and minute as one transition table.

    Events may come in any order within ``delay``. In append mode a bucket is emitted once, when the watermark has passed it; in
    update mode it is emitted whenever it changes, so open buckets are known as well (keep them with :func:`keep_buckets`). A closed
    bucket leaves the state and later events of it are ignored. Compose the buckets with :func:`packlens.operators.review.fold_buckets`.
    """
    tables = event_tables(events).withWatermark("ts", delay)
    closed = tables.groupBy("scan_id", F.window("ts", width).alias("w")).agg(
        composed_in_order("ts", "seq").alias("t"), F.sum("n").alias("n"))
    return closed.select("scan_id", F.col("w.start").alias("ts"), "t", "n")


def keep_buckets(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink for :func:`status_buckets` in update mode: the newest form of each bucket, in a table keyed by scan_id."""

    def merged(current: DataFrame, batch: DataFrame) -> DataFrame:
        return current.join(batch.select("scan_id", "ts"), ["scan_id", "ts"], "left_anti").unionByName(batch)

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch_id, merged)

    return apply


def upsert_batches(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """STA1 as a ``foreachBatch`` sink over a table keyed by scan_id; only the buckets of the batch's scans are written.

    A scan that the batch says nothing about stays as it is, also where it shares a bucket with one that is merged.
    """

    def merged(current: DataFrame, batch: DataFrame) -> DataFrame:
        touched = batch.select("scan_id").distinct()
        fresh = upsert_declarations(current.join(touched, "scan_id", "left_semi"), batch)
        return current.join(touched, "scan_id", "left_anti").unionByName(fresh.select(*current.columns))

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch_id, merged)

    return apply


def _later(a: tuple, b: tuple) -> tuple:
    """Two review states of a declaration as one: the later action, then the later correction. The rule of :func:`review_states`, for two rows without the id."""
    action = max(a, b, key=lambda r: r[:2])
    fix = max(a, b, key=lambda r: (bool(r[5]), *r[6:8]))
    return (*action[:5], *fix[5:])


def review_states(actions: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """STA2 as a stream: the review state of each declaration that a micro-batch touches (update mode).

    Actions may come in any order: what counts is event time, then action id. It is an aggregate of two maxima, so each task first reduces its
    rows to one a declaration, and a declaration with very many actions is no hot key. The watermark follows arrival, so no action is late: the
    state of a declaration is one row for each span of ``idle`` in which actions came, and leaves ``idle`` after its end. Later actions start a
    new state, and :func:`merge_reviews` sets that against what the table holds. So nothing is lost to lateness, and the state holds only
    declarations under review.
    """
    fixed = F.col("action") == "CORRECTED"
    t, action_id = F.unix_micros(F.col("acted_at").cast("timestamp")).alias("t"), F.col("action_id").cast("long").alias("action_id")
    flat = valid_actions(actions).where("declaration_id IS NOT NULL AND acted_at IS NOT NULL AND action_id IS NOT NULL").select(
        F.col("declaration_id").cast("string").alias("declaration_id"), F.current_timestamp().alias("__arrived"),
        F.struct(t, action_id, "action", "value", F.col("reviewed_by").cast("string").alias("reviewed_by")).alias("last"),
        F.when(fixed, F.struct(t, action_id, "value")).alias("fix"))
    folded = flat.withWatermark("__arrived", idle).groupBy(F.window("__arrived", idle), "declaration_id").agg(F.max("last").alias("last"), F.max("fix").alias("fix"))
    none = F.lit(0).cast("long")
    return folded.select(
        "declaration_id", "last.*", F.col("fix").isNotNull().alias("fixed"), F.coalesce("fix.t", none).alias("fix_t"),
        F.coalesce("fix.action_id", none).alias("fix_id"), F.col("fix.value").alias("fix_value"))


#: Columns of the table that :func:`merge_reviews` keeps: the fold of each declaration, as ``operators.review.fold_actions`` gives it.
REVIEW_TABLE = ("declaration_id string, last struct<t:struct<acted_at:timestamp,action_id:bigint>,action:string,value:string,reviewed_by:string>, "
                "fix struct<t:struct<acted_at:timestamp,action_id:bigint>,value:string>")


def merge_reviews(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink for :func:`review_states`: the later of stored and new state stays, for action and correction each."""

    def stamp(t: str, action_id: str):
        return F.struct(F.timestamp_micros(t).alias("acted_at"), F.col(action_id).alias("action_id")).alias("t")

    def merged(current: DataFrame, batch: DataFrame) -> DataFrame:
        new = batch.select("declaration_id", F.struct(stamp("t", "action_id"), "action", "value", "reviewed_by").alias("last"),
                           F.when(F.col("fixed"), F.struct(stamp("fix_t", "fix_id"), F.col("fix_value").alias("value"))).alias("fix"))
        return current.unionByName(new).groupBy("declaration_id").agg(F.max("last").alias("last"), F.max("fix").alias("fix"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch_id, merged)

    return apply


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a finite stream through a batch sink until its input is used up; returns the ended query with its progress.

    Timers by processing time would ask for batches without data for ever, so there are none of these here.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        query = (
            stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        conf.set(key, before)
    query.awaitTermination()
    return query


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a finite stream into a Parquet table of the shared folder and read it back."""
    folder = shared_folder(spark)
    path = f"{folder}/out"
    if mode == "append":
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    else:
        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        writer = stream.writeStream.outputMode(mode).foreachBatch(sink)
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)
