"""Streaming runs over the given tables, drained once and compared with the batch result."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.operators.review import apply_folds, fold_buckets, upsert_declarations
from packlens.plans.decisions import _UPSERT, fresh, review_actions, status_events, stored, unreviewed
from packlens.plans.registry import ORACLES, query
from packlens.plans.sql_parts import with_tables
from packlens.session import shared_folder
from packlens.sources.tables import read_table
from packlens.streaming import streams as ST
from packlens.streaming.keyed_table import KeyedTable


#: Arrival of an event in microseconds: up to an hour after its time, every fiftieth event three days after it. Batches cut that range evenly.
_ARRIVES_SQL = "epoch_us(ts) + event_id % 4 * 1200000000 + CASE WHEN event_id % 50 = 0 THEN 259200000000 ELSE 0 END"
BATCHES = 4


def arrivals(spark: SparkSession, d: str, batches: int = BATCHES) -> Iterator[tuple[DataFrame, str]]:
    """The events in order of arrival: before each step a batch of files is added to the folder, which a stream then drains."""
    folder = f"{shared_folder(spark)}/incoming"
    events = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant
    arrives = F.unix_micros("ts") + F.col("event_id") % 4 * 1_200_000_000 + F.when(F.col("event_id") % 50 == 0, 259_200_000_000).otherwise(0)
    low, high = events.agg(F.min(arrives), F.max(arrives)).first()
    low, high = low or 0, high or 0
    batch = F.floor((arrives - F.lit(low)) * F.lit(batches) / F.lit(high - low + 1))
    for k in range(batches):
        events.where(batch == k).write.mode("append").parquet(folder)
        yield spark.readStream.schema(events.schema).parquet(folder)


@query("sta4_duplicate_uploads_stream", """
SELECT scan_id, sha256 FROM (SELECT DISTINCT user_id AS scan_id, event_type || CAST(event_id % 20 AS VARCHAR) AS sha256 FROM events) q""")
def sta4(spark: SparkSession, d: str) -> DataFrame:
    """Uploads with repeated content, some of them days late: each is kept once, whether the state still knows it or only the table."""
    folder = shared_folder(spark)
    table = KeyedTable(spark, f"{folder}/table", "scan_id", buckets=16)
    for events in arrivals(spark, d):
        uploads = events.select(F.col("user_id").alias("scan_id"), F.concat("event_type", (F.col("event_id") % 20).cast("string")).alias("sha256"))
        if not table.exists():
            table.create(spark.createDataFrame([], uploads.schema))
        ST.drain(ST.dedupe_images(uploads, idle="1 second"), ST.keep_first_uploads(table), f"{folder}/checkpoint")
    return table.read(table.latest())


@query("sta5_action_trend_stream", f"""
WITH a AS (SELECT ts, event_type AS action, {_ARRIVES_SQL} AS arrives FROM events),
b AS (SELECT ts, action, CAST(floor((arrives - low) * {BATCHES} / (high - low + 1)) AS INT) AS batch
      FROM a, (SELECT min(arrives) AS low, max(arrives) AS high FROM a) m),
marks AS (SELECT k AS batch, max(ts) - INTERVAL 1 HOUR AS mark FROM b, range({BATCHES}) r(k) WHERE b.batch <= k - 2 GROUP BY k)
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, action, count(*) AS n
FROM b LEFT JOIN marks USING (batch)
WHERE mark IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > mark
GROUP BY ALL""")
def sta5(spark, d):
    """Update mode with a watermark of one hour: events three days late are counted only where their window is still open."""
    folder = shared_folder(spark)
    table = KeyedTable(spark, f"{folder}/table", "window_start", buckets=16)
    for events in arrivals(spark, d):
        trend = ST.action_trend(events.select(F.col("event_type").alias("action"), "ts"))
        if not table.exists():
            table.create(spark.createDataFrame([], trend.schema))
        ST.drain(trend, ST.keep_windows(table), f"{folder}/checkpoint", mode="update")
    return table.read(table.latest()).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def shuffled_files(df: DataFrame, files: int = 4) -> str:
    """Folder with the rows in ``files`` files, written one after the other, each row up to an hour after its time."""
    folder = f"{shared_folder(df.sparkSession)}/incoming"
    arrives = F.unix_micros("ts") + F.col("seq") % 4 * 1_200_000_000
    low, high = df.agg(F.min(arrives), F.max(arrives)).first()
    number = ((arrives - F.lit(low or 0)) * files / F.lit((high or 0) - (low or 0) + 1)).cast("int")
    for k in range(files):
        df.where(number == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("sta3_status_machine_stream", ORACLES["sta3_status_machine"])
def sta3_stream(spark, d):
    """Events from files that overlap in time, one a micro-batch; minutes still open at the end count with what they hold."""
    folder = shared_folder(spark)
    events = status_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(shuffled_files(events))
    buckets = ST.status_buckets(stream)
    table = KeyedTable(spark, f"{folder}/table", "scan_id", buckets=16)
    table.create(spark.createDataFrame([], buckets.schema))
    ST.drain(buckets, ST.keep_buckets(table), f"{folder}/checkpoint", mode="update")
    return fold_buckets(table.read(table.latest()))


@query("sta1_upsert_stream", with_tables("declarations") + ", " + _UPSERT)
def sta1_stream(spark, d):
    """Fresh machine results arrive as a stream of files, one a micro-batch; the last committed version is the result.

    All results of a scan are in one file. The stored table starts as a run without fresh results leaves it.
    """
    folder = shared_folder(spark)
    new = fresh(spark, d)
    table = KeyedTable(spark, f"{folder}/table", "scan_id", buckets=16)
    table.create(upsert_declarations(stored(spark, d), new.limit(0)))
    new.repartition(8, "scan_id").write.parquet(f"{folder}/incoming")
    incoming = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/incoming")
    ST.drain(incoming, ST.upsert_batches(table), f"{folder}/checkpoint")
    return table.read(table.latest())


@query("sta2_review_stream", ORACLES["sta2_review_fold"])
def sta2_stream(spark, d):
    """Review actions from files out of order, one a micro-batch: the same rows as the batch fold."""
    folder = shared_folder(spark)
    actions = review_actions(spark, d)
    actions.repartition(5, F.hash("action_id")).write.parquet(f"{folder}/incoming")  # every file spans the whole log
    table = KeyedTable(spark, f"{folder}/table", "declaration_id", buckets=16)
    table.create(spark.createDataFrame([], ST.REVIEW_TABLE))
    incoming = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/incoming")
    ST.drain(ST.review_states(incoming), ST.merge_reviews(table), f"{folder}/checkpoint", mode="update")
    folds = table.read(table.latest()).withColumn("declaration_id", F.col("declaration_id").cast("long"))
    found = apply_folds(unreviewed(spark, d), folds).drop("scan_id", "declaration_type")
    return found.withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp_ntz")).withColumn("reviewed_by", F.col("reviewed_by").cast("long"))
