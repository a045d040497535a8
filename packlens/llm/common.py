"""Written tables in the shared folder and small helpers for Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a Python worker is sent at once.
BATCH = "8m"
_CLEAN_UP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in storage that all executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(base, f"llm-{uuid.uuid4().hex}")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that ends in a written table go as soon as the table is there; batches for Python are small."""
    own = dict.fromkeys(_CLEAN_UP, "true") | {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; one very long text is a batch of its own."""
    for batch in batches:
        start = held = 0
        for i, size in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
            if held and held + (size or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def fold(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the split into training and held-out rows."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus
