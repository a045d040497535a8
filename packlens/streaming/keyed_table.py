"""A table of rows under a key that streams merge into: a batch rewrites only the buckets its keys fall in.

Rows are dealt to a fixed number of buckets by key. A batch writes its touched buckets to a folder of its own, then a manifest
that names the folder of every bucket; the manifest is the commit. A batch that runs again after a failure starts from the same
manifest and writes the same rows. Folders that neither of the last two manifests names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKETS = 64


class KeyedTable:
    """``version`` k + 1 is the table after batch k; version 0 is what ``create`` wrote."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, version: int) -> None:
        self._dealt(rows).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")

    def _commit(self, homes: dict[int, int], version: int, schema: str) -> None:
        row = [(json.dumps({"homes": {str(b): v for b, v in homes.items()}, "schema": schema}),)]
        self.spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v={version}")

    def _manifest(self, version: int) -> tuple[dict[int, int], str]:
        found = json.loads(self.spark.read.text(f"{self.path}/manifest/v={version}").first()["value"])
        return {int(b): v for b, v in found["homes"].items()}, found["schema"]

    def create(self, rows: DataFrame) -> None:
        self._write(rows, 0)
        self._commit({b: 0 for b in range(self.buckets)}, 0, rows.schema.json())

    def read(self, version: int, only: set[int] | None = None) -> DataFrame:
        """The rows of a version; of some buckets only, if given."""
        homes, schema = self._manifest(version)
        schema = StructType.fromJson(json.loads(schema))
        of_folder: dict[int, list[int]] = {}
        for b, v in homes.items():
            if only is None or b in only:
                of_folder.setdefault(v, []).append(b)
        out = self.spark.createDataFrame([], schema)
        for v, own in of_folder.items():
            rows = self.spark.read.schema(StructType([*schema.fields]).add("bucket", IntegerType())).parquet(f"{self.path}/v={v}")
            out = out.unionByName(rows.where(F.col("bucket").isin(own)).drop("bucket"))
        return out

    def merge(self, batch: DataFrame, batch_id: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """Replace the touched buckets by ``merged(their rows, batch)``; returns the touched buckets (``buckets`` at most)."""
        batch = batch.persist()  # a stateful batch must run once, and it is read twice
        try:
            touched = {r["bucket"] for r in self._dealt(batch).select("bucket").distinct().collect()}
            homes, schema = self._manifest(batch_id)
            current = self.read(batch_id, touched)
            self._write(merged(current, batch).select(*current.columns), batch_id + 1)
        finally:
            batch.unpersist()
        self._commit(homes | dict.fromkeys(touched, batch_id + 1), batch_id + 1, schema)
        self._remove_unnamed(batch_id + 1)
        return touched

    def exists(self) -> bool:
        folder, files = self._folder("manifest")
        return files.exists(folder)

    def latest(self) -> int:
        """Number of the last committed version."""
        folder, files = self._folder("manifest")
        return max(int(f.getPath().getName()[2:]) for f in files.listStatus(folder) if files.exists(f.getPath().suffix("/_SUCCESS")))

    def _folder(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder, folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _remove_unnamed(self, version: int) -> None:
        named = set(self._manifest(version)[0].values()) | set(self._manifest(version - 1)[0].values()) | {version}
        for v in set(range(version)) - named:
            folder, files = self._folder(f"v={v}")
            files.delete(folder, True)
