"""Secret scan over an incremental ledger of content-addressed texts; DataFrame expressions only.

Every document version is a path to a blob (SHA-256 of its text). The ledger is a pair of tables in one folder: the (blob,
rule version) pairs that were scanned, and the findings. A run scans only pairs that the ledger lacks, once per blob
whatever the number of paths, appends them, and joins findings back to all paths. Changed rules have another
version and make every blob unseen again; earlier findings stay.

Defined results: null and empty texts have no findings; repeated rows and repeated ids give one result row each; null
ids are kept; other columns are ignored; an empty table scans nothing. Offsets count code points, end exclusive.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import shared_folder, shuffles_freed, written

# FIXED VALUES: patterns and least lengths that the result contract states.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE, LEAST_ACCESS = 6, 20

_GUARDS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{24}"}
_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
#: Goes up when the same patterns give other spans: the first scan misplaced the spans of repeated rows, and ledgers keep them.
SCAN = 2
#: Version of the rules, from their text.
RULES = hashlib.sha256("\n".join([*_PATTERNS.values(), str(LEAST_VALUE), str(LEAST_ACCESS), str(SCAN)]).encode()).hexdigest()


def _matches(kind: str) -> Column:
    """Matches of a kind as array<struct<kind, nth, before, size, value>>: text before the match, its length, group 2.

    ``split`` and ``regexp_extract_all`` walk the same matches, so gap i lies before match i and offsets are running sums.
    """
    text, pattern = F.col("text"), F.lit(_PATTERNS[kind])
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    value = F.regexp_extract_all("text", pattern, F.lit(2)) if kind == "assign" else found
    rows = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), value.alias("value")),
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"),
                              F.length(x["hit"]).alias("size"), F.length(x["value"]).alias("value")))
    guard = text.contains("AKIA") if kind == "access" else text.rlike(_GUARDS[kind])
    return F.when(guard, rows).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,value:int>>"))


def scan(blobs: DataFrame) -> DataFrame:
    """Findings ``blob, kind, first, last`` of ``blob, text`` rows; repeated rows count once, and their texts do not move for it."""
    raw = blobs.select("blob", F.inline(F.concat(*[_matches(k) for k in KINDS]))).repartition("blob", "kind").dropDuplicates(["blob", "kind", "nth"])
    before = Window.partitionBy("blob", "kind").orderBy("nth")
    placed = raw.select("blob", "kind", "size", "value", (F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(before) - F.coalesce("size", F.lit(0))).alias("first"))
    least = F.when(F.col("kind") == 0, F.col("value") >= LEAST_VALUE).when(F.col("kind") == 1, F.col("size") >= LEAST_ACCESS).otherwise(True)
    return placed.where(F.col("size").isNotNull() & least).select("blob", "kind", F.col("first").cast("long"), (F.col("first") + F.col("size")).cast("long").alias("last"))


class Ledger:
    """Scanned pairs and findings in a shared folder; runs append to it."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as problem:  # the first run finds no folder
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self.table("scanned", "blob string, rules string")

    def findings(self) -> DataFrame:
        return self.table("findings", "blob string, rules string, spans array<struct<first:bigint,kind:int,last:bigint>>")

    def update(self, docs: DataFrame) -> DataFrame:
        """Scan what is unseen; returns the paths ``doc_id, blob`` of this version of the documents."""
        versions = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        paths = written(versions.select("doc_id", "blob"), "paths")
        unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("first_id")).join(self.scanned().where(F.col("rules") == RULES), "blob", "left_anti")
        unseen = written(unseen, "unseen")
        keys = unseen.select(F.col("blob").alias("want"), "first_id")
        texts = versions.join(keys, versions["doc_id"].eqNullSafe(keys["first_id"]) & (versions["blob"] == keys["want"]), "left_semi")
        found = scan(texts.select("blob", "text"))
        spans = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("first", "kind", "last"))).alias("spans"))
        with shuffles_freed(self.spark):
            spans.select("blob", F.lit(RULES).alias("rules"), "spans").write.mode("append").parquet(f"{self.path}/findings")
            unseen.select("blob", F.lit(RULES).alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")
        return paths


def findings_of(paths: DataFrame, ledger: Ledger) -> DataFrame:
    """Findings joined back to all paths: ``doc_id, blob, spans``."""
    found = ledger.findings().where(F.col("rules") == RULES).select("blob", "spans").dropDuplicates(["blob"])
    return paths.join(found, "blob", "left")


def _number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document with counts and spans; ``path`` is the ledger's folder, a new one if none is given."""
    ledger = Ledger(docs.sparkSession, path or f"{shared_folder(docs.sparkSession)}/ledger")
    rows = findings_of(ledger.update(docs), ledger)
    spans = F.coalesce("spans", F.array().cast("array<struct<first:bigint,kind:int,last:bigint>>"))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ",")
    counts = [_number(spans, i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))
