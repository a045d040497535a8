"""Registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm.decontaminate import decontaminate
from packlens.llm.divergence import audit
from packlens.llm.line_dedup import dedup_lines
from packlens.llm.minhash import near_duplicates
from packlens.llm.mixing import mixed
from packlens.llm.oracles import ORACLES
from packlens.llm.packing import pack_tokens
from packlens.llm.quality_cnn import score_quality
from packlens.llm.quality_rules import quality_verdicts
from packlens.llm.repeats import remove_repeats
from packlens.llm.secret_scan import secret_report
from packlens.llm.toxicity import score_toxicity
from packlens.llm.vector_topk import top_k
from packlens.llm.whitening import whiten


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(_table(spark, folder, "documents"))


def op4_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(_table(spark, folder, "documents"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(_table(spark, folder, "documents"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(_table(spark, folder, "documents"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_tokens(_table(spark, folder, "documents"))


def op11_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit(_table(spark, folder, "documents"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(_table(spark, folder, "embeddings"))


QUERIES = (op1_toxicity, op2_quality_classifier, op3_secret_scans, op4_repeated_strings, op5_quality_rules, op6_line_dedup,
           op7_near_duplicates, op8_source_mixing, op9_decontamination, op10_token_packing, op11_vector_search, op12_source_divergence, op13_embedding_whitening)


def all_queries() -> dict:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def all_oracles() -> dict:
    return ORACLES | ({} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL})
