"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` with the least node of each component, for all nodes in ``links`` (columns ``a, b``, longs).

    Each step replaces a node's larger neighbours (then its smaller ones) by links to the least one, as an aggregate and
    a join back, so a node with very many links is never gathered. Steps end when the links no longer change.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        edges = written(small.where("a <> b").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    star = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return star.unionByName(star.select(F.col("label").alias("node"), "label").distinct())
