"""Spatial joins between blocks of an image (never a plain nested loop)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions.scores import edge_gap

#: Sides of cells, and of the ones that dense cells are divided into.
CELL_PX, FINE_PX = 1024, 64
#: Blocks of a cell beyond which it is divided, and of a fine cell beyond which its blocks are dealt to several tasks.
DENSE = 2000


def _steps(lo: Column, hi: Column, px: int) -> Column:
    return F.sequence(F.floor(lo / px), F.floor(F.greatest(hi, lo) / px))


def _in_cells(rows: DataFrame) -> DataFrame:
    """One row for each coarse cell of the box ``rx1, ry1, rx2, ry2``."""
    across = rows.withColumn("cx", F.explode(_steps(F.col("rx1"), F.col("rx2"), CELL_PX)))
    return across.withColumn("cy", F.explode(_steps(F.col("ry1"), F.col("ry2"), CELL_PX)))


def _divided(rows: DataFrame) -> DataFrame:
    """Rows of dense cells, one for each fine cell of theirs that the box covers."""
    x = _steps(F.greatest("rx1", F.col("cx") * CELL_PX), F.least("rx2", (F.col("cx") + 1) * CELL_PX - 1), FINE_PX)
    y = _steps(F.greatest("ry1", F.col("cy") * CELL_PX), F.least("ry2", (F.col("cy") + 1) * CELL_PX - 1), FINE_PX)
    return rows.withColumn("fx", F.explode(x)).withColumn("fy", F.explode(y))


def neighborhood(anchors: DataFrame, blocks: DataFrame, max_dx: float = 250, max_dy: float = 80) -> DataFrame:
    """JN5: all (anchor, block) pairs within the two gaps, with ``dx``, ``dy`` and distance rank inputs.

    ``anchors`` carries ``image_id``, ``anchor_id``, its box and ``block_ids``. Boxes (the anchors' widened by the gaps) are cut into
    square cells, so the equi-join key is (image, cell). Cells with more than ``DENSE`` blocks are divided into fine cells, and a fine
    cell that is still dense deals its blocks by hash, with its anchors copied to each deal; so neither a wide row nor a heap of
    equal boxes stays in one task. Counts of dense cells are a small table beside the join. A pair is emitted only in the cell that
    holds the first corner of the two boxes' intersection.
    """
    box = F.struct("x1", "y1", "x2", "y2")
    a = _in_cells(anchors.select(
        "image_id", "anchor_id", "block_ids", box.alias("__a"), (F.col("x1") - max_dx).alias("rx1"), (F.col("y1") - max_dy).alias("ry1"),
        (F.col("x2") + max_dx).alias("rx2"), (F.col("y2") + max_dy).alias("ry2")))
    b = _in_cells(blocks.select("image_id", "block_id", "block_order", "text", box.alias("__b"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1"), F.col("x2").alias("rx2"), F.col("y2").alias("ry2")))
    cell, fine = ["image_id", "cx", "cy"], ["image_id", "cx", "cy", "fx", "fy"]
    dense = b.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > DENSE).drop("n")

    whole = _paired(a.join(dense, cell, "left_anti"), b.join(dense, cell, "left_anti"), cell, "cx", "cy", CELL_PX)
    fine_b = _divided(b.join(dense, cell, "left_semi"))
    deals = fine_b.groupBy(*fine).agg(F.ceil(F.count("*") / DENSE).cast("int").alias("deals"))
    fine_a = _divided(a.join(dense, cell, "left_semi")).join(deals, fine).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    fine_b = fine_b.join(deals, fine).withColumn("deal", F.pmod(F.xxhash64("block_id", "__b"), F.col("deals")).cast("int"))
    parts = _paired(fine_a.drop("deals"), fine_b.drop("deals"), [*fine, "deal"], "fx", "fy", FINE_PX)
    dx = edge_gap(F.col("__a.x1"), F.col("__a.x2"), F.col("__b.x1"), F.col("__b.x2"))
    dy = edge_gap(F.col("__a.y1"), F.col("__a.y2"), F.col("__b.y1"), F.col("__b.y2"))
    return (
        whole.unionByName(parts)
        .where(~F.array_contains("block_ids", F.col("block_id")))
        .withColumn("dx", dx).withColumn("dy", dy)
        .where((F.col("dx") <= max_dx) & (F.col("dy") <= max_dy))
        .select("image_id", "anchor_id", "block_id", "block_order", "text", "dx", "dy")
    )


def _paired(a: DataFrame, b: DataFrame, key: list[str], x: str, y: str, px: int) -> DataFrame:
    """Pairs of a cell whose boxes' intersection starts in it."""
    left = a.select(*key, "anchor_id", "block_ids", "__a", F.col("rx1").alias("ax"), F.col("ry1").alias("ay"))
    right = b.select(*key, "block_id", "block_order", "text", "__b", F.col("rx1").alias("bx"), F.col("ry1").alias("by"))
    starts = (F.floor(F.greatest("ax", "bx") / px) == F.col(x)) & (F.floor(F.greatest("ay", "by") / px) == F.col(y))
    return left.join(right, key).where(starts).select("image_id", "anchor_id", "block_ids", "__a", "block_id", "block_order", "text", "__b")
