"""Vectors on an integer grid, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid values are held within this range, so that sums of a few of them stay exact as longs.
FURTHEST = 1 << 52


def on_grid(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024, *, keep: list | None = None) -> tuple[DataFrame, int]:
    """``vec_id, z`` (and the columns ``keep``) with z = floor(scale * component), and the number of dimensions.

    Rows whose vector is null, empty or holds null or non-finite components are left out; so are vectors that are not of
    the most frequent length (of equally frequent ones, the longest), as they have no inner product with the others.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    grid = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(FURTHEST)), F.lit(-FURTHEST)))
    rows = df.where(sound).select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), grid.alias("z"), *(keep or []))
    lengths = rows.groupBy(F.size("z").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths["dims"] if lengths else 0
    return rows.where(F.size("z") == dims), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of longs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
