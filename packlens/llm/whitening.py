"""Embedding whitening by QDWH spectral divide-and-conquer.

Sums and the covariance of the vectors are map-side partial results of one row a task and dimension, added up by Spark; only
a d x d matrix reaches the driver, whatever the number of rows. Its eigenvectors come from spectral
divide-and-conquer: the polar factor U of (A - shift I), by the dynamically weighted Halley iteration, gives the projector
(U + I) / 2 onto the invariant subspace of the eigenvalues above the shift; an orthonormal basis of it and of its
complement turns A into two blocks, each split again until a block is a single component (or a multiple of the identity). The leading
components (k x d numbers) travel with the map tasks that whiten the rows.

Vectors are put on an integer grid first (``vectors.on_grid``, plus ``shift``), so that sums and deviations are exact. Covariances are
centred before multiplying and have divisor n.

Defined results: unsound vectors (null, empty, null or non-finite components, another length than most) are dropped; repeated rows count
as often as they occur; fewer dimensions than components give fewer components; a component without variance (one row, or
copies of one vector only) has ``whitened`` null, and ``explained`` is null where there is no variance at all; a deviation beyond long is null. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import written
from packlens.llm.vectors import matrix, on_grid

COMPONENTS, SHIFT = 8, 100_000
_EPS = np.finfo(float).eps
#: Where the spectrum is cut, in standard deviations from its mean; later ones only if an eigenvalue lies at the cut.
_CUTS = (0.0, 0.11, -0.13, 0.29, -0.31, 0.47, -0.53, 0.71, -0.73)


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QR- and Cholesky-based QDWH iteration."""
    k = len(a)
    eye = np.eye(k)
    x = a / np.linalg.norm(a)
    low = _EPS
    for _ in range(30):
        square = low * low
        root = np.cbrt(4 * (1 - square) / square ** 2)
        more = np.sqrt(1 + root)
        weight = more + np.sqrt(max(8 - 4 * root + 8 * (2 - square) / (square * more), 0)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
            new = b / c * x + (weight - b / c) / np.sqrt(c) * q[:k] @ q[k:].T
        else:
            lower = np.linalg.cholesky(eye + c * x.T @ x)
            new = b / c * x + (weight - b / c) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        new = (new + new.T) / 2
        low = min(low * (weight + b * square) / (1 + c * square), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - low < 10 * _EPS and moved < np.cbrt(5 * _EPS):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below a cut near the mean eigenvalue."""
    k = len(a)
    mean = np.trace(a) / k
    spread = np.sqrt(((a - mean * np.eye(k)) ** 2).sum() / k)
    start = np.random.default_rng(7).standard_normal((k, k))
    best = None
    for cut in _CUTS:
        projector = (polar_factor(a - (mean + cut * spread) * np.eye(k)) + np.eye(k)) / 2
        above = round(float(np.trace(projector)))
        if not 0 < above < k:
            continue
        first = np.linalg.qr(projector @ start)[0]
        basis = np.linalg.qr(np.hstack([projector @ first[:, :above], first[:, above:] - projector @ first[:, above:]]))[0]
        up, down = basis[:, :above], basis[:, above:]
        left = np.linalg.norm(down.T @ a @ up)
        if best is None or left < best[0]:
            best = left, up, down
        if left <= 10 * k * _EPS * scale:
            break
    if best is None:  # no cut separates anything: the block is a multiple of the identity up to rounding
        return np.eye(k)[:, :1], np.eye(k)[:, 1:]
    return best[1], best[2]


def leading_components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    a = (a + a.T) / 2
    scale = np.linalg.norm(a)
    found: list[tuple[float, np.ndarray]] = []
    stack = [np.eye(len(a))]
    while stack and len(found) < most:
        basis = stack.pop()
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        rest = block - np.trace(block) / len(block) * np.eye(len(block))
        if np.linalg.norm(rest) <= 4 * len(block) * _EPS * scale:
            found += [(float(block[i, i]), basis[:, i]) for i in range(len(block))]
        else:
            up, down = _split(block, scale)
            stack += [basis @ down, basis @ up]  # blocks come in falling order, so the first ones are the largest
    found.sort(key=lambda f: -f[0])
    found = found[:most]
    return np.array([e for e, _ in found]), np.stack([v / np.linalg.norm(v) for _, v in found], axis=1) if found else np.empty((len(a), 0))


def _reduced(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], height: int, width: int) -> np.ndarray:
    """Sum over all batches of ``part`` (height x width), from one row a task and line of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = part(batch)
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["line", "cells"])

    lines = rows.mapInArrow(run, "line int, cells array<double>").groupBy("line").agg(F.array(*[F.sum(F.col("cells")[i]) for i in range(width)]).alias("cells"))
    out = np.zeros((height, width))
    for r in lines.collect():  # ``height`` rows
        out[r["line"]] = r["cells"]
    return out


def _centred(z: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sum, exact: as longs where they suffice, as Python's integers otherwise."""
    if n * max(int(np.abs(z).max(initial=0)), 1) < 1 << 61:
        return n * z - sums.astype(np.int64)
    return n * z.astype(object) - sums


def _squares(d: np.ndarray) -> list[int | None]:
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(1).tolist()
    return [x if x < 1 << 63 else None for x in (d.astype(object) ** 2).sum(1).tolist()]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024, shift: int = SHIFT) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each sound row and leading component."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sound, dims = on_grid(vectors, id_column, vector, scale)
    if not dims:
        return spark.createDataFrame([], schema)
    rows = written(sound.select("vec_id", F.transform("z", lambda x: x + shift).alias("z")), "grid")

    exact = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("z")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]).first()
    n, sums = exact["n"], np.array([int(exact[f"s{i}"]) for i in range(dims)], object)

    def deviations(batch: pa.RecordBatch) -> np.ndarray:
        return _centred(matrix(batch.column("z"), dims), n, sums)

    def second(batch: pa.RecordBatch) -> np.ndarray:
        y = deviations(batch).astype(float) / n
        return y.T @ y

    cov = _reduced(rows, second, dims, dims) / n
    values, axes = leading_components(cov, components)
    trace = float(np.trace(cov))
    live = values > dims * _EPS * max(trace, 0.0)
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    project = axes / np.sqrt(np.where(live, values, 1.0))

    def white(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        d = deviations(batch)
        return d, d.astype(float) / n @ project

    means = _reduced(rows, lambda batch: white(batch)[1].sum(0, keepdims=True), 1, len(values))[0] / n

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        w = white(batch)[1] - means
        return w.T @ w

    left = (_reduced(rows, spread, len(values), len(values)) / n - np.eye(len(values)))[np.ix_(live, live)]
    error = float(np.abs(left).max()) if live.any() else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            d, w = white(batch)
            m, k = len(w), len(values)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            squares = pa.array(_squares(d), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), squares,
                 pa.array(w.ravel(), mask=np.tile(~live, m)), pa.array(np.tile(explained, m), from_pandas=True), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
