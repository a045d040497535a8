"""Exact top-k search by inner product with a pivot-distance index.

Largest inner product becomes nearest neighbour: a candidate v gets one more coordinate sqrt(M^2 - |v|^2), with M the
largest norm, a query gets 0 there, and then |q' - v'|^2 = |q|^2 + M^2 - 2 q.v.

* Index. Pivots are picked farthest-first from a bounded sample (``SAMPLE`` rows with the least hashes, ``PIVOTS`` of them).
  Every row is keyed by its nearest pivot and the distance to it; rows are range-partitioned and sorted by (pivot,
  distance, row) and packed into buckets of at most ``BUCKET`` rows. A pivot with a third of all rows, or a vector that
  occurs very often, just fills more buckets, since the row number is part of the sort key.
* Home search. A query is a row of the index, so its own bucket gives it k good candidates at once, and the k-th score
  gives the radius in which all better ones must lie.
* Expansion. By the triangle inequality a row within reach r of q has a pivot distance in [d(q,p) - r, d(q,p) + r]. Queries, packed
  in slices of the same order, meet the buckets with such a ring in a join on the pivot with a range condition. Inside a
  bucket, annuli (``ANNULUS`` rows at most) are visited from the nearest bound on; the radius shrinks with each, and the visit stops
  when no query reaches the next annulus.

What moves between tasks is a bucket and a slice per pair, both of bounded size. Scores are exact integers: float64 products while
they are below 2^53, Python's integers beyond (results outside the range of long are held at its ends).

Defined results: ties go to the smaller id, a null id comes last. Rows of one id are rows of their own: each is a candidate,
each is answered if its id makes it a query, and only the query's own row is left out. Fewer than k candidates give all of them. An empty
table, or one without sound vectors, gives no rows. Vectors that ``vectors.on_grid`` leaves out take no part. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import written
from packlens.llm.vectors import matrix, on_grid

PIVOTS, SAMPLE = 64, 1024
BUCKET, SLICE, ANNULUS = 2048, 512, 256
#: Widening of every computed radius against rounding of distances.
SLACK = 1e-9

_LONGEST = np.iinfo(np.int64).max
_KINDS = {
    "long": ("bigint", pa.int64()), "int": ("int", pa.int32()), "double": ("double", pa.float64()), "binary": ("binary", pa.binary()),
    "longs": ("array<bigint>", pa.list_(pa.int64())),
    "rings": ("array<struct<pivot:int,low:double,high:double>>", pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))),
}


class _Table:
    """Columns of a packed table, as DDL for Spark and as a schema for Arrow."""

    def __init__(self, **kinds: str):
        self.ddl = ", ".join(f"{c} {_KINDS[k][0]}" for c, k in kinds.items())
        self.schema = pa.schema([(c, _KINDS[k][1]) for c, k in kinds.items()])

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(self.schema.names, r)) for r in rows], schema=self.schema)


_BUCKET = _Table(bucket="long", rows="binary", ids="binary", known="binary", asks="binary", z="binary", pivot="binary", dist="binary", runs="rings")
_QUERY = _Table(row="long", query_id="long", home="long", z="binary", dists="binary", pivot="int", dist="double", tau="long", near_ids="longs", near_scores="longs")
_SLICE = _Table(slice="long", rows="binary", ids="binary", homes="binary", z="binary", dists="binary", reach="binary", tau="binary", needs="rings")
_HIT = _Table(row="long", query_id="long", vec_id="long", score="long")


def _lifted(z: np.ndarray, bound: float) -> np.ndarray:
    z = z.astype(float)
    return np.hstack([z, np.sqrt(np.maximum(bound - (z * z).sum(1), 0))[:, None]])


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(pivots)))
    for p, pivot in enumerate(pivots):
        out[:, p] = np.sqrt(((a - pivot) ** 2).sum(1))
    return out


def _farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    chosen = [0]
    least = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _scores(q: np.ndarray, v: np.ndarray, wide: bool) -> np.ndarray:
    if not wide:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ v.astype(object).T, -_LONGEST, _LONGEST).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in order, in tables of ``most`` rows and a last shorter one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _runs(pivot: np.ndarray, dist: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Bounds of stretches of one pivot with at most ``most`` rows."""
    cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
    return [(a, min(a + most, end)) for start, end in zip(cuts, cuts[1:]) for a in range(start, end, most)]


class _Best:
    """The k best (score, id) of each query of a slice; ids that are not known come last."""

    def __init__(self, tau: np.ndarray, has: np.ndarray, k: int):
        self.k, self.tau, self.has = k, tau.copy(), has.copy()
        self.q = self.s = self.i = np.empty(0, np.int64)
        self.u = np.empty(0, bool)

    def add(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        q, s, ids, unknown = (np.concatenate(x) for x in ((self.q, q), (self.s, s), (self.i, ids), (self.u, unknown)))
        order = np.lexsort((ids, unknown, -s, q))
        q, s, ids, unknown = q[order], s[order], ids[order], unknown[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = rank < self.k
        last = rank == self.k - 1
        self.tau[q[last]] = np.where(self.has[q[last]], np.maximum(self.tau[q[last]], s[last]), s[last])
        self.has[q[last]] = True
        self.q, self.s, self.i, self.u = q[keep], s[keep], ids[keep], unknown[keep]


def _reach(norms: np.ndarray, bound: float, tau: np.ndarray, has: np.ndarray) -> np.ndarray:
    far = np.sqrt(np.maximum(norms + bound - 2.0 * tau, 0)) * (1 + SLACK) + SLACK * np.sqrt(bound + norms) + 1e-6
    return np.where(has, far, np.inf)


def _buckets(keyed: DataFrame, dims: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        for n, t in enumerate(_packed(batches, BUCKET)):
            ids = t.column("vec_id")
            pivot, dist = _column(t, "pivot"), _column(t, "dist")
            runs = [{"pivot": int(pivot[a]), "low": float(dist[a]), "high": float(dist[b - 1])} for a, b in _runs(pivot, dist, BUCKET)]
            z = matrix(t.column("z").combine_chunks(), dims).astype(np.int64)
            cells = (task + n, _column(t, "row").tobytes(), ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy().tobytes(),
                     _column(t, "asks").tobytes(), z.tobytes(), pivot.astype(np.int32).tobytes(), dist.tobytes(), runs)
            yield _BUCKET.batch([cells])

    order = ("pivot", "dist", "row")
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _BUCKET.ddl)


def _home(buckets: DataFrame, pivots: np.ndarray, bound: float, dims: int, k: int, wide: bool) -> DataFrame:
    """Each query with the best rows of its own bucket."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (r for batch in batches for r in batch.to_pylist()):
            asks = np.flatnonzero(np.frombuffer(b["asks"], bool))
            z = np.frombuffer(b["z"], np.int64).reshape(-1, dims)
            rows, ids, known = np.frombuffer(b["rows"], np.int64), np.frombuffer(b["ids"], np.int64), np.frombuffer(b["known"], bool)
            pivot, dist = np.frombuffer(b["pivot"], np.int32), np.frombuffer(b["dist"])
            for at in range(0, len(asks), 256):
                some = asks[at:at + 256]
                scores = _scores(z[some], z, wide)
                dists = _distances(np.hstack([z[some].astype(float), np.zeros((len(some), 1))]), pivots)
                out = []
                for q, i in enumerate(some):
                    order = np.lexsort((ids, ~known, -scores[q]))
                    order = order[order != i][:k]
                    out.append((int(rows[i]), int(ids[i]), b["bucket"], z[i].tobytes(), dists[q].tobytes(), int(pivot[i]), float(dist[i]),
                                int(scores[q][order[-1]]) if len(order) == k else None,
                                [int(ids[o]) if known[o] else None for o in order], [int(x) for x in scores[q][order]]))
                yield _QUERY.batch(out)

    return buckets.mapInArrow(search, _QUERY.ddl)


def _slices(queries: DataFrame, bound: float, dims: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        for n, t in enumerate(_packed(batches, SLICE)):
            z = np.stack([np.frombuffer(x, np.int64) for x in t.column("z").to_pylist()])
            dists = np.stack([np.frombuffer(x) for x in t.column("dists").to_pylist()])
            has = t.column("tau").is_valid().to_numpy()
            tau = t.column("tau").fill_null(0).to_numpy()
            reach = _reach((z.astype(float) ** 2).sum(1), bound, tau, has)
            low, high = (dists - reach[:, None]).min(0), (dists + reach[:, None]).max(0)
            needs = [{"pivot": p, "low": float(a), "high": float(b)} for p, (a, b) in enumerate(zip(low, high))]
            cells = (task + n, _column(t, "row").tobytes(), _column(t, "query_id").tobytes(), _column(t, "home").tobytes(), z.tobytes(), dists.tobytes(),
                     reach.tobytes(), tau.tobytes(), needs)
            yield _SLICE.batch([cells])

    order = ("pivot", "dist", "row")
    return queries.drop("near_ids", "near_scores").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _SLICE.ddl)


def _expanded(pairs: DataFrame, bound: float, dims: int, k: int, wide: bool) -> DataFrame:
    """Rows of a bucket that beat the home results of the queries of a slice."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (x for batch in batches for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
            z, ids, known = np.frombuffer(r["z"], np.int64).reshape(-1, dims), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
            pivot, dist = np.frombuffer(r["pivot"], np.int32), np.frombuffer(r["dist"])
            q_rows, q_ids = np.frombuffer(r["q_rows"], np.int64), np.frombuffer(r["q_ids"], np.int64)
            q = np.frombuffer(r["q_z"], np.int64).reshape(-1, dims)
            q_dists = np.frombuffer(r["q_dists"]).reshape(len(q), -1)
            reach, away = np.frombuffer(r["reach"]), np.frombuffer(r["homes"], np.int64) != r["bucket"]
            norms = (q.astype(float) ** 2).sum(1)
            best = _Best(np.frombuffer(r["tau"], np.int64), np.isfinite(reach), k)
            annuli = _runs(pivot, dist, ANNULUS)
            bounds = np.stack([np.maximum(np.maximum(q_dists[:, pivot[a]] - dist[b - 1], dist[a] - q_dists[:, pivot[a]]), 0) for a, b in annuli])
            bounds[:, ~away] = np.inf
            for n in np.argsort(bounds.min(1), kind="stable"):
                active = np.flatnonzero(away & (bounds[n] <= reach))
                if not len(active):
                    if bounds[n].min() > reach.max():
                        break
                    continue
                a, b = annuli[n]
                scores = _scores(q[active], z[a:b], wide)
                x, y = np.nonzero((scores >= best.tau[active][:, None]) | ~best.has[active][:, None])
                best.add(active[x], scores[x, y], ids[a + y], ~known[a + y])
                reach = _reach(norms, bound, best.tau, best.has)
            yield pa.RecordBatch.from_arrays([pa.array(q_rows[best.q]), pa.array(q_ids[best.q]), pa.array(best.i, mask=best.u), pa.array(best.s)], names=_HIT.schema.names)

    return pairs.mapInArrow(search, _HIT.ddl)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k rows with the largest inner product, for each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    sound, dims = on_grid(vectors, id_column, vector, scale, keep=[F.coalesce(is_query, F.lit(False)).alias("asks")])
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = written(sound.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")
    square = F.aggregate("z", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    bound = rows.agg(F.max(square)).first()[0] * (1 + 1e-12)
    wide = bound >= 2.0 ** 52
    sample = rows.orderBy(F.xxhash64("z", "row")).limit(SAMPLE).select("z").toArrow().column("z").combine_chunks()
    pivots = _farthest_first(_lifted(matrix(sample, dims), bound), PIVOTS)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lifted(matrix(batch.column("z"), dims), bound), pivots)
            nearest = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])], names=[*batch.schema.names, "pivot", "dist"])

    keyed = written(rows.mapInArrow(key, "row long, vec_id long, z array<bigint>, asks boolean, pivot int, dist double"), "keyed")
    buckets = written(_buckets(keyed, dims), "buckets")
    queries = written(_home(buckets, pivots, bound, dims, k, wide), "queries")
    slices = written(_slices(queries, bound, dims), "slices")

    rings = buckets.select("bucket", F.inline("runs")).toDF("bucket", "pivot", "inner", "outer")
    needs = slices.select("slice", F.inline("needs"))
    pairs = needs.join(rings, "pivot").where("outer >= low AND inner <= high").select("slice", "bucket").distinct()
    asked = slices.select("slice", F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), "homes", F.col("z").alias("q_z"), F.col("dists").alias("q_dists"), "reach", "tau")
    met = pairs.join(buckets.select("bucket", "ids", "known", "z", "pivot", "dist"), "bucket").join(asked, "slice")
    away = written(_expanded(met, bound, dims, k, wide), "hits")
    home = queries.select("row", "query_id", F.inline(F.arrays_zip("near_ids", "near_scores"))).toDF("row", "query_id", "vec_id", "score")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
