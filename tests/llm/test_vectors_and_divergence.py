"""Vector search, whitening and the divergence audit against brute force, on given tables and on odd rows."""

import re
from collections import Counter, defaultdict
from math import isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.llm import divergence, vector_topk, whitening

VECTORS = "vec_id bigint, embedding array<double>, row bigint, z string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, non-finite components, other lengths, repeated rows and ids, a hot vector, ties and null ids."""
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(6).tolist()) for i in range(60)]
    rows += [(100, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])] * 2 + [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25]) for i in range(200, 320)]
    rows += [(None, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25]), (None, None), (400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6)]
    rows += [(500, [float("inf")] * 6), (501, []), (600, [1.0, 2.0]), (700, [1e3, -1e3, 0.0, 0.0, 0.0, 0.0]), (800, [0.0] * 6)]
    return vectors(spark, rows)


@pytest.fixture(params=["given", "odd"])
def table(request, spark, sample, odd_vectors):
    return odd_vectors if request.param == "odd" else spark.read.parquet(f"{sample}/embeddings.parquet")


def sound(df):
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    rows = [(i, v) for i, v in rows if v and all(x is not None and isfinite(x) for x in v)]
    size = Counter(len(v) for _, v in rows).most_common(1)[0][0]
    rows = [(i, v) for i, v in rows if len(v) == size]
    return [i for i, _ in rows], np.array([[int(np.floor(1024 * float(x))) for x in v] for _, v in rows], object)


def brute_top(df, k):
    ids, z = sound(df)
    out = []
    for q, i in enumerate(ids):
        if i is not None and i % 100 == 0:
            scores = sorted(((-int(s), ids[c] is None, ids[c] or 0, ids[c]) for c, s in enumerate(z @ z[q]) if c != q), key=lambda x: x[:3])
            out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k])]
    return Counter(out)


@pytest.mark.parametrize("bucket, annulus", [(2048, 256), (7, 3)])
def test_top_k(table, monkeypatch, bucket, annulus):
    monkeypatch.setattr(vector_topk, "BUCKET", bucket)
    monkeypatch.setattr(vector_topk, "ANNULUS", annulus)
    monkeypatch.setattr(vector_topk, "SLICE", bucket)
    got = vector_topk.top_k(table, F.col("vec_id") % 100 == 0)
    assert Counter(map(tuple, got.collect())) == brute_top(table, 10)


def test_top_k_with_large_values_and_few_rows(spark):
    df = vectors(spark, [(0, [3e9, 1e9]), (1, [2e9, -5e8]), (2, [1e9, 1.5])])
    got = vector_topk.top_k(df, F.col("vec_id") % 100 == 0)
    expected = [(i, r, v, min(s, 2**63 - 1)) for i, r, v, s in brute_top(df, 10)]
    assert Counter(map(tuple, got.collect())) == Counter(expected)


def test_annuli_beyond_reach_are_not_visited(spark, monkeypatch):
    """Clusters far apart: a query meets a small part of the rows."""
    r = np.random.default_rng(0)
    centres = r.standard_normal((20, 8)) * 3
    rows = [(i, (centres[i % 20] + r.standard_normal(8) * 0.05).tolist()) for i in range(2000)]
    df = vectors(spark, rows)
    monkeypatch.setattr(vector_topk, "BUCKET", 50)
    seen = []
    real = vector_topk._expanded
    monkeypatch.setattr(vector_topk, "_expanded", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    monkeypatch.setattr(vector_topk, "SLICE", 1)
    got = vector_topk.top_k(df, F.col("vec_id") % 100 == 0)
    assert Counter(map(tuple, got.collect())) == brute_top(df, 10)
    assert seen[0] < 20 * 40 / 2  # of 20 queries and 40 buckets or more


def test_no_vectors(spark):
    for rows in ([], [(1, None)]):
        assert vector_topk.top_k(vectors(spark, rows), F.lit(True)).count() == 0
        assert whitening.whiten(vectors(spark, rows)).count() == 0


def test_whitening(table):
    ids, z = sound(table)
    x = z + 100_000
    n, s = len(x), x.sum(0)
    y = (n * x - s).astype(float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    got = whitening.whiten(table).toPandas()
    k = len(values)
    assert len(got) == n * k and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    key = lambda i: -1 if i is None or i != i else int(i)
    deviation = ((n * x - s) ** 2).sum(1)
    assert Counter(zip(map(key, got["vec_id"]), got["component"], got["deviation"])) == Counter((key(i), c + 1, int(d)) for i, d in zip(ids, deviation) for c in range(k))
    w = y @ axes / np.sqrt(values)
    for c in range(k):
        mine = got[got["component"] == c + 1]
        assert np.allclose(mine["explained"], values[c] / (y * y).sum() * n, rtol=1e-9)
        a, b = (sorted(zip(map(key, i), v)) for i, v in ((mine["vec_id"], mine["whitened"]), (ids, w[:, c])))
        flipped = sorted((i, -v) for i, v in b)
        close = [np.allclose([v for _, v in a], [v for _, v in o], atol=1e-8) for o in (b, flipped)]
        assert any(close)


def test_whitening_without_variance(spark):
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in got)
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r["component"], None if r["whitened"] is None else abs(round(r["whitened"], 9))) for r in flat if r["vec_id"] == 1) == [(1, 1.0), (2, None)]


@pytest.mark.parametrize("values", [[5, 5, 5, 2, 2, 1], [1, 1, 1, 1], [9, 0, 0, 0, 0], [2.0 ** -i for i in range(40)], [3], [4, 4 - 1e-9, 1, -2]])
def test_spectral_division(values):
    q = np.linalg.qr(np.random.default_rng(len(values)).standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(values) @ q.T
    found, axes = whitening.leading_components(a, 8)
    assert np.allclose(found, sorted(values, reverse=True)[:8], atol=1e-13 * max(values))
    assert np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-13 and np.abs(a @ axes - axes * found).max() < 1e-13 * max(values)


def test_polar_factor():
    a = np.diag([3.0, -1e-9, 0.5, -7.0])
    assert np.allclose(whitening.polar_factor(a), np.diag([1, -1, 1, -1]), atol=1e-12)


def brute_audit(df, least, top):
    rows = [(r["lang"] or "", r["source"] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))) for r in df.collect()]
    out = set()
    for lang in {r[0] for r in rows}:
        df_count, per = Counter(), defaultdict(Counter)
        for _, source, terms in (r for r in rows if r[0] == lang):
            df_count.update(set(terms))
            per[source].update(terms)
        kept = [t for t, n in df_count.items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        p, q = {s: shares(c) for s, c in per.items()}, shares(sum(per.values(), Counter()))
        for s in per:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in per if o != s))
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if per[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])}
    return out


@pytest.mark.parametrize("least, tile, block", [(30, 128, 1024), (2, 4, 16)])
def test_audit(spark, sample, odd, monkeypatch, least, tile, block):
    for name, value in (("TILE", tile), ("BLOCK", block), ("SLAB", 1000), ("HELD", 500)):
        monkeypatch.setattr(divergence, name, value)
    many = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("concat('common word', id % 7, ' Straße ÄB own', id % 13)").alias("text"), F.lit("xx").alias("lang"),
                                  F.concat(F.lit("s"), F.col("id") % 11).alias("source"))
    given = spark.read.parquet(f"{sample}/documents.parquet")
    short = odd.where("text IS NULL OR length(text) < 5000")  # small blocks of a long text are many groups
    for docs in (given, odd, many) if block == 1024 else (short, many):
        got = list(map(tuple, divergence.audit(docs, least=least, top=20).collect()))
        assert len(got) == len(set(got)) and set(got) == brute_audit(docs, least, 20)


def test_audit_of_nothing(none):
    assert divergence.audit(none).count() == 0


@pytest.mark.parametrize("rows, columns, filled", [(1, 1, 1.0), (9, 70, 0.05), (30, 17, 0.3), (16, 64, 0.0), (20, 33, 1.0)])
def test_joint_descent(rows, columns, filled):
    r = np.random.default_rng(rows)
    zero, mark = r.integers(0, 50, rows), r.random((rows, columns)) < filled
    p = np.where(mark, r.integers(0, 10**9, (rows, columns)), zero[:, None])
    expected = np.abs(p[:, None, :] - p[None, :, :]).sum(-1)
    got = divergence.pair_sums(p, mark, zero)
    assert (np.triu(got) == np.triu(expected)).all()
