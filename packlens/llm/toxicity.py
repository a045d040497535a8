"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon is learned: hashed 5-byte grams of lower-cased text whose document frequency in toxic training
rows exceeds that in the others by a clear margin. Dense features per whole text: lexicon densities, hits near a
second-person word, capitals, punctuation, letters broken by digits or signs (obfuscation) and length. Lexicon,
trees and calibration are fitted on a bounded sample of labelled training rows (``SAMPLE`` rows by hash of the
id), each half through the other half's fits; every document is scored where it lies, in one map pass.

Defined results: a null or empty text has zero features and gets the score those have; null ids are scored and not
held out; repeated rows are scored alike; an id with several labels counts as toxic if any label is; without
labelled rows of both classes all scores are the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import as_bytes, fold, parts, written

#: Labelled rows used for fitting, at most; entries of the lexicon, at most.
SAMPLE, LEXICON = 15_000, 4096
HELD_OUT_FOLDS = 5
BITS = 20
NEAR = 48
ROUNDS, DEPTH, RATE, BINS, LEAST_LEAF = 80, 3, 0.15, 64, 5

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x61 and c <= 0x7A or c >= 0x80 or 0x30 <= c <= 0x39 else 0x20 for c in range(256))
_GAP = b" " * 6
#: Second-person words of the four languages, with their surrounding spaces, cut to five bytes.
_SECOND = [b" you ", b" your", b" dich", b" dein", b" vous", b" toi ", b" tes ", b" sie ", b" du ", b" tu ", b" te ", b" ton ", b" tus ", b" usted"]
FEATURES = ("strong_density", "strong_hits", "weak_density", "weak_hits", "weight_mean", "weight_max", "near_second_person", "capitals", "punctuation", "obfuscation", "log_length")


def _codes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes that start at each place."""
    n = len(data) - size + 1
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code |= data[k:k + n].astype(np.uint64) << np.uint64(8 * k)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _table(words: list[bytes], size: int) -> np.ndarray:
    table = np.zeros(1 << BITS, bool)
    for w in words:
        if len(w) >= size:
            table[_codes(np.frombuffer(w[:size], np.uint8), size)] = True
    return table


_SECOND_5, _SECOND_4 = _table(_SECOND, 5), _table([w for w in _SECOND if len(w) == 4], 4)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts between gaps, and where each begins."""
    starts = np.cumsum([0] + [len(t) + len(_GAP) for t in texts])
    return np.frombuffer(_GAP + _GAP.join(texts) + _GAP, np.uint8), starts


def features(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Dense features of whole texts; ``weights`` is the lexicon as a table of gram weights (0: not in it)."""
    raw, starts = _joined(texts)
    data = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    sums = lambda x: np.add.reduceat(np.concatenate([x, np.zeros(len(raw) - len(x) + 1, x.dtype)]).astype(np.float64), starts[:-1])[:len(texts)]
    length = np.maximum(np.diff(starts) - len(_GAP), 1).astype(np.float64)
    code = _codes(data, 5)
    weight = weights[code]
    strong, weak = weight >= 4, weight > 0
    pronoun = np.zeros(len(data) + 1, np.int32)
    pronoun[1:len(code) + 1] += _SECOND_5[code]
    four = _SECOND_4[_codes(data, 4)]
    pronoun[1:len(four) + 1] += four
    pronoun = np.cumsum(pronoun)
    place = np.flatnonzero(weak)
    near = np.zeros(len(weak), bool)
    near[place] = pronoun[np.minimum(place + NEAR, len(data))] > pronoun[np.maximum(place - NEAR, 0)]
    letter = ((raw | 32) >= 0x61) & ((raw | 32) <= 0x7A)
    sign = np.isin(raw, np.frombuffer(b"0123456789@$*!+", np.uint8))
    capitals = (raw >= 0x41) & (raw <= 0x5A)
    punctuation = (raw == 0x21) | (raw == 0x3F)
    broken = np.zeros(len(raw), bool)
    broken[1:-1] = letter[:-2] & sign[1:-1] & letter[2:]
    n_strong, n_weak, n_near = sums(strong), sums(weak), sums(near)
    top = np.maximum.reduceat(np.concatenate([weight, np.zeros(len(raw) - len(weight) + 1)]), starts[:-1])[:len(texts)] if texts else np.zeros(0)
    return np.column_stack([
        n_strong / length, np.log1p(n_strong), n_weak / length, np.log1p(n_weak), sums(weight) / np.maximum(n_weak, 1), top, n_near / np.maximum(n_weak, 1),
        sums(capitals) / length, sums(punctuation) / length, sums(broken) / length, np.log(length),
    ])


class Trees:
    """Boosted regression trees on binned features under log loss."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += RATE * self._walk(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        at = np.zeros(len(binned), int)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            g, h = gradient[rows], curvature[rows]
            value[node] = g.sum() / (h.sum() + 1)
            if node >= 2**DEPTH - 1 or len(rows) < 2 * LEAST_LEAF:
                continue
            best = 1e-3
            for j in range(binned.shape[1]):
                b = binned[rows, j]
                left_g, left_h, left_n = (np.cumsum(np.bincount(b, weights=w, minlength=BINS))[:-1] for w in (g, h, np.ones(len(b))))
                gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(left_n < LEAST_LEAF) | (len(b) - left_n < LEAST_LEAF)] = 0
                if len(gain) and gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), j, int(gain.argmax())
            if feature[node] >= 0:
                at[rows] = np.where(binned[rows, feature[node]] <= cut[node], 2 * node + 1, 2 * node + 2)
        return feature, cut, value

    @staticmethod
    def _walk(tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(binned), int), np.arange(len(binned))
        for _ in range(DEPTH):
            f = feature[at]
            step = np.where(binned[rows, np.maximum(f, 0)] <= cut[at], 2 * at + 1, 2 * at + 2)
            at = np.where(f >= 0, step, at)
        return value[at]

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + RATE * sum((self._walk(t, binned) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Monotone map from margins to shares, by pooling adjacent violators; linear between block centres."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        blocks: list[list[float]] = []
        for m in np.unique(margin):
            mine = y[margin == m]
            blocks.append([m * len(mine), mine.sum(), len(mine)])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x = np.array([b[0] / b[2] for b in blocks])
        self.y = np.array([(b[1] + 0.01) / (b[2] + 0.02) for b in blocks])
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """``doc_id, y, text`` of a bounded sample of labelled rows outside the held-out fold, least id hash first.

    An id gives one row: of several texts under it, the least.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held))
    known = known.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = known.orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))
    return written(joined.groupBy("doc_id", "y").agg(F.min("text").alias("text")), f"training_{label}")


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((4, 1 << BITS), np.int64)
    for p in parts(batches):
        for text, y, half in zip(as_bytes(p.column("text")), p.column("y").to_pylist(), p.column("half").to_pylist()):
            raw, _ = _joined([text])
            total[2 * half + int(y > 0), np.unique(_codes(np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8), 5))] += 1
    some = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(x[some]) for x in total]], names=["gram", "c0", "t0", "c1", "t1"])


def _lexicon(counts: DataFrame, toxic: str, clean: str, a: float, b: float) -> np.ndarray:
    """Table of gram weights: log odds ratios of the grams whose share of toxic documents is clearly the greater one."""
    table = np.zeros(1 << BITS, np.float32)
    if not a or not b:
        return table
    counts = counts.select("gram", F.expr(toxic).alias("t"), F.expr(clean).alias("c")).where((F.col("t") >= 3) & (F.col("t") >= 0.01 * a))
    odds = F.log((F.col("t") + 0.5) / (a - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (b - F.col("c") + 0.5))
    both = (F.col("t") + F.col("c")) / (a + b)
    error = F.greatest(F.sqrt(both * (1 - both) * (1 / a + 1 / b)), F.lit(1e-9))
    scored = counts.select("gram", odds.alias("w"), ((F.col("t") / a - F.col("c") / b) / error).alias("z"))
    for r in scored.where("z >= 5 and w >= 1.5").orderBy(F.desc("z"), "gram").limit(LEXICON).collect():
        table[r["gram"]] = r["w"]
    return table


def fit(rows: DataFrame) -> tuple:
    """(lexicon table, trees, calibration) of sampled rows, cross-fitted.

    Each half (by hash of the id, unlike the held-out split) gets its features from the other half's lexicon and its
    calibration margins from the other half's trees; what scores documents is then fitted on both.
    """
    share = rows.agg(F.avg("y")).first()[0]
    if not share or share == 1:
        return None, None, float(share or 0)
    rows = rows.select("text", "y", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int").alias("half"))
    n = {(r["half"], r["y"] > 0): float(r["count"]) for r in rows.groupBy("half", "y").count().collect()}
    schema = "gram bigint, c0 bigint, t0 bigint, c1 bigint, t1 bigint"
    counts = written(rows.mapInArrow(_gram_counts, schema).groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")]), "grams")
    of = lambda half, toxic: n.get((half, toxic), 0.0)
    halves = [_lexicon(counts, f"t{h}", f"c{h}", of(h, True), of(h, False)) for h in (0, 1)]
    context = rows.sparkSession.sparkContext
    table = context.broadcast(_lexicon(counts, "t0 + t1", "c0 + c1", of(0, True) + of(1, True), of(0, False) + of(1, False)))
    other = context.broadcast(halves[::-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts(batches):
            half = p.column("half").to_pylist()
            texts = as_bytes(p.column("text"))
            x = [features([t], other.value[h])[0] for t, h in zip(texts, half)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), p.column("y"), p.column("half")], names=["x", "y", "half"])

    got = rows.mapInArrow(run, "x array<double>, y int, half int").toPandas()
    x, y, half = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES)), got["y"].to_numpy(float), got["half"].to_numpy()
    margins = np.zeros(len(y))
    for h in (0, 1):
        if (half == h).any():
            own = half != h if len(set(y[half != h])) == 2 else np.ones(len(y), bool)
            margins[half == h] = Trees().fit(x[own], y[own]).margins(x[half == h])
    return table, Trees().fit(x, y), Isotonic().fit(margins, y)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    table, trees, calibration = fit(training_rows(docs, labels, "toxic", HELD_OUT_FOLDS, 0, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts(batches):
            n = p.num_rows
            score = np.clip(calibration(trees.margins(features(as_bytes(p.column("text")), table.value))), 0, 1) if trees else np.full(n, calibration)
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(fold("doc_id", HELD_OUT_FOLDS) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
