"""Quality scores by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of width 8 run over the whole text at stride 4, activations are max-pooled over
overlapping chunks of 256 bytes (128 apart), each pooled chunk goes through a hidden layer, and mean and maximum over
all chunks give one probability. Nothing is cut: a long text has more chunks. Training takes a bounded sample of
labelled rows (least id hashes first, one row an id: at most ``SAMPLE`` rows and ``SAMPLE_BYTES`` bytes, of texts up to
``LONGEST_BYTES``), each with all its chunks; gradients run over slabs of chunks. Scoring covers every byte and runs
map-only with fixed memory.

Defined results: a null or empty text is one chunk of zero bytes; null ids are scored and not held out; repeated rows
are scored alike; an id with several labels takes the greatest; without labelled rows of both classes all
scores are the share of good labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import as_bytes, fold, parts
from packlens.llm.toxicity import training_rows

#: Bounds of the training sample: rows, bytes of all its texts, bytes of one text.
SAMPLE, SAMPLE_BYTES, LONGEST_BYTES = 4000, 32 << 20, 4 << 20
HELD_OUT_FOLDS, HELD_OUT = 3, 1
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN, HALF = 8, 8, 4, 40, 16, 128
STEPS, BATCH, RATE = 700, 32, 0.004
_PER_HALF = HALF // STRIDE
#: Bytes convolved at once while scoring, and chunks while training.
SLAB, CHUNK_SLAB = 1 << 18, 1 << 10


def _padded(text: bytes) -> np.ndarray:
    """Bytes up to a whole number of half chunks (two at least), with the last filter's reach."""
    halves = max(2, -(-len(text) // HALF))
    return np.frombuffer(text + bytes(halves * HALF - len(text) + WIDTH - STRIDE), np.uint8)


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBED)).astype(f), "w": r.normal(0, 0.15, (WIDTH * EMBED, FILTERS)).astype(f), "b": np.zeros(FILTERS, f),
            "v": r.normal(0, 0.2, (FILTERS, HIDDEN)).astype(f), "c": np.zeros(HIDDEN, f), "u": r.normal(0, 0.2, 2 * HIDDEN).astype(f), "d": np.zeros(1, f),
        }

    def _columns(self, data: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(data, WIDTH)[::STRIDE]

    def halves(self, data: np.ndarray) -> np.ndarray:
        """Max-pooled activations of each half chunk, slab by slab."""
        out = []
        for at in range(0, len(data) - WIDTH + STRIDE, SLAB):
            window = self._columns(data[at:at + SLAB + WIDTH - STRIDE])
            x = self.p["e"][window].reshape(len(window), -1) @ self.p["w"]
            out.append(x.reshape(-1, _PER_HALF, FILTERS).max(axis=1))
        return np.maximum(np.concatenate(out) + self.p["b"], 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        padded = [_padded(t) for t in texts]
        counts = np.array([(len(d) - WIDTH + STRIDE) // HALF for d in padded])
        tail = np.zeros(WIDTH - STRIDE, np.uint8)
        # texts follow each other: every text ends with the zeros that its last filter reaches
        pooled = self.halves(np.concatenate([*[d[:n * HALF] for d, n in zip(padded, counts)], tail]))
        ends = np.cumsum(counts)
        chunk = np.maximum(pooled[:-1], pooled[1:])
        hidden = np.maximum(chunk @ self.p["v"] + self.p["c"], 0)
        hidden = np.concatenate([hidden, np.zeros((1, HIDDEN), np.float32)])
        inside = np.ones(len(hidden), bool)
        inside[ends - 1] = False  # a chunk never spans two texts
        hidden[~inside] = 0
        starts = ends - counts
        mean = np.add.reduceat(hidden, starts) / (counts - 1)[:, None]
        top = np.maximum.reduceat(hidden, starts)
        return 1 / (1 + np.exp(-(np.concatenate([mean, top], axis=1) @ self.p["u"] + self.p["d"][0]).astype(np.float64)))

    def _chunks(self, text: bytes) -> np.ndarray:
        """All chunks of a text, as a view of its bytes."""
        return np.lib.stride_tricks.sliding_window_view(_padded(text), 2 * HALF + WIDTH - STRIDE)[::HALF]

    def fit(self, texts: list[bytes], y: np.ndarray, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        chunks = [self._chunks(t) for t in texts]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        while step < STEPS:
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                grads = self._gradients(np.concatenate([chunks[i] for i in rows]), np.array([len(chunks[i]) for i in rows]), y[rows])
                step += 1
                rate = RATE * max(0.1, 1 - 0.9 * step / STEPS)
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, data: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        slabs = [slice(at, at + CHUNK_SLAB) for at in range(0, len(data), CHUNK_SLAB)]
        pooled, taken = np.empty((len(data), FILTERS), np.float32), np.empty((len(data), FILTERS, WIDTH), np.uint8)
        for slab in slabs:
            window = np.lib.stride_tricks.sliding_window_view(data[slab], WIDTH, axis=1)[:, ::STRIDE]
            x = (p["e"][window].reshape(-1, WIDTH * EMBED) @ p["w"]).reshape(len(window), -1, FILTERS)
            where = x.argmax(axis=1)
            pooled[slab] = np.take_along_axis(x, where[:, None], axis=1)[:, 0] + p["b"]
            taken[slab] = window[np.arange(len(window))[:, None], where]
        a = np.maximum(pooled, 0)
        z = a @ p["v"] + p["c"]
        hidden = np.maximum(z, 0)
        starts = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(counts)), counts)
        mean, top = np.add.reduceat(hidden, starts) / counts[:, None], np.maximum.reduceat(hidden, starts)
        both = np.concatenate([mean, top], axis=1)
        g = ((1 / (1 + np.exp(-(both @ p["u"] + p["d"])))) - y) / len(y)
        g_both = np.outer(g, p["u"])
        g_hidden = (g_both[:, :HIDDEN] / counts[:, None])[doc] + g_both[doc, HIDDEN:] * (hidden == top[doc]) * (top[doc] > 0)
        g_z = g_hidden * (z > 0)
        g_a = (g_z @ p["v"].T) * (pooled > 0)
        g_w, g_e = np.zeros_like(p["w"]), np.zeros_like(p["e"])
        for slab in slabs:
            g_w += np.einsum("cf,cfk->kf", g_a[slab], p["e"][taken[slab]].reshape(-1, FILTERS, WIDTH * EMBED), optimize=True)
            back = (g_a[slab][:, :, None] * p["w"].T[None]).reshape(-1, EMBED)
            flat = taken[slab].reshape(-1)
            for k in range(EMBED):
                g_e[:, k] += np.bincount(flat, weights=back[:, k], minlength=256)
        return {"e": g_e, "w": g_w, "b": g_a.sum(axis=0), "v": a.T @ g_z, "c": g_z.sum(axis=0), "u": both.T @ g, "d": np.array([g.sum()])}


def _bounded(rows: DataFrame) -> DataFrame:
    """The rows, in order of their id hashes, that fit into the byte bounds; only sizes and ids meet in one task."""
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("n")).where(F.col("n") <= LONGEST_BYTES)
    fits = sizes.select("doc_id", upto.alias("upto")).where(F.col("upto") <= SAMPLE_BYTES)
    return rows.join(F.broadcast(fits), "doc_id", "left_semi")


def fit(rows: DataFrame) -> Network | float:
    """Network trained on the sample ``doc_id, y, text`` of at most ``SAMPLE`` rows."""
    got = sorted(_bounded(rows).select("doc_id", "y", F.encode("text", "UTF-8").alias("t")).collect())
    y = np.array([r["y"] > 0 for r in got], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    return Network().fit([bytes(r["t"]) for r in got], y)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, "quality", HELD_OUT_FOLDS, HELD_OUT, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts(batches, most=1 << 20):
            network = model.value
            score = np.clip(network.score(as_bytes(p.column("text"))), 0, 1) if isinstance(network, Network) else np.full(p.num_rows, network)
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(fold("doc_id", HELD_OUT_FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
