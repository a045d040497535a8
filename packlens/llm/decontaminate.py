"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed once, whatever the benchmark: each task turns its documents into index segments (terms,
posting lists of word positions, document bounds) and writes them. A search reads corpus frequencies of the test
terms from the index, then intersects the offset-adjusted posting lists of every window, rarest term first, inside
each segment. Documents are never shuffled, and a segment holds whole documents, so no phrase is cut.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Terms are known by a 64-bit hash.

Defined results: a null or empty text has no words and is never contaminated; each row is judged by itself, so
repeated rows and repeated ids give repeated results; null ids stay null; other columns are ignored; an empty
benchmark hits nothing; items with equal windows are all reported; null items have no words; rows of one item_id are one item, and those
without an id (null or empty) are one item with an empty name, which counts like others.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import as_bytes, parts, written

WINDOW = 13
#: Text in one segment, and benchmark text held by a task at once; a larger benchmark is searched block by block.
SEGMENT_BYTES = 1 << 20
BENCHMARK_BLOCK_BYTES = 2 << 20
#: Blocks whose hits one job unites before they are written.
BLOCKS_A_JOB = 8
#: Proximity: the three rarest terms of a window within this many words more than the window has.
SLOP = 4
#: Listed proximity matches (:func:`matches`): the share of a window's words that must stand within ``DRIFT`` words of their place.
SHARE, DRIFT = 0.75, 2
_CANDIDATES = 1 << 18

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD_BYTES else 0x20) for c in range(256))
_INDEX = ("doc_ids array<bigint>, nodes array<bigint>, starts array<int>, terms binary, counts binary, positions binary")
_STATE = "cover binary, items array<array<string>>, n_near array<bigint>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, most=SEGMENT_BYTES):
        own: dict[bytes, int] = {}
        ids, starts = [], [0]
        for text in as_bytes(part.column("text")):
            ids.extend([own.setdefault(w, len(own)) for w in words_of(text)])
            starts.append(len(ids))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in own), np.uint64, len(own))
        by_hash = np.argsort(hashes)
        rank = np.empty(len(own), np.int64)
        rank[by_hash] = np.arange(len(own))
        terms = rank[np.array(ids, np.int64)] if ids else np.empty(0, np.int64)
        postings = np.argsort(terms, kind="stable").astype(np.int32)
        counts = np.bincount(terms, minlength=len(own)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("node").to_pylist()], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int32())),
            pa.array([hashes[by_hash].tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
            pa.array([zstandard.compress(np.diff(postings, prepend=np.int32(0)).tobytes(), 1)], pa.binary()),
        ], names=["doc_ids", "nodes", "starts", "terms", "counts", "positions"])


def build_index(docs: DataFrame) -> DataFrame:
    """Index segments of ``doc_id, text`` rows, to be written once and searched by any number of benchmarks."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    return rows.mapInArrow(_segments, _INDEX)


class Block:
    """Windows of a bounded part of the benchmark, with each window's terms ordered rarest first."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        own: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[int, int, list[int]]]] = {}
        self.names = [name for name, _ in items]
        for item, (_, text) in enumerate(items):
            ids = [own.setdefault(w, len(own)) for w in words_of(text)]
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if size else 0):
                by_length.setdefault(size, []).append((item, start, ids[start:start + size]))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in own), np.uint64, len(own))
        order = np.argsort(hashes)
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        self.terms = hashes[order]
        self.windows = [(n, np.array([i for i, _, _ in rows], np.int64), rank[np.array([w for _, _, w in rows], np.int64)], None)
                        for n, rows in sorted(by_length.items())]
        self.starts = {n: np.array([s for _, s, _ in rows], np.int64) for n, rows in by_length.items()}

    def ranked(self, frequency: dict[int, int]) -> Block:
        seen = np.array([frequency.get(int(np.int64(t.view(np.int64))), 0) for t in self.terms], np.int64)
        self.windows = [(n, item, terms, np.argsort(seen[terms], axis=1, kind="stable")) for n, item, terms, _ in self.windows]
        return self


def _intersect(segment: dict, block: Block, slop: int) -> tuple[np.ndarray, list[set[str]], np.ndarray]:
    """Covered words, items by document and proximity matches by document of one segment."""
    starts = np.array(segment["starts"], np.int64)
    n_docs, n_words = len(starts) - 1, int(starts[-1])
    cover, items, near = np.zeros(n_words + 1, np.int32), [set() for _ in range(n_docs)], np.zeros(n_docs, np.int64)
    terms = np.frombuffer(segment["terms"], np.uint64)
    if not len(terms) or not len(block.terms):
        return cover[:n_words] > 0, items, near
    counts = np.frombuffer(segment["counts"], np.int32).astype(np.int64)
    postings = np.cumsum(np.frombuffer(zstandard.decompress(segment["positions"]), np.int32), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(np.arange(len(terms)), counts)
    term_at = np.empty(n_words, np.int64)
    term_at[postings] = at
    keys = at * (n_words + 1) + postings
    place = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
    local = np.where(terms[place] == block.terms, place, -1)
    for size, item, windows, order in block.windows:
        mine = local[windows]
        rare = np.take_along_axis(mine, order[:, :3], axis=1)
        some = np.flatnonzero((rare >= 0).all(axis=1))
        if not len(some):
            continue
        lead = rare[some, 0]
        many = counts[lead]
        window = np.repeat(some, many)
        ends = np.cumsum(many)
        lists = np.repeat(first[lead] - np.concatenate([[0], ends[:-1]]), many) + np.arange(ends[-1])
        position = postings[lists]
        doc = np.searchsorted(starts, position, side="right") - 1
        exact = (mine >= 0).all(axis=1)[window]
        begin = position - order[window, 0]
        exact &= (begin >= starts[doc]) & (begin + size <= starts[doc + 1])
        for k in range(1, size):
            left = np.flatnonzero(exact)
            offset = order[window[left], k]
            exact[left] = term_at[begin[left] + offset] == mine[window[left], offset]
        hit = np.flatnonzero(exact)
        np.add.at(cover, begin[hit], 1)
        np.add.at(cover, begin[hit] + size, -1)
        for d, i in set(zip(doc[hit].tolist(), item[window[hit]].tolist())):
            items[d].add(block.names[i])
        close = np.flatnonzero(~exact)
        reach = size - 1 + slop
        for k in range(1, min(3, size)):
            term = rare[:, k][window[close]]
            low = np.maximum(position[close] - reach, starts[doc[close]])
            found = np.searchsorted(keys, term * (n_words + 1) + low)
            high = np.minimum(position[close] + reach, starts[doc[close] + 1] - 1)
            close = close[(found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] <= term * (n_words + 1) + high)]
        np.add.at(near, doc[close], 1)
    return np.cumsum(cover)[:n_words] > 0, items, near


def _search(block, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                segment = one.to_pylist()[0]
                cover, items, near = _intersect(segment, block.value, slop)
                if segment["cover"] is not None:
                    cover = cover | np.unpackbits(np.frombuffer(segment["cover"], np.uint8), count=len(cover)).astype(bool)
                    items = [a | set(b) for a, b in zip(items, segment["items"])]
                    near = near + np.array(segment["n_near"], np.int64)
                keep = [one.column(c) for c in ("doc_ids", "nodes", "starts", "terms", "counts", "positions")]
                yield pa.RecordBatch.from_arrays([
                    *keep, pa.array([np.packbits(cover).tobytes()], pa.binary()),
                    pa.array([[sorted(x) for x in items]], pa.list_(pa.list_(pa.string()))), pa.array([near.tolist()], pa.list_(pa.int64())),
                ], names=["doc_ids", "nodes", "starts", "terms", "counts", "positions", "cover", "items", "n_near"])
    return run


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment in batch.to_pylist():
            starts = np.array(segment["starts"], np.int64)
            n = np.diff(starts)
            cover = np.unpackbits(np.frombuffer(segment["cover"], np.uint8), count=int(starts[-1])).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(cover)])
            hit = total[starts[1:]] - total[starts[:-1]]
            items = segment["items"]
            yield pa.RecordBatch.from_arrays([
                pa.array(segment["doc_ids"], pa.int64()), pa.array(segment["nodes"], pa.int64()), pa.array(n), pa.array(hit), pa.array([len(x) for x in items], pa.int64()),
                pa.array(items, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                pa.array(segment["n_near"], pa.int64()), pa.array((hit > 0) & (20 * hit >= n)),
            ], names=["doc_id", "node", "n_words", "n_hit", "n_items", "item_ids", "items_sha256", "n_near", "contaminated"])


def _frequencies(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms.value), np.int64)
        for batch in batches:
            for own, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                own, counts = np.frombuffer(own, np.uint64), np.frombuffer(counts, np.int32)
                if len(own):
                    place = np.minimum(np.searchsorted(own, terms.value), len(own) - 1)
                    total += np.where(own[place] == terms.value, counts[place], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms.value[some].view(np.int64)), pa.array(total[some])], names=["term", "n"])
    return run


def _near(block, share: float, drift: int):
    """Matches of one segment after another, see :func:`matches`."""

    def found(segment: dict, block: Block) -> Iterator[tuple]:
        starts, terms = np.array(segment["starts"], np.int64), np.frombuffer(segment["terms"], np.uint64)
        if not len(terms) or not len(block.terms):
            return
        n_words, counts = int(starts[-1]), np.frombuffer(segment["counts"], np.int32).astype(np.int64)
        postings = np.cumsum(np.frombuffer(zstandard.decompress(segment["positions"]), np.int32), dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        keys = np.repeat(np.arange(len(terms)), counts) * (n_words + 1) + postings
        place = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
        local = np.where(terms[place] == block.terms, place, -1)
        for size, item, windows, order in block.windows:
            mine, need, most = local[windows], math.ceil(share * size), {}
            enough = (mine >= 0).sum(axis=1) >= need
            for r in range(size - need + 1):
                lead = mine[np.arange(len(mine)), order[:, r]]
                some = np.flatnonzero(enough & (lead >= 0))
                for low, high in _ranges(counts[lead[some]]):
                    own, many = some[low:high], counts[lead[some[low:high]]]
                    window, ends = np.repeat(own, many), np.cumsum(many)
                    position = postings[np.repeat(first[lead[own]] - ends + many, many) + np.arange(ends[-1])]
                    doc, begin = np.searchsorted(starts, position, side="right") - 1, position - order[window, r]
                    seen = straight = np.zeros(len(window), np.int64)
                    for k in range(size):
                        term, least = mine[window, k], np.maximum(begin + k - drift, starts[doc])
                        at = np.minimum(np.searchsorted(keys, term * (n_words + 1) + least), len(keys) - 1)
                        last = term * (n_words + 1) + np.minimum(begin + k + drift, starts[doc + 1] - 1)
                        there = (term >= 0) & (keys[at] >= term * (n_words + 1) + least) & (keys[at] <= last)
                        exact = term * (n_words + 1) + begin + k
                        at = np.minimum(np.searchsorted(keys, exact), len(keys) - 1)
                        seen, straight = seen + there, straight + (there & (keys[at] == exact))
                        left = seen + size - 1 - k >= need
                        window, doc, begin, seen, straight = window[left], doc[left], begin[left], seen[left], straight[left]
                    for d, w, p, n, whole in zip(doc.tolist(), window.tolist(), begin.tolist(), seen.tolist(), (straight == size).tolist()):
                        most[d, w, p] = n, whole
            for (d, w, p), (n, whole) in most.items():
                yield segment["doc_ids"][d], segment["nodes"][d], block.names[item[w]], int(block.starts[size][w]), p - int(starts[d]), n, whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "node", "item_id", "window_start", "position", "n_terms", "exact"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            for row in range(batch.num_rows):
                rows = found(batch.slice(row, 1).to_pylist()[0], block.value)
                while some := list(itertools.islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names=names)
    return run


def _ranges(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of windows with about ``_CANDIDATES`` postings each."""
    start = held = 0
    for i, n in enumerate(many.tolist()):
        if held and held + n > _CANDIDATES:
            yield start, i
            start, held = i, 0
        held += n
    if held:
        yield start, len(many)


def _blocks(index: DataFrame, benchmark: DataFrame, window: int) -> Iterator:
    """The benchmark in blocks of a fixed size, each broadcast with its terms ranked by their frequency in the corpus."""
    context = index.sparkSession.sparkContext
    test = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = test.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = 1 + size // BENCHMARK_BLOCK_BYTES
    for k in range(n_blocks):
        rows = test.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").collect()
        block = Block([(r["item_id"], r["text"].encode()) for r in rows], window)
        counted = index.select("terms", "counts").mapInArrow(_frequencies(context.broadcast(block.terms)), "term bigint, n bigint")
        frequency = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        yield context.broadcast(block.ranked(frequency))


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Exact phrase matches and the number of proximity matches of every benchmark window, one row per indexed document.

    A document is contaminated if at least a twentieth of its words lie in exact matches. The benchmark goes to the
    tasks in blocks of a fixed size; what earlier blocks covered travels with the segments, so hits are united, and is written after some blocks.
    """
    state = index.selectExpr("*", "cast(null as binary) as cover", "cast(null as array<array<string>>) as items", "cast(null as array<bigint>) as n_near")
    for k, block in enumerate(_blocks(index, benchmark, window)):
        if k and k % BLOCKS_A_JOB == 0:
            state = written(state, "hits")
        state = state.mapInArrow(_search(block, slop), f"{_INDEX}, {_STATE}")
    return state.mapInArrow(_verdicts, "doc_id bigint, node bigint, n_words bigint, n_hit bigint, n_items bigint, item_ids array<string>, items_sha256 string, n_near bigint, contaminated boolean")


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """Phrase and proximity matches as rows: ``doc_id, node, item_id, window_start, position, n_terms, exact``.

    A window laid at word ``position`` of a document (negative where its first words are cut off) matches if at least ``share`` of its words
    stand within ``drift`` words of their places, one of its rarest terms exactly on its place. That many words can't all miss the
    n - need + 1 rarest terms, so only their posting lists are read, offset-adjusted, the rarest first. ``exact`` marks phrases. Null ids stay;
    ``node`` (hash of the text) tells rows of one id apart; equal rows give equal matches.
    """
    rows = [index.mapInArrow(_near(block, share, drift), "doc_id bigint, node bigint, item_id string, window_start bigint, position bigint, n_terms bigint, exact boolean")
            for block in _blocks(index, benchmark, window)]
    return functools.reduce(DataFrame.unionByName, rows)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Index the documents and judge them all."""
    return search(written(build_index(docs), "postings"), benchmark)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without the contaminated ones; an id and a text (by hash) name a row, so other texts under its id stay."""
    found = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("found_id"), F.col("node").alias("found_node")).distinct()
    found = written(found, "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(found["found_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["found_node"])
    return docs.join(found, same, "left_anti")
