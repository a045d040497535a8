"""Token ids in packed binary rows: best-fit-decreasing packing with segment-tree capacity search.

Each task tokenizes its documents and packs them block by block; a block holds a bounded number of tokens. Full rows
of a long document are written as they are; its rest and all short documents are packed, longest first, each into
the fullest row that still has room. A segment tree over the free room of open rows finds that row in log time. No token
is dropped, repeated or reordered within a document: pieces carry (doc_id, offset), so texts can be read back exactly.

Row: ``ids`` little-endian uint32 matrix row of ``seq_len`` (padded with ``pad_id``), ``cu_seqlens`` cumulative segment
lengths from 0, ``position_ids`` little-endian uint32 that restart at 0 with each segment, ``doc_ids`` and ``offsets``
(token offset of each segment in its document), ``n_tokens``.

Defined results: null and empty texts have no tokens and make no segment; repeated rows are packed as often as they
occur; ids may be null; other columns are ignored; an empty table gives no rows. Every document ends with the
separator token, so the packed stream shows document ends.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import as_bytes, parts

TOKENIZER_FOLDER = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
#: The split of texts before merging that the vocabulary was made with (fixed value of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQ_LEN = 2048
SEPARATOR = 50256
PAD = 50256
#: Text tokenized and packed together, and pieces remembered by a task.
BLOCK_BYTES = 8 << 20
REMEMBERED = 400_000

SCHEMA = "ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, offsets array<bigint>, n_tokens int"


class Tokenizer:
    """Byte-level BPE ids of whole texts, with a bounded memory of frequent pieces."""

    def __init__(self, folder: str = TOKENIZER_FOLDER, file: str = TOKENIZER_FILE):
        with open(os.path.join(folder, file), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        ids = np.array(self.coder.encode_ordinary(piece), np.uint32).tobytes()
        if len(piece) <= 40:
            self.seen[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text. A piece of the split starts before a space that follows one other character, so texts
        without runs of white space around spaces are cut there and looked up; others go through the tokenizer whole."""
        if "  " in text:
            return np.array(self.coder.encode_ordinary(text), np.uint32)
        first, *rest = text.split(" ")
        get, piece = self.seen.get, self._piece
        pieces = [first, *[" " + p for p in rest]]
        return np.frombuffer(b"".join([get(p) or piece(p) for p in pieces if p]), np.uint32)

    def decode(self, ids) -> str:
        return self.coder.decode([int(i) for i in ids])


class RoomTree:
    """Segment tree over free room 0..capacity: how many open rows have each room, and the least room that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int, step: int = 1) -> None:
        if step > 0:
            self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.count[node] += step
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need`` and that room; None if there is none."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.count[node]:
                    node += 1
        room = node - self.leaves
        row = self.rows[room].pop()
        self.add(room, row, -1)
        return row, room


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes into ``lengths`` (each at most ``capacity``), by best fit decreasing."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        row, room = found if found else (len(rows), capacity)
        if not found:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows


def _pack(pieces: list[tuple[int | None, int, np.ndarray]], seq_len: int, pad: int) -> Iterator[tuple]:
    for row in best_fit([len(p[2]) for p in pieces], seq_len):
        ids, positions = np.full(seq_len, pad, np.uint32), np.zeros(seq_len, np.uint32)
        bounds = [0]
        for i in row:
            size = len(pieces[i][2])
            ids[bounds[-1]:bounds[-1] + size] = pieces[i][2]
            positions[bounds[-1]:bounds[-1] + size] = np.arange(size)
            bounds.append(bounds[-1] + size)
        yield ids.tobytes(), bounds, positions.tobytes(), [pieces[i][0] for i in row], [pieces[i][1] for i in row], bounds[-1]


def _record_batches(rows: Iterator[tuple], most: int = 256) -> Iterator[pa.RecordBatch]:
    """Packed rows as Arrow batches; rows are taken only as a batch needs them."""
    while some := list(islice(rows, most)):
        ids, bounds, positions, owners, offsets, n = zip(*some)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.binary()), pa.array(bounds, pa.list_(pa.int32())), pa.array(positions, pa.binary()),
            pa.array(owners, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int64())), pa.array(n, pa.int32()),
        ], names=["ids", "cu_seqlens", "position_ids", "doc_ids", "offsets", "n_tokens"])


def pack_tokens(docs: DataFrame, seq_len: int = SEQ_LEN, folder: str = TOKENIZER_FOLDER, file: str = TOKENIZER_FILE,
                separator: int | None = SEPARATOR, pad: int = PAD) -> DataFrame:
    """Packed rows of all documents; map-only, so a lost executor repeats its own blocks and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(folder, file)
        for part in parts(batches, most=BLOCK_BYTES):
            pieces = []
            for doc, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text"))):
                if not text:
                    continue
                ids = tokenizer.encode(text.decode("utf-8", "replace"))
                if separator is not None:
                    ids = np.append(ids, np.uint32(separator))
                pieces += [(doc, at, ids[at:at + seq_len]) for at in range(0, len(ids), seq_len)]
            yield from _record_batches(_pack(pieces, seq_len, pad))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed matrix as files; readers take ``ids`` with ``numpy.frombuffer(ids, '<u4')``."""
    packed.write.mode("overwrite").parquet(path)
