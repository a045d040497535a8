"""Repeated byte strings by common-prefix intervals of a sparse enhanced suffix array.

Anchors: of the 77 places where a 24-byte string can start inside a 100-byte window, the window's anchor is the one with the least
hash. Equal windows have equal anchors at equal offsets, so every repeat of at least 100 bytes is found among suffixes
that start at anchors with equal 24-byte strings, and about one place in 39 is an anchor.

1. Count anchor hashes; keep the places of those that occur twice (a hash join, texts do not move).
2. Fetch the bytes around those places: up to 76 before, 100 from the anchor on.
3. Per anchor string, sort the suffixes, compute common-prefix lengths, and scan them with a stack into the tree of
   intervals. At each left extent the members of an interval are split by their left context; a class of two or more
   is a group of equal windows with all its occurrences. A group whose members differ in the byte before it is
   left-maximal and starts maximal repeats; ``repeat_groups`` follows them to their ends.
4. An occurrence that is not the first of its group is removed. Anchor strings with more than ``GROUP`` places are
   dealt over several tasks; what is first in a part then meets as window hashes in an aggregate.

Only bytes of a document's own row are judged and matches never cross documents.

Defined results: texts are UTF-8 bytes; null is empty; texts under 100 bytes lose nothing; null ids order before all others;
rows that share an id and the text count once as sources and get equal results; rows that share an id with
other texts are separate documents ordered by text hash; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import as_bytes, parts, written

LENGTH, GRAM = 100, 24
PLACES = LENGTH - GRAM + 1
#: Members of an anchor string that one task compares; members compared at once; bytes hashed at once.
GROUP, CHUNK, SLAB = 4000, 40_000, 4 << 20
_FIRST = -(2**63)
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each place, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    eight = None
    for step, m in zip((1, 2, 4, 8), _MULTIPLIERS):
        h = h[:-step] * m + h[step:]
        h ^= h >> np.uint64(31)
        if step == 4:
            eight = h
    h = h[:len(eight) - 16] * _MULTIPLIERS[4] + eight[16:]
    h ^= h >> np.uint64(29)
    h *= _MULTIPLIERS[1]
    return h ^ (h >> np.uint64(32))


def _hashes_at(text: bytes, places: np.ndarray) -> np.ndarray:
    """``_gram_hashes`` at some places only."""
    data = np.frombuffer(text, np.uint8)
    grams = np.lib.stride_tricks.sliding_window_view(data, GRAM)[places].ravel()
    return _gram_hashes(grams)[::GRAM].view(np.int64)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by minima from both ends of blocks."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(key)] = key
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(before[:n], after[width - 1:width - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, place, hash, first and last window start) of every run of windows that share an anchor."""
    found = []
    for at, group in _slabs(texts):
        data = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
        if len(data) < LENGTH:
            continue
        hashes = _gram_hashes(data)
        key = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        place = (_least(key, PLACES) & _LOW).astype(np.int64)
        sizes = np.array([len(t) for _, _, t in group])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(group)), sizes)[:len(place)]
        start = np.arange(len(place))
        ok = start + LENGTH <= ends[owner]
        start, place, owner = start[ok], place[ok], owner[ok]
        if not len(start):
            continue
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(start)]]) - 1
        base = (ends - sizes - np.array([o for _, o, _ in group]))[owner[first]]
        text = np.array([i for i, _, _ in group])[owner[first]]
        found.append((text, place[first] - base, hashes[place[first]].view(np.int64), start[first] - base, start[last] - base))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


def _slabs(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Pieces (text, offset, bytes) of bounded total size; pieces of a long text overlap by 99 bytes, so each window is in one."""
    group, held, n = [], 0, 0
    for i, text in enumerate(texts):
        for offset in range(0, max(len(text) - LENGTH + 1, 0), SLAB):
            piece = text[offset:offset + SLAB + LENGTH - 1]
            if held and held + len(piece) > SLAB:
                yield n, group
                group, held, n = [], 0, n + 1
            group.append((i, offset, piece))
            held += len(piece)
    if group:
        yield n, group


def prefix_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Stack scan of common-prefix lengths (``lcp[i]``: of suffixes i and i+1) into intervals (first, last, depth, depth of
    the interval around it); only those deeper than ``least - 1``."""
    out, stack = [], []
    for i, depth in enumerate([*lcp.tolist(), -1]):
        left = i
        while stack and stack[-1][1] > depth:
            left, own = stack.pop()
            around = max(depth, stack[-1][1] if stack else -1)
            if own >= least:
                out.append((left, i, own, around))
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append((left, depth))
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _sorted_lcp(group: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of members by (group, context) and common-prefix lengths of neighbours; -1 between groups."""
    keyed = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), context], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}").reshape(-1), kind="stable")
    ranked = keyed[order]
    differs = ranked[1:] != ranked[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), keyed.shape[1]) - 4
    return order, np.maximum(lcp, -1)


def equal_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(left extent, members, class, depth) for every extent at which some windows are equal.

    Members are in order of position. ``near``/``far``: least and greatest distance from a member's window starts to its
    anchor. ``left`` holds the bytes before the anchor, nearest first. Classes have two members at least.
    """
    order, lcp = _sorted_lcp(group, right)
    first, last, depth, around = prefix_intervals(lcp, GRAM)
    if not len(first):
        return
    left_order, left_lcp = _sorted_lcp(group, left)
    left_rank = np.empty(len(group), np.int64)
    left_rank[left_order] = np.arange(len(group))
    for extent in range(int(near.min()), int(far.max()) + 1):
        need = LENGTH - extent
        alive = np.flatnonzero((around < need) & (depth >= need))
        if not len(alive):
            continue
        sizes = last[alive] - first[alive] + 1
        ends = np.cumsum(sizes)
        rows = order[np.repeat(first[alive] - ends + sizes, sizes) + np.arange(ends[-1])]
        interval = np.repeat(alive, sizes)
        inside = (near[rows] <= extent) & (extent <= far[rows])
        rows, interval = rows[inside], interval[inside]
        if len(rows) < 2:
            continue
        left_class = np.concatenate([[0], np.cumsum(left_lcp < extent)])[left_rank[rows]]
        key = interval * (len(group) + 1) + left_class
        by = np.lexsort((rows, key))
        rows, key = rows[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        if many.any():
            yield extent, rows[many], number[many], depth[interval[by][many]]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the wanted anchors of each text; their window bounds come with them, so anchors are not sought again."""
    for part in parts(batches):
        ids, nodes = part.column("d").to_numpy(zero_copy_only=False), part.column("node").to_numpy(zero_copy_only=False)
        wanted = part.column("wanted")
        for i, own in enumerate(as_bytes(part.column("text"))):
            places = wanted[i].values
            for at in range(0, len(places), 50_000):
                some = places.slice(at, 50_000)
                p, n = some.field("a").to_numpy(), some.field("parts").to_numpy()
                h = _hashes_at(own, p)
                lefts = [own[max(0, x - PLACES):x][::-1] for x in p.tolist()]
                rights = [own[x:x + LENGTH] for x in p.tolist()]
                part_of = (h * 31 + int(nodes[i]) % 1_000_003 + int(ids[i]) % 999_983 + p) % n
                yield pa.RecordBatch.from_arrays([
                    pa.array(h, pa.int64()), pa.array(part_of.astype(np.int32)), pa.array(n > 1), pa.array(np.full(len(p), ids[i])), pa.array(np.full(len(p), nodes[i])), pa.array(p),
                    some.field("near").cast(pa.int32()), some.field("far").cast(pa.int32()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()),
                ], names=["h", "part", "split", "d", "node", "a", "near", "far", "left", "right"])


_MEMBER = "h bigint, part int, split boolean, d bigint, node bigint, a bigint, near int, far int, left binary, right binary"


def _matrix(column: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in column), np.uint8).reshape(-1, width)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Sorted members in bundles of whole (h, part) groups."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows < CHUNK:
            continue
        table = pa.concat_tables(held)
        h, part = table["h"].to_numpy(), table["part"].to_numpy()
        change = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1]))
        if len(change):
            cut = int(change[-1]) + 1
            yield _arrays(table.slice(0, cut))
            held = [table.slice(cut)]
            rows = table.num_rows - cut
        else:
            held = [table]
    if rows:
        yield _arrays(pa.concat_tables(held))


def _arrays(table: pa.Table) -> dict:
    place = [table[c].to_numpy() for c in ("h", "d", "node", "a")]
    same = np.logical_and.reduce([x[1:] == x[:-1] for x in place])  # the same place of a repeated row
    if same.any():
        table = table.filter(pa.array(np.concatenate([[True], ~same])))
    out = {c: table[c].to_numpy() for c in ("h", "part", "split", "d", "node", "a", "near", "far")}
    new = np.concatenate([[True], (out["h"][1:] != out["h"][:-1]) | (out["part"][1:] != out["part"][:-1])])
    left, right = table["left"].to_pylist(), table["right"].to_pylist()
    return out | {"group": np.cumsum(new) - 1, "left": _matrix(left, PLACES), "right": _matrix(right, LENGTH), "left_size": np.array([len(x) for x in left])}


def _window_hash(left: bytes, right: bytes, extent: int) -> bytes:
    return hashlib.blake2b(left[:extent][::-1] + right[:LENGTH - extent], digest_size=16).digest()


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans (``w`` null), and windows of split groups that are first in their part (``w``: their hash)."""
    for m in _bundles(batches):
        n = len(m["h"])
        repeated = np.zeros((n, PLACES + 2), np.int8)
        for extent, rows, number, _ in equal_windows(m["group"], m["left"], m["right"], m["near"], m["far"]):
            later = np.concatenate([[False], number[1:] == number[:-1]])
            repeated[rows[later], extent + 1] = 1
        edge = np.diff(repeated, axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        yield _span_batch(m["d"][row], m["node"][row], m["a"][row] - (high - 1), m["a"][row] - low + LENGTH, None)
        split = np.flatnonzero(m["split"])
        if len(split):
            extents = np.arange(PLACES)
            open_here = (extents >= m["near"][split, None]) & (extents <= m["far"][split, None]) & (repeated[split, 1:-1] == 0)
            r, e = np.nonzero(open_here)
            r = split[r]
            for at in range(0, len(r), 50_000):
                x, y = r[at:at + 50_000], e[at:at + 50_000]
                hashes = [_window_hash(m["left"][i].tobytes(), m["right"][i].tobytes(), int(k)) for i, k in zip(x, y)]
                yield _span_batch(m["d"][x], m["node"][x], m["a"][x] - y, m["a"][x] - y + LENGTH, hashes)


def _span_batch(d, node, first, last, w) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(node, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(w if w is not None else [None] * len(d), pa.binary())],
                                      names=["d", "node", "first", "last", "w"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that can start a maximal repeat: those of classes that differ in the byte before them (``w`` null), and all windows of split
    groups (``w``: their hash), since a part does not show its whole class. ``before`` is -1 at the beginning of a text."""
    for m in _bundles(batches):
        def before(rows: np.ndarray, extents) -> np.ndarray:
            return np.where(extents < m["left_size"][rows], m["left"][rows, extents].astype(np.int64), -1)

        for extent, rows, number, _ in equal_windows(m["group"], m["left"], m["right"], m["near"], m["far"]):
            own = before(rows, extent)
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            least = np.minimum.reduceat(own, starts)
            diverse = (least < 0) | (least != np.maximum.reduceat(own, starts))
            keep = diverse[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))] & ~m["split"][rows]
            rows = rows[keep]
            yield _start_batch(m["d"][rows], m["node"][rows], m["a"][rows] - extent, own[keep], None)
        split = np.flatnonzero(m["split"])
        extents = np.arange(PLACES)
        r, e = np.nonzero((extents >= m["near"][split, None]) & (extents <= m["far"][split, None]))
        for at in range(0, len(r), 50_000):
            x, y = split[r[at:at + 50_000]], e[at:at + 50_000]
            hashes = [_window_hash(m["left"][i].tobytes(), m["right"][i].tobytes(), int(k)) for i, k in zip(x, y)]
            yield _start_batch(m["d"][x], m["node"][x], m["a"][x] - y, before(x, y), hashes)


def _start_batch(d, node, first, before, w) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(node, pa.int64()), pa.array(first, pa.int64()), pa.array(before, pa.int64()), pa.array(w if w is not None else [None] * len(d), pa.binary())],
                                      names=["d", "node", "first", "before", "w"])


_PREFIX = "d bigint, node bigint, first bigint, before bigint, k bigint, length bigint, next bigint, name binary"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of what follows the wanted starts: at each multiple of 100 bytes (``k`` null), or at every length from the k-th multiple up to
    the next, with the byte that comes then (-1 at the end of the text)."""
    names = [x.split()[0] for x in _PREFIX.split(",")]
    types = [pa.int64()] * 7 + [pa.binary()]
    for part in parts(batches):
        out: list[tuple] = []
        for text, d, node, wanted in zip(as_bytes(part.column("text")), part.column("d").to_pylist(), part.column("node").to_pylist(), part.column("wanted").to_pylist()):
            for s in wanted:
                first, k = s["first"], s["k"]
                begin = LENGTH * (k or 1)
                state = hashlib.blake2b(text[first:first + begin], digest_size=16)
                step, end = (LENGTH, len(text) - first) if k is None else (1, min(len(text) - first, begin + LENGTH - 1))
                for length in range(begin, end + 1, step):
                    if length > begin:
                        state.update(text[first + length - step:first + length])
                    out.append((d, node, first, s["before"], k or length // LENGTH, length, text[first + length] if first + length < len(text) else -1, state.digest()))
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches):
        text, place, hashes, first, last = anchors(as_bytes(part.column("text")))
        near, far = (place - last).astype(np.int8), (place - first).astype(np.int8)
        ids, nodes = part.column("d").to_numpy(zero_copy_only=False), part.column("node").to_numpy(zero_copy_only=False)
        for at in range(0, len(text), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[cut]), pa.array(ids[text[cut]], pa.int64()), pa.array(nodes[text[cut]], pa.int64()), pa.array(place[cut], pa.int64()), pa.array(near[cut]), pa.array(far[cut])],
                                             names=["h", "d", "node", "a", "near", "far"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("d"), F.xxhash64(text).alias("node"), text.alias("text"))


def _sorted_members(docs: DataFrame) -> DataFrame:
    """Contexts of all repeated anchors, dealt by (anchor hash, part) and sorted by position within."""
    rows = _rows(docs).select("d", "node", "text")
    places = rows.mapInArrow(_anchor_rows, "h bigint, d bigint, node bigint, a bigint, near tinyint, far tinyint")
    repeated = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated.select("h", F.ceil(F.col("n") / GROUP).cast("int").alias("parts")), "repeated")
    wanted = places.join(repeated, "h").groupBy("d", "node").agg(F.collect_set(F.struct("a", "near", "far", "parts")).alias("wanted"))
    wanted = written(wanted, "places").select(F.col("d").alias("wd"), F.col("node").alias("wn"), "wanted")
    members = rows.join(wanted, (F.col("d") == F.col("wd")) & (F.col("node") == F.col("wn"))).select("d", "node", "text", "wanted").mapInArrow(_members, _MEMBER)
    return members.repartition("h", "part").sortWithinPartitions("h", "part", "d", "node", "a")


def repeat_groups(docs: DataFrame) -> DataFrame:
    """All maximal repeats of at least 100 bytes with all occurrences: ``group_id`` (hash of the string), ``doc_id``, ``first``, ``length``.

    A repeat is maximal if its occurrences differ in the byte before and in the byte after it; text ends differ from all. A longer
    repeat inside the occurrences of a shorter one is a group of its own. Starts come from the intervals (windows of split anchor strings meet by
    hash); hashes at multiples of 100 bytes show where a class gets smaller, and only there every length is tried.
    """
    found = written(_sorted_members(docs).mapInArrow(_starts, "d bigint, node bigint, first bigint, before bigint, w binary"), "starts")
    differ = lambda c: (F.min(c) < F.max(c)) | (F.min(c) < 0)
    windows = found.where("w is not null")
    wide = windows.groupBy("w").agg(F.count("*").alias("n"), differ("before").alias("left")).where("n > 1 and left").select("w")
    columns = ["d", "node", "first", "before"]
    starts = written(found.where("w is null").select(*columns).unionByName(windows.join(wide, "w").select(*columns)), "open_starts")
    rows = _rows(docs).select("d", "node", "text")

    def prefixes(wanted: DataFrame) -> DataFrame:
        by_text = wanted.groupBy(F.col("d").alias("wd"), F.col("node").alias("wn")).agg(F.collect_set(F.struct("first", "before", "k")).alias("wanted"))
        texts = rows.join(by_text, (F.col("d") == F.col("wd")) & (F.col("node") == F.col("wn"))).select("d", "node", "text", "wanted")
        return texts.mapInArrow(_prefixes, _PREFIX).dropDuplicates(["d", "node", "first", "length"])  # repeated rows count once

    marks = written(prefixes(starts.withColumn("k", F.lit(None).cast("bigint"))), "marks")
    counted = marks.join(marks.groupBy("name").agg(F.count("*").alias("n")), "name").where("n > 1")
    following = F.coalesce(F.lead("n").over(Window.partitionBy("d", "node", "first").orderBy("k")), F.lit(0))
    smaller = counted.select(*columns, "k", "n", following.alias("following")).where("following < n").select(*columns, "k")
    tried = written(prefixes(smaller), "prefixes")
    maximal = tried.groupBy("name").agg(F.count("*").alias("n"), differ("before").alias("left"), differ("next").alias("right")).where("n > 1 and left and right").select("name")
    return tried.join(maximal, "name").select(F.col("name").alias("group_id"), F.when(F.col("d") != _FIRST, F.col("d")).alias("doc_id"), "first", "length")


def removed_spans(docs: DataFrame) -> DataFrame:
    """``d, node, first, last`` of windows that also start earlier (runs of them joined where one anchor has them)."""
    found = written(_sorted_members(docs).mapInArrow(_spans, "d bigint, node bigint, first bigint, last bigint, w binary"), "spans")
    windows = found.where("w is not null")
    first = windows.groupBy("w").agg(F.min(F.struct("d", "node", "first")).alias("least"))
    later = windows.join(first, "w").where(F.struct("d", "node", "first") > F.col("least"))
    return found.where("w is null").select("d", "node", "first", "last").unionByName(later.select("d", "node", "first", "last"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches):
        out = []
        for text, spans in zip(as_bytes(part.column("text")), part.column("spans").to_pylist()):
            kept, at, removed, runs = [], 0, 0, 0
            end = -1
            for s in sorted((s["first"], s["last"]) for s in spans or []):
                if s[0] > end:
                    runs += 1
                if s[1] > end:
                    begin = max(s[0], end, 0)
                    kept.append(text[at:begin])
                    removed += s[1] - begin
                    at = end = s[1]
            kept.append(text[at:])
            out.append((len(text), removed, runs, b"".join(kept)))
        n, removed, runs, kept = zip(*out) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                          pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    spans = removed_spans(docs).groupBy(F.col("d").alias("sd"), F.col("node").alias("sn")).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    rows = _rows(docs)
    joined = rows.join(spans, (F.col("d") == F.col("sd")) & (F.col("node") == F.col("sn")), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
