"""Source divergence audit over a K-squared quadtree of the group-term count matrix.

Groups are the (lang, source) pairs, terms those that at least ``LEAST`` documents of the language hold. Counts are taken in one map
pass that adds up per task before anything is shuffled, then meet by (lang, term), so a source with a third of all rows is
no hot key: it brings one row a task and term.

The count matrix of a language is cut into blocks of about ``BLOCK`` terms (by term hash) and, where a language has more than
``TILE`` sources, into tiles of two runs of sources. For each block a K-squared tree (K = 2) is built bottom up: a quadrant's bit says
whether any cell in it is not zero. Pairs of groups are compared by walking pairs of row quadrants down jointly. Where both are empty, every
term of the quadrant differs by the same amount, that of the two groups' shares for a count of zero, so it is priced as
width times that amount without going down. Only leaves (``LEAF`` x ``LEAF`` cells) that hold a count for at least one side are
computed cell by cell. Terms of the language that no group of a tile holds are priced once at the end.

Shares are p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in exact integer arithmetic.

Defined results: null text, lang and source read as ''. A group without kept terms, or with no terms at all, is still a group. A language of
one source has no pairs; a language without kept terms has pairs of value 0 and no terms. Ties rank by the item's bytes. Repeated rows and rows
of one id each count as documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import as_bytes, written

LEAST, TOP, UNIT, PRIOR = 30, 50, 1_000_000_000, 5
BLOCK, TILE, LEAF = 1024, 128, 8
#: Bytes of a text taken at once, and entries a task holds before it passes them on.
SLAB, HELD = 1 << 20, 500_000

#: Bytes of terms keep themselves, A-Z in lower case; all others part terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _slabs(text: bytes, most: int) -> Iterator[list[bytes]]:
    """Terms of a text, slab by slab; a slab ends at a byte that parts terms."""
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        while end < len(text) and _FOLD[text[end]] != 0x20:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df`` with partial counts of tasks; each (lang, source) also has a row with term null."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in counts.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    some = terms[i:i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                         pa.array([n[t] for t in some], pa.int64()), pa.array([df[t] for t in some], pa.int64())], schema=schema)
                yield pa.RecordBatch.from_pylist([{"lang": lang, "source": source, "term": None, "n": 0, "df": 0}], schema=schema)

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), as_bytes(batch.column("text"))):
                n, df = counts.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in _slabs(text, SLAB):
                    n.update(terms)
                    own.update(terms)
                df.update(own)
                held += len(n) - before
                if held > HELD:
                    yield from passed_on()
                    counts, held = {}, 0
        yield from passed_on()

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(run, "lang string, source string, term string, n long, df long")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact."""
    over = (count + PRIOR).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", over, (total + PRIOR * kept).cast("decimal(20,0)")) + 1


def tree_levels(filled: np.ndarray) -> list[np.ndarray]:
    """K-squared tree of a matrix of booleans, leaves first: each level says which quadrants of the one below are not empty."""
    levels = [filled]
    while max(levels[-1].shape) > 1:
        below = levels[-1]
        below = np.pad(below, [(0, s % 2) for s in below.shape])
        levels.append(below[::2, ::2] | below[1::2, ::2] | below[::2, 1::2] | below[1::2, 1::2])
    return levels


def pair_sums(p: np.ndarray, filled: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Sum over columns of |p_g - p_h| for all pairs of rows g, h, by joint descent; empty cells of row g hold ``zero[g]``.

    Only pairs of leaf rows a <= b are walked, so the lower triangle is filled for pairs inside one leaf row only.
    """
    rows, columns = p.shape
    high, wide = -(-rows // LEAF), -(-columns // LEAF)
    padded = np.zeros((high * LEAF, wide * LEAF), np.int64)
    padded[:rows, :columns] = p
    cells = padded.reshape(high, LEAF, wide, LEAF).transpose(0, 2, 1, 3)
    mark = np.zeros((high * LEAF, wide * LEAF), bool)
    mark[:rows, :columns] = filled
    levels = tree_levels(mark.reshape(high, LEAF, wide, LEAF).any((1, 3)))
    widths = [np.minimum(LEAF, columns - LEAF * np.arange(wide))]
    for _ in levels[1:]:
        w = np.pad(widths[-1], (0, len(widths[-1]) % 2))
        widths.append(w[::2] + w[1::2])
    empty = np.zeros((high, high), np.int64)  # columns priced as empty, by leaf rows
    total = np.zeros((high, high, LEAF, LEAF), np.int64)
    a = b = c = np.zeros(1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        bits = levels[level]
        alive = bits[a, c] | bits[b, c]
        for x, y, w in zip(a[~alive], b[~alive], widths[level][c[~alive]]):
            empty[x << level:(x + 1) << level, y << level:(y + 1) << level] += w
        a, b, c = a[alive], b[alive], c[alive]
        if level:
            below = levels[level - 1].shape
            a, b, c = (np.concatenate(x) for x in zip(*[(2 * a + i, 2 * b + j, 2 * c + k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
            inside = (a < below[0]) & (b < below[0]) & (c < below[1]) & (a <= b)
            a, b, c = a[inside], b[inside], c[inside]
    for at in range(0, len(a), 2048):
        x, y, z = a[at:at + 2048], b[at:at + 2048], c[at:at + 2048]
        np.add.at(total, (x, y), np.abs(cells[x, z][:, :, None, :] - cells[y, z][:, None, :, :]).sum(-1))
    zeros = np.zeros(high * LEAF, np.int64)
    zeros[:rows] = zero
    both = np.abs(zeros[:, None] - zeros[None, :])
    sums = total.transpose(0, 2, 1, 3).reshape(high * LEAF, high * LEAF) + np.kron(empty, np.ones((LEAF, LEAF), np.int64)) * both
    return sums[:rows, :rows]


def _block_pairs(table: pa.Table, tile: int) -> pa.Table:
    """Differences of all pairs of groups in one block of terms; rows with term null carry the groups themselves."""
    names = ["lang", "a", "b", "g", "h", "value", "width"]
    term = table.column("term")
    heads = table.filter(term.is_null()).sort_by("g")
    cells = table.filter(term.is_valid())
    first = {c: table.column(c)[0].as_py() for c in ("lang", "a", "b")}
    groups, zero = heads.column("g").to_numpy(), heads.column("p").to_numpy()
    code = cells.column("term").combine_chunks().dictionary_encode()
    r, c, width = np.searchsorted(groups, cells.column("g").to_numpy()), code.indices.to_numpy(), len(code.dictionary)
    p = np.repeat(zero[:, None], width, 1)
    filled = np.zeros(p.shape, bool)
    p[r, c] = cells.column("p").to_numpy()
    filled[r, c] = True
    sums = pair_sums(p, filled, zero) if width else np.zeros((len(groups), len(groups)), np.int64)
    g, h = np.triu_indices(len(groups), 1)
    if first["a"] != first["b"]:  # pairs inside one run of groups belong to that run's own tile
        across = (groups[g] // tile) != (groups[h] // tile)
        g, h = g[across], h[across]
    size = len(g)
    return pa.table([pa.array([first["lang"]] * size, pa.string()), pa.array([first["a"]] * size, pa.int32()), pa.array([first["b"]] * size, pa.int32()),
                     pa.array(groups[g], pa.int32()), pa.array(groups[h], pa.int32()), pa.array(sums[g, h], pa.int64()), pa.array([width] * size, pa.int64())], names=names)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the language's other sources, and the terms most typical of each source."""
    partial = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    held = F.sum("df").over(Window.partitionBy("lang", "term"))
    cells = written(partial.withColumn("held", held).where(F.col("term").isNull() | (F.col("held") >= least)).drop("held", "df"), "cells")
    terms = cells.where("term IS NOT NULL")

    per_term = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    of_lang = per_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("int") - 1
    groups = cells.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))), F.lit(0)).alias("total"))
    groups = groups.join(of_lang, "lang", "left").na.fill(0, ["v", "lang_total"]).withColumn("g", numbered)
    groups = written(groups.withColumn("p", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(0))), "groups")

    shares = written(terms.join(groups.drop("p"), ["lang", "source"]).select(
        "lang", "source", "g", "term", "v", "lang_total", "n", _share(F.col("n"), F.col("total"), F.col("v")).alias("p")), "shares")
    return _pairs(groups, shares).unionByName(_terms(shares, per_term, top))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    runs = groups.select("lang", (F.col("g") / TILE).cast("int").alias("run")).distinct()
    tiles = runs.select("lang", F.col("run").alias("a")).join(runs.select("lang", F.col("run").alias("b")), "lang").where("a <= b")
    mine = (F.col("run") == F.col("a")) | (F.col("run") == F.col("b"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("run", (F.col("g") / TILE).cast("int")).join(tiles, "lang").where(mine)

    n_blocks = F.ceil(F.col("v") / BLOCK).cast("int")
    heads = dealt(groups).select("lang", "a", "b", F.explode(F.sequence(F.lit(0), F.greatest(n_blocks, F.lit(1)) - 1)).alias("block"), "g", F.lit(None).cast("string").alias("term"), "p")
    body = dealt(shares).select("lang", "a", "b", F.pmod(F.xxhash64("term"), n_blocks).cast("int").alias("block"), "g", "term", "p")
    found = heads.unionByName(body).groupBy("lang", "a", "b", "block").applyInArrow(lambda table: _block_pairs(table, TILE), "lang string, a int, b int, g int, h int, value long, width long")
    summed = found.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("width").alias("width"))

    def named(side: str) -> DataFrame:
        return groups.select("lang", F.col("g").alias(side), F.col("source").alias(f"{side}_source"), F.col("p").alias(f"{side}_p"), *(["v"] if side == "g" else []))

    priced = summed.join(named("g"), ["lang", "g"]).join(named("h"), ["lang", "h"]).withColumn("value", F.col("value") + (F.col("v") - F.col("width")) * F.abs(F.col("g_p") - F.col("h_p")))
    both = priced.select("lang", "value", F.explode(F.array(F.struct(F.col("g_source").alias("source"), F.col("h_source").alias("item")),
                                                            F.struct(F.col("h_source").alias("source"), F.col("g_source").alias("item")))).alias("e")).select("lang", "e.*", "value")
    return _ranked(both, "pair")


def _terms(shares: DataFrame, per_term: DataFrame, top: int) -> DataFrame:
    joined = shares.join(per_term, ["lang", "term"])
    over = joined.select("lang", "source", F.col("term").alias("item"), (F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).alias("value")).where("value > 0")
    return _ranked(over, "term").where(F.col("rank") <= top)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.cast("int").alias("rank"))
