"""Near-duplicate documents by DartMinHash over word shingles.

A text is a weighted set: its five-word shingles with their counts. Every unit of weight of a shingle is a region that hashed
darts hit at unit rate along a rank axis; a text keeps the darts of rank below a bound that makes about
``k ln k + 2k`` of them, whatever its size, and each of the ``k`` coordinates keeps its earliest dart (the bound is
doubled for texts that leave a coordinate empty). Two texts share a coordinate's dart with probability equal to
their weighted Jaccard similarity. Bands of five coordinates give join keys.

Equal texts are one node (64-bit text hash), so copies meet once. Inside a band, members are paired with three leaders
(least node under three orders) instead of with each other; pairs are checked exactly on their shingles, best match
first, until members hang together or all are tried. Where members of a band still lie in several classes, those
that no leader was tried for against each other go through an exact prefix-filter join on their shingles, rarest first, so no
link of a band is lost. Classes are connected components of pairs with similarity of at least 0.8.

Defined results: words are lower-cased runs of letters and digits; a text of fewer than five words has one shingle, a text
without words only matches equal texts; null text is empty; the class id is the least doc_id of the class (null
ids first); repeated rows share a class; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import as_bytes, parts, written
from packlens.llm.decontaminate import words_of
from packlens.llm.graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: 150 coordinates in 30 bands of 5: a pair of similarity 0.8 misses all bands with probability 7e-6.
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (np.log(COORDINATES) + 2)
_SALTS = (0, 0x3C6EF372FE94F82A, 0x1F83D9ABFB41BD6B)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the shingles of a text, in text order, with repeats."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    own: dict[bytes, int] = {}
    ids = [own.setdefault(w, len(own)) for w in words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in own), np.uint64, len(own))[ids]
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = _mix(out + hashes[k:k + n], k + 11)
    return out


def units(hashes: np.ndarray) -> np.ndarray:
    """One hash per unit of weight: the j-th occurrence of a shingle is a region of its own."""
    ordered = np.sort(hashes)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    nth = np.arange(len(ordered)) - np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))
    return np.where(nth == 0, ordered, _mix(ordered ^ _mix(nth.astype(np.uint64), 5), 6))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Earliest dart of each coordinate, one row per set of unit hashes; sets must not be empty."""
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    todo, factor = np.arange(len(sets)), 1.0
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        unit, owner = np.concatenate([sets[i] for i in todo]), np.repeat(np.arange(len(todo)), sizes)
        bound = (factor * DARTS / sizes)[owner]
        rank = np.zeros(len(unit))
        ranks, darts, slots = [], [], []
        step = 0
        while len(unit):
            throw = _mix(unit, 100 + 2 * step)
            rank = rank - np.log(((throw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            alive = rank < bound
            unit, owner, rank, bound = unit[alive], owner[alive], rank[alive], bound[alive]
            dart = _mix(unit, 101 + 2 * step)
            ranks.append(rank)
            darts.append(dart)
            slots.append(owner * COORDINATES + ((dart >> np.uint64(32)) % np.uint64(COORDINATES)).astype(np.int64))
            step += 1
        ranks, darts, slots = np.concatenate(ranks), np.concatenate(darts), np.concatenate(slots)
        first = np.full(len(todo) * COORDINATES, np.inf)
        np.minimum.at(first, slots, ranks)
        winner = ranks == first[slots]
        kept = np.zeros(len(todo) * COORDINATES, np.uint64)
        kept[slots[winner]] = darts[winner]
        full = np.isfinite(first).reshape(len(todo), -1).all(axis=1)
        out[todo[full]] = kept.reshape(len(todo), -1)[full]
        todo, factor = todo[~full], factor * 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    grouped = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(grouped.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)[None]
    for k in range(ROWS):
        key = _mix(key + grouped[:, :, k], 31 + k)
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, most=2 << 20):
        sets = [units(shingles(t)) for t in as_bytes(part.column("text"))]
        some = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if some:
            for i, row in zip(some, band_keys(signatures([sets[i] for i in some]))):
                keys[i] = row
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                                         names=["doc_id", "node", "weight", "bands"])


def _unit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches):
        sets = [np.sort((units(shingles(t)) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in as_bytes(part.column("text"))]
        yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "units"])


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        similar = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = np.sort(np.concatenate([np.unique(x), np.unique(y)]))
            shared = int((both[1:] == both[:-1]).sum())
            similar.append(shared / (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similar, pa.float64())], names=["a", "b", "similarity"])


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct unit of each set as a row, with the set's node, class and size."""
    for batch in batches:
        for node, label, data in zip(*(batch.column(c).to_pylist() for c in ("node", "label", "units"))):
            own = np.unique(np.frombuffer(data, np.uint32)).view(np.int32)
            for at in range(0, len(own), 100_000):
                cut = own[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(cut), *[pa.array(np.full(len(cut), x, np.int64)) for x in (node, label, len(own))]], names=["unit", "node", "label", "size"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """``a`` (member), ``b`` (leader), ``matches`` of texts that share bands; sizes that rule out the similarity are left out."""
    bands = nodes.select("node", "weight", F.explode("bands").alias("band"))
    leaders = [F.min(F.col("node").bitwiseXOR(F.lit(s))).alias(f"m{i}") for i, s in enumerate(_SALTS)]
    groups = bands.groupBy("band").agg(F.count("*").alias("n"), *leaders).where("n > 1")
    named = F.array_distinct(F.array(*[F.col(f"m{i}").bitwiseXOR(F.lit(s)) for i, s in enumerate(_SALTS)]))
    joined = bands.join(groups.select("band", named.alias("leaders")), "band")
    pairs = joined.select(F.col("node").alias("a"), F.col("weight").alias("wa"), F.explode("leaders").alias("b")).where("a <> b")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("matches"), F.min("wa").alias("wa"))
    other = nodes.select(F.col("node").alias("b"), F.col("weight").alias("wb"))
    return counted.join(other, "b").where(F.least("wa", "wb") >= SIMILARITY * F.greatest("wa", "wb")).select("a", "b", "matches")


def untried(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label`` of members that share a band with a member of another class, neither being its leader."""
    own = nodes.join(labels.select(F.col("node").alias("l_node"), "label"), F.col("node") == F.col("l_node"), "left")
    bands = own.select("node", F.coalesce("label", "node").alias("label"), F.explode("bands").alias("band"))
    leaders = [F.min(F.col("node").bitwiseXOR(F.lit(s))).alias(f"m{i}") for i, s in enumerate(_SALTS)]
    named = F.array_distinct(F.array(*[F.col(f"m{i}").bitwiseXOR(F.lit(s)) for i, s in enumerate(_SALTS)]))
    groups = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), *leaders)
    mixed = groups.select("band", "n", "l0", "l1", named.alias("leaders")).where((F.col("l0") != F.col("l1")) & (F.col("n") > F.size("leaders") + 1))
    return bands.join(mixed.select("band", "leaders"), "band").where(~F.array_contains("leaders", F.col("node"))).select("node", "label").distinct()


def prefixes(sets: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """``unit, node, label, size, left``: the first units of each member's set, rarest first, that a partner must meet.

    With the units of every set in one order, two sets that reach the similarity share a unit among the first
    ``n - ceil(s n) + 1`` of each, and from their first shared unit on both still hold (``left``) the ``s / (1 + s)`` of
    their sizes that they must share.
    """
    chosen = sets.join(members.select(F.col("node").alias("m_node"), "label"), F.col("node") == F.col("m_node")).select("node", "label", "units")
    rows = written(chosen.mapInArrow(_unit_rows, "unit int, node bigint, label bigint, size bigint"), "units")
    ranked = rows.join(rows.groupBy("unit").agg(F.count("*").alias("n")), "unit")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("n", "unit")))
    prefix = ranked.where((F.col("rank") <= F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - 1e-6) + 1) & (F.col("n") > 1))
    return written(prefix.select("unit", "node", "label", "size", (F.col("size") - F.col("rank") + 1).alias("left")), "prefixes")


def _may_reach(similarity: float):
    able = F.least("fa", "left") >= similarity / (1 + similarity) * (F.col("sa") + F.col("size")) - 1e-6
    return able & (F.least("sa", "size") >= similarity * F.greatest("sa", "size"))


def leading_pairs(prefix: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: members of a unit's other classes with the foremost member of its largest one, and those of that one with the next class's."""
    leader = F.max(F.struct("left", "node", "size"))
    classes = prefix.groupBy("unit", "label").agg(F.count("*").alias("n"), leader.alias("leader")).groupBy("unit").agg(
        F.count("*").alias("classes"), F.max(F.struct("n", "label", "leader")).alias("one"), F.min(F.struct("n", "label", "leader")).alias("two")).where("classes > 1")
    rows = prefix.join(classes.select("unit", "one", "two"), "unit")
    other = F.when(F.col("label") == F.col("one.label"), F.col("two.leader")).otherwise(F.col("one.leader"))
    named = rows.select("node", "size", "left", other["node"].alias("a"), other["size"].alias("sa"), other["left"].alias("fa"))
    return named.where(_may_reach(similarity)).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def crossing_pairs(prefix: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: all pairs of different classes that may reach the similarity.

    A unit's most frequent class is not joined with itself, so a large group of copies costs its outsiders only.
    """
    shares = prefix.groupBy("unit", "label").agg(F.count("*").alias("n")).groupBy("unit").agg(F.count("*").alias("classes"), F.max_by("label", "n").alias("most")).where("classes > 1")
    left = prefix.join(shares.select("unit", "most"), "unit").where("label <> most")
    left = left.select(F.col("unit").alias("u"), F.col("node").alias("a"), F.col("label").alias("la"), F.col("size").alias("sa"), F.col("left").alias("fa"))
    joined = left.join(prefix, (F.col("u") == F.col("unit")) & (F.col("la") != F.col("label"))).where(_may_reach(similarity))
    return joined.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, similarity`` of pairs, from their whole shingle sets."""
    x, y = sets.select(F.col("node").alias("a"), F.col("units").alias("x")), sets.select(F.col("node").alias("b"), F.col("units").alias("y"))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similarities, "a bigint, b bigint, similarity double"), "tested")


def _joined_classes(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """``node, label`` of all linked nodes once the links ``found`` are added: components of the classes they join."""
    if labels is None:
        return written(components(found), "labels")
    if found.isEmpty():
        return labels
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    crossing = found.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    classes = written(components(crossing), "joined").select(F.col("node").alias("c"), F.col("label").alias("l"))
    known = labels.join(classes, F.col("label") == F.col("c"), "left").select("node", F.coalesce("l", "label").alias("label"))
    new = classes.join(labels, F.col("c") == F.col("node"), "left_anti").select(F.col("c").alias("node"), F.col("l").alias("label"))
    return written(known.unionByName(new), "labels")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows ``doc_id, node``, nodes ``node, class_id, first_id``) of all documents."""
    rows = _rows(docs)
    signed = written(rows.mapInArrow(_sign, "doc_id bigint, node bigint, weight int, bands array<bigint>"), "signatures")
    firsts = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"]
    nodes = written(signed.groupBy("node").agg(firsts.alias("first_id"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "nodes")
    pairs = written(candidate_pairs(nodes), "pairs")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    wanted = bands.join(shared, "band", "left_semi").select(F.col("node").alias("w_node")).distinct()
    wanted = wanted.join(nodes.select("node", "first_id"), F.col("w_node") == F.col("node")).select("w_node", F.col("first_id").alias("w_id"))
    texts = rows.join(wanted, (F.col("node") == F.col("w_node")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")
    sets = written(texts.select("node", "text").mapInArrow(_unit_sets, "node bigint, units binary").dropDuplicates(["node"]), "unit_sets")
    labels, open_pairs = None, pairs.select("a", "b", "matches")
    for most in (1, 4, None):
        if labels is not None:
            la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
            apart = open_pairs.join(la, "a", "left").join(lb, "b", "left").where("coalesce(la, a) <> coalesce(lb, b)")
            open_pairs = written(apart.select("a", "b", "matches"), "open_pairs")
            if open_pairs.isEmpty():
                break
        picked = open_pairs
        if most:
            best = F.slice(F.sort_array(F.collect_list(F.struct("matches", "b")), asc=False), 1, most)  # a member has at most 3 leaders a band
            picked = open_pairs.groupBy("a").agg(best.alias("p")).select("a", F.explode("p.b").alias("b"))
        picked = picked.select("a", "b")
        tested = _tested(picked, sets)
        labels = _joined_classes(labels, tested.where(F.col("similarity") >= similarity).select("a", "b"))
        open_pairs = open_pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    members = written(untried(nodes, labels), "untried")
    if not members.isEmpty():
        prefix = prefixes(sets, members, similarity)
        for pairs_of in (leading_pairs, crossing_pairs):
            found = _tested(pairs_of(prefix, similarity), sets).where(F.col("similarity") >= similarity).select("a", "b")
            if found.isEmpty():
                continue
            labels = _joined_classes(labels, found)
            known = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
            prefix = prefix.join(known, F.col("node") == F.col("n"), "left").select("unit", "node", F.coalesce("l", "node").alias("label"), "size", "left")
    joined = nodes.select("node", "first_id").join(labels.select(F.col("node").alias("n"), "label"), F.col("node") == F.col("n"), "left")
    labelled = written(joined.select("node", "first_id", F.coalesce("label", "node").alias("label")), "labelled")
    least = labelled.groupBy(F.col("label").alias("c")).agg(F.min(F.struct(F.col("first_id").isNotNull(), "first_id", "node")).alias("least"))
    classes = labelled.join(least, F.col("label") == F.col("c")).select("node", "first_id", F.col("least.first_id").alias("class_id"), (F.col("node") == F.col("least.node")).alias("leads"))
    return signed.select("doc_id", "node"), written(classes, "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, is_kept`` of every document: the first of a class is kept."""
    rows, classes = near_classes(docs)
    found = classes.select(F.col("node").alias("c_node"), "first_id", "class_id", "leads")
    kept = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return rows.join(found, F.col("node") == F.col("c_node"), "left").select("doc_id", "class_id", kept.alias("is_kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns; rows repeated with id and text stay once."""
    _, classes = near_classes(docs)
    leaders = classes.where("leads").select(F.col("node").alias("k_node"), F.col("first_id").alias("k_id"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.xxhash64(text).alias("k_own"))
    kept = rows.join(leaders, (F.col("k_own") == F.col("k_node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("k_id")))
    return kept.dropDuplicates(["k_node", "k_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])
