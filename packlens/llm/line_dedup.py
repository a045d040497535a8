"""Near-equal lines by a deletion-neighbourhood join; DataFrame expressions only.

A line is its sequence of words. Lines of at least ``LEAST`` words are near-equal if one word substituted, inserted or
deleted makes them equal; lines of fewer words, and so those of scripts without spaces, if one character does, counted
with one space between words, from ``LEAST_CHARACTERS`` on. Lines of the two kinds are never near-equal; lines below both
bounds must be equal, as one edit there changes a list number or a name. A line goes if an equal or near-equal line
stands earlier (by doc_id, then line number), judged on the input.

1. Equal lines become one (hash of the words, earliest place); copies never meet in pairs.
2. One edit leaves the first or the last half of the shorter line whole, so only lines that share the hash of a half
   with another line can have a partner; texts do not move for this.
3. Those lines emit their variants with one unit (word or character) deleted as hashed keys: (rest, position, length) meets
   in substitutions, the deleted rest meets the shorter line itself in insertions. Hashes are XORs over units and places, so
   all variants of a line cost one running pass over its units, however long it is.
4. A key group keeps its earliest member by aggregation and each member is joined to that one only; pairs are checked on
   the units (common beginning plus common end).

Defined results: lines end at \\n; lines without words always stay; null text has one empty line; null ids order first; rows that share id
and text get equal results; rows that share an id with other texts are separate documents; other columns are
ignored; an empty table gives no rows. Lines and keys are known by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import written

#: Words from which a line may differ from an earlier one by one word.
LEAST = 8
#: Characters from which a line of fewer words may differ from an earlier one by one character.
LEAST_CHARACTERS = 16
_FIRST = -(2**63)
_PLACE = ("d", "node", "line_no")


def _normal(line: Column) -> Column:
    """The words of a line with one space between them; equal exactly if the words are."""
    for space in "\t\r\x0b\x0c":
        line = F.replace(line, F.lit(space), F.lit(" "))
    return F.when(F.contains(line, F.lit("  ")), F.array_join(F.array_remove(F.split(line, " "), ""), " ")).otherwise(F.trim(line))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("d"), F.xxhash64(text).alias("node"), F.split(text, "\n").alias("lines"))


def _halves(n: Column, first, last) -> Column:
    """Hashes of the first and last units that a line of ``n`` units shares with a partner one edit away."""
    half, other = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    keys = [F.xxhash64(F.lit(side), h, part(h)) for h in (half, other) for side, part in enumerate((first, last))]
    return F.when(half == other, F.array(*keys[:2])).otherwise(F.array(*keys))


def _n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _half_keys() -> Column:
    line, n = F.col("line"), F.col("n")
    upto = lambda h: F.call_function("substring_index", line, F.lit(" "), h)
    by_words = _halves(n, upto, lambda h: upto(-h))
    by_characters = _halves(F.length(line), lambda h: F.left(line, h), lambda h: F.right(line, h))
    return F.when(n >= LEAST, by_words).when(F.length(line) >= LEAST_CHARACTERS, by_characters)


def _units(line: Column) -> Column:
    """Words of a line that has ``LEAST`` of them, else its characters."""
    return F.when(_n_words(line) >= LEAST, F.split(line, " ")).otherwise(F.split(line, ""))


def distinct_lines(rows: DataFrame) -> DataFrame:
    """``f`` (line hash), earliest ``d, node, line_no`` and half keys of each distinct line with words."""
    lines = rows.select("d", "node", F.posexplode("lines").alias("line_no", "line")).select(*_PLACE, _normal(F.col("line")).alias("line")).where("line <> ''")
    counted = lines.select(*_PLACE, "line", _n_words(F.col("line")).alias("n"))
    hashed = counted.select(*_PLACE, F.xxhash64("line").alias("f"), _half_keys().alias("halves"))
    least = hashed.groupBy("f").agg(F.min(F.struct(*_PLACE)).alias("place"), F.first("halves").alias("halves"))
    return least.select("f", "place.*", "halves")


def _with_units(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``f, d, node, line_no, by_words, units`` of lines named by ``f`` and place; each document is read once for all its lines."""
    wanted = places.groupBy(F.col("d").alias("wd"), F.col("node").alias("wn")).agg(F.collect_set(F.struct("line_no", "f")).alias("wanted"))
    found = rows.join(wanted, (F.col("d") == F.col("wd")) & (F.col("node") == F.col("wn")))
    picked = F.transform("wanted", lambda w: F.struct(w["f"].alias("f"), w["line_no"].alias("line_no"), F.get("lines", w["line_no"]).alias("line")))
    line = F.col("line")
    lines = found.select("d", "node", F.inline(picked)).select("f", *_PLACE, _normal(line).alias("line"))
    return lines.select("f", *_PLACE, (_n_words(line) >= LEAST).alias("by_words"), _units(line).alias("units")).dropDuplicates(["f", *_PLACE])


def variant_keys(lines: DataFrame) -> DataFrame:
    """``key, role, place`` rows: role 0 substitution, 1 the line itself, 2 the line without one unit."""
    units = lines.select("f", *_PLACE, "by_words", F.posexplode("units").alias("i", "unit"))
    hashed = units.select("f", *_PLACE, "i", F.xxhash64("by_words", "unit", "i").alias("g"), F.xxhash64("by_words", "unit", F.col("i") - 1).alias("moved"))
    line = Window.partitionBy(*_PLACE)
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hashed.select("f", *_PLACE, "i", "g", F.count("*").over(line).alias("n"), F.bit_xor("g").over(line).alias("whole"), F.bit_xor("moved").over(line).alias("all_moved"),
                           F.bit_xor("g").over(upto).alias("begun"), F.bit_xor("moved").over(upto).alias("begun_moved"))
    rest = F.col("begun").bitwiseXOR(F.col("g")).bitwiseXOR(F.col("all_moved").bitwiseXOR(F.col("begun_moved")))
    key = lambda role, *parts: F.struct(F.xxhash64(F.lit(min(role, 1)), *parts).alias("key"), F.lit(role).alias("role"))
    keys = F.array(key(0, F.col("whole").bitwiseXOR(F.col("g")), "i", "n"), key(2, rest, F.col("n") - 1),
                   F.when(F.col("i") == 0, key(1, "whole", "n")))
    return summed.select(F.struct(*_PLACE, "f").alias("place"), F.inline(F.array_compact(keys)))


def earlier_partners(keys: DataFrame) -> DataFrame:
    """``f, partner``: each line with the earliest line of a key group where that one stands earlier."""
    own = F.when(F.col("role") != 2, F.col("place"))
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(own).alias("own"), F.min(F.when(F.col("role") == 2, F.col("place"))).alias("cut")).where("n > 1")
    joined = keys.join(groups, "key")
    partner = F.when(F.col("role") == 1, F.col("cut")).otherwise(F.col("own"))
    return joined.where(partner < F.col("place")).select(F.col("place.f").alias("f"), partner["f"].alias("partner")).distinct()


def within_one_edit(a: str, b: str) -> Column:
    """Whether two arrays of units are one substitution, insertion or deletion apart, or equal."""
    x, y = F.col(a), F.col(b)

    def common(p: Column, q: Column) -> Column:
        unequal = F.array_position(F.zip_with(p, q, lambda u, v: u.eqNullSafe(v)), False)
        return F.when(unequal > 0, unequal - 1).otherwise(F.least(F.size(p), F.size(q)))

    longer = F.greatest(F.size(x), F.size(y))
    return (common(x, y) + common(F.reverse(x), F.reverse(y)) >= longer - 1) & (F.abs(F.size(x) - F.size(y)) <= 1)


def near_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``f, partner`` of distinct lines that have an earlier near-equal line (verified)."""
    halves = lines.where("halves is not null").select("f", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    some = halves.join(shared, "half", "left_semi").select(F.col("f").alias("want")).distinct()
    places = lines.join(some, F.col("f") == F.col("want"), "left_semi").select("f", *_PLACE)
    candidates = written(_with_units(rows, places), "candidate_lines")
    pairs = written(earlier_partners(variant_keys(candidates)), "line_pairs")
    mine = candidates.select("f", F.col("units").alias("x"))
    other = candidates.select(F.col("f").alias("partner"), F.col("units").alias("y"))
    return pairs.join(mine, "f").join(other, "partner").where(within_one_edit("x", "y")).select("f", "partner")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_equal`` and ``n_near`` (lines that go), ``kept_sha256`` and the kept text ``kept``."""
    rows = _rows(docs)
    lines = written(distinct_lines(rows), "lines")
    near = near_lines(rows, lines).select(F.col("f").alias("gone")).distinct()
    marked = lines.select("f", *_PLACE).join(near, F.col("f") == F.col("gone"), "left")
    firsts = marked.groupBy(F.col("d").alias("fd"), F.col("node").alias("fn")).agg(
        F.collect_set(F.when(F.col("gone").isNull(), F.col("line_no"))).alias("stay"), F.count("gone").alias("n_near"))
    joined = rows.join(firsts, (F.col("d") == F.col("fd")) & (F.col("node") == F.col("fn")), "left")
    blank = lambda line, i: F.when(F.btrim(line, F.lit(" \t\r\x0b\x0c")) == "", i)
    stay = F.array_sort(F.concat(F.coalesce("stay", F.array().cast("array<int>")), F.array_compact(F.transform("lines", blank))))
    held = F.transform(stay, lambda i: F.get("lines", i))
    out = joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_near", F.lit(0)).alias("n_near"), held.alias("held"))
    text = F.array_join("held", "\n")
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("held") - F.col("n_near")).alias("n_equal"), "n_near", F.sha2(text, 256).alias("kept_sha256"), text.alias("kept"))
