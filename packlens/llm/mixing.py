"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Shares of tokens per source are raised to an exponent between 0 (uniform) and 1 (as found) and normalised. The exponent
is found by bisection on aggregates (each pass narrows the bracket by a factor): the largest exponent
whose weights reach the target entropy, then raised where a source would be repeated beyond the limit. A weight times
the token budget is a source's budget: whole epochs, then a part of one more. Documents of a source stand in a hashed
permutation of blocks; the part of an epoch is the longest prefix of that permutation that fits, found from
block sums first and rows of one block after. Each epoch permutes blocks and documents anew.

A source with a third of all rows is no hot group: it is only ever summed by (source, block) or (source, place). Rows of one id
with other texts have places of their own; equal rows lie side by side, told apart by the low bits of the place.

Defined results: tokens are white-space words; null and empty texts have no tokens and follow their source; null source
is a source of its own; null and shared ids are ids like others; of equal rows as many are taken as fit (which is open, they are equal); a table without tokens keeps every row once;
an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import written

#: Entropy of the mixture as a share of the greatest possible, and how often a source may be seen.
TARGET_ENTROPY, MAX_REPEATS = 0.97, 4.0
SEED = 17
_BLOCKS, _POINTS, _PASSES = 4096, 16, 6
#: Low bits of a place that tell equal rows apart.
_TIE = (1 << 16) - 1


def _place() -> Column:
    """63-bit place in the source's permutation: hash of id and text, then bits of the row. The row bits hold for one reading only,
    so a place is written once and read from there."""
    named = F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string")))
    return F.shiftrightunsigned(named, 1).bitwiseAND(F.lit(~_TIE)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(_TIE)))


def _tokens() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.when(F.length(F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))) == 0, 0).otherwise(F.regexp_count(text, F.lit("[^ \\t-\\r]+")))
    return words.cast("long")


def token_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, source, tokens`` and ``place``, the 63-bit place of the row in its source's permutation."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), _tokens().alias("tokens"), _place().alias("place"))


def _measures(totals: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """Entropy and greatest repetition at each exponent, in one aggregation over sources."""
    share = F.col("total") / F.lit(budget)
    columns = []
    for i, a in enumerate(exponents):
        raised = F.pow(share, F.lit(a))
        columns += [F.sum(raised).alias(f"z{i}"), F.sum(raised * F.log(raised)).alias(f"s{i}"), F.max(raised / share).alias(f"r{i}")]
    row = totals.agg(*columns).first()

    return [(math.log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"], row[f"r{i}"] / row[f"z{i}"]) for i in range(len(exponents))]


def find_exponent(totals: DataFrame, entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget_factor: float = 1.0) -> float:
    """The exponent for per-source ``total`` columns; 1.0 if there is at most one source."""

    totals = totals.where("total > 0")
    n, budget = totals.agg(F.count("*"), F.sum("total")).first()
    if not n or n == 1:
        return 1.0
    goal = entropy if entropy is not None else TARGET_ENTROPY * math.log(n)

    def bisect(holds, low: float, high: float) -> float:
        """Largest exponent in the bracket for which ``holds``; it holds below and fails above."""
        for _ in range(_PASSES):
            points = [low + (high - low) * (k + 1) / (_POINTS + 1) for k in range(_POINTS)]
            good = [p for p, m in zip(points, _measures(totals, points, budget)) if holds(m)]
            low = good[-1] if good else low
            high = next((p for p in points if p > low), high)
        return low

    exponent = 1.0 if _measures(totals, [1.0], budget)[0][0] >= goal else bisect(lambda m: m[0] >= goal, 0.0, 1.0)
    if budget_factor * _measures(totals, [exponent], budget)[0][1] > max_repeats:
        # repetition falls as the exponent rises, so bisect on its mirror image
        exponent = 1.0 - bisect_mirror(lambda p: [budget_factor * m[1] <= max_repeats for m in _measures(totals, p, budget)], 1.0 - exponent)
    return exponent


def bisect_mirror(holds, high: float) -> float:
    """Largest distance below exponent 1 that keeps repetitions within the limit."""
    low = 0.0
    for _ in range(_PASSES):
        points = [low + (high - low) * (k + 1) / (_POINTS + 1) for k in range(_POINTS)]
        good = [p for p, ok in zip(points, holds([1.0 - p for p in points])) if ok]
        low = good[-1] if good else low
        high = next((p for p in points if p > low), high)
    return low


def source_plan(counts: DataFrame, entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget_factor: float = 1.0) -> DataFrame:
    """Per source: ``share, weight, epochs`` (whole ones) and ``cut``, the last place of the epoch begun (-1: none)."""
    block = F.shiftrightunsigned("place", 51).cast("int")
    blocks = written(counts.groupBy("source", block.alias("block")).agg(F.sum("tokens").alias("tokens")), "blocks")
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("total"))
    exponent = find_exponent(totals, entropy, max_repeats, budget_factor)
    whole = totals.agg(F.sum("total").alias("all"), F.sum(F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(exponent)))).alias("z")).first()
    everything, z = float(whole["all"] or 0), float(whole["z"] or 1)
    weight = F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    budget = F.round(weight * F.lit(everything * budget_factor)).cast("long")
    plan = totals.select(F.col("source").alias("p_source"), "total", (F.col("total") / F.lit(everything or 1.0)).alias("share"), weight.alias("weight"), budget.alias("budget"))
    plan = plan.withColumn("epochs", F.when(F.col("total") > 0, F.expr("budget div total")).otherwise(1)).withColumn("rest", F.when(F.col("total") > 0, F.col("budget") % F.col("total")).otherwise(0))
    upto = Window.partitionBy("source").orderBy("block")
    running = blocks.withColumn("upto", F.sum("tokens").over(upto)).join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    edge = running.where("rest > 0 and upto > rest and upto - tokens <= rest").select(F.col("source").alias("e_source"), F.col("block").alias("e_block"), (F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("room"))
    edge = edge.groupBy("e_source").agg(F.min(F.struct("e_block", "room")).alias("edge")).select("e_source", "edge.*")
    inside = counts.select("source", "place", "tokens", block.alias("block")).join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
    inside = inside.groupBy("e_source", "place").agg(F.sum("tokens").alias("tokens"), F.first("room").alias("room"))
    ordered = inside.select("e_source", "place", "room", F.sum("tokens").over(Window.partitionBy("e_source").orderBy("place")).alias("upto"))
    last = ordered.groupBy(F.col("e_source").alias("c_source")).agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("place"))).alias("last"))
    start = F.shiftleft(F.col("e_block").cast("long"), 51) - 1
    cuts = edge.join(last, F.col("e_source").eqNullSafe(F.col("c_source")), "left").select("e_source", F.coalesce("last", start).alias("cut"))
    joined = plan.join(cuts, F.col("p_source").eqNullSafe(F.col("e_source")), "left")
    return joined.select(F.col("p_source").alias("source"), "total", "share", "weight", "budget", "epochs", F.coalesce("cut", F.lit(-1)).cast("long").alias("cut"))


def copies(rows: DataFrame, plan: DataFrame, place: str = "place") -> DataFrame:
    """``rows`` (with their places) with ``mix_copies``, the number of epochs that hold the row."""
    limits = plan.select(F.col("source").alias("m_source"), F.col("epochs").alias("m_epochs"), F.col("cut").alias("m_cut"))
    joined = rows.join(limits, rows["source"].cast("string").eqNullSafe(F.col("m_source")), "left")
    number = F.coalesce(F.col("m_epochs") + (rows[place] <= F.col("m_cut")).cast("long"), F.lit(1))
    return joined.select(*[rows[f"`{c}`"] for c in rows.columns], number.cast("int").alias("mix_copies"))


def mixed(docs: DataFrame, entropy: float | None = None, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The schedule: one row per document and epoch with its block and its order keys within the mixture."""
    counts = written(token_counts(docs), "tokens")
    plan = written(source_plan(counts, entropy, max_repeats), "plan")
    taken = copies(counts, plan).where("mix_copies > 0")
    rows = taken.select("doc_id", "source", "tokens", "place", F.shiftrightunsigned("place", 51).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)).alias("epoch"))
    key = lambda *columns: F.xxhash64(F.lit(SEED), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return rows.select("doc_id", "source", "tokens", "epoch", "block", key("source", "epoch", "block").alias("block_order"), key("epoch", "place").alias("row_order"))


def take_mixture(docs: DataFrame) -> DataFrame:
    """The documents as often as the mixture has them."""
    placed = written(docs.select("*", _tokens().alias("mix_tokens"), _place().alias("mix_place")), "placed")
    plan = written(source_plan(placed.select(F.col("source").cast("string").alias("source"), F.col("mix_tokens").alias("tokens"), F.col("mix_place").alias("place"))), "plan")
    taken = copies(placed, plan, "mix_place").where("mix_copies > 0")
    rows = taken.withColumn("mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
