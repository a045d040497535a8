"""Layout operators: recognised text blocks -> reading order -> lines -> candidate spans.

Scale notes. All per-image work is keyed by ``(image_id, strip)``. A strip is a horizontal band of
an image that starts at a line nothing crosses; photographs are one strip, and only images taller
than ``STRIP_PX`` (long scanned documents) are split, so one huge image spreads over many tasks.
Lines never cross a strip, and spans that do are completed from the neighbouring strips' first lines.
Every step after the one shuffle on ``(image_id, strip)`` reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.functions.normalize import is_nutrition
from packlens.functions.scores import clamp_confidence, polygon_to_block
from packlens.functions.text import strip

STRIP_PX = 8192
HALO_PX = max(V.NUTRITION_MARGIN_PX, V.DATE_NEIGHBOUR_PX[1], V.BATCH_NEIGHBOUR_PX[1])
ORDER_SLICE = 512
READ = ("y1", "x1", "block_order", "block_id")
#: Whether spans with these marks and this number of blocks are to be built.
Wanted = Callable[[Column, Column], Column]


def _slice(y: Column, px: int) -> Column:
    return F.greatest(F.lit(0), F.floor(y / px)).cast("int")


# ------------------------------------------------------------------ OCR output (LAY12)
def blocks_from_ocr(raw: DataFrame) -> DataFrame:
    """Raw OCR rows (polygon, text, score, scale, width, height) -> clamped blocks; blank text dropped."""
    return (
        raw.withColumn("text", strip(F.col("text")))
        .where(F.col("text") != "")
        .withColumn("box", polygon_to_block(F.col("polygon"), F.col("scale"), F.col("width"), F.col("height")))
        .withColumn("confidence", clamp_confidence(F.col("score")))
        .select("image_id", "block_id", "text", "confidence", "box.*")
    )


# ------------------------------------------------------------- reading order (LAY1, LAY2, WIN1)
def number_rows(df: DataFrame, keys: list[str], slice_col: str, order: list, out: str, start: int = 0) -> DataFrame:
    """Row numbers per key, computed slice by slice so that a hot key is not sorted by one task.

    ``slice_col`` must be non-decreasing in ``order``. Offsets are one small row per (key, slice).
    """
    local = W.partitionBy(*keys, slice_col).orderBy(*order)
    before = W.partitionBy(*keys).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, slice_col).agg(F.count("*").alias("__n"))
        .withColumn("__offset", F.sum("__n").over(before))
        .where("__offset > 0").drop("__n")
    )
    return (
        df.withColumn("__rn", F.row_number().over(local))
        .join(offsets, [*keys, slice_col], "left")
        .withColumn(out, (F.col("__rn") + F.coalesce("__offset", F.lit(0)) - 1 + start).cast("long"))
        .drop("__rn", "__offset")
    )


def reading_order(blocks: DataFrame) -> DataFrame:
    """LAY1: bands of half the mean block height (at least 10 px), then left to right."""
    tolerance = blocks.groupBy("image_id").agg(
        F.greatest(F.lit(10.0), F.avg(F.col("y2") - F.col("y1")) * 0.5).alias("__tol"))
    banded = (
        blocks.join(tolerance, "image_id")
        .withColumn("band", (F.col("y1") / F.col("__tol")).cast("int"))
        .withColumn("__slice", F.floor(F.col("band") / ORDER_SLICE).cast("int"))
    )
    order = ["band", "x1", "block_order", "block_id"]
    return number_rows(banded, ["image_id"], "__slice", order, "reading_pos").drop("__tol", "__slice")


def reading_order_simple(blocks: DataFrame) -> DataFrame:
    """LAY2: plain (y1, x1) order."""
    sliced = blocks.withColumn("__slice", F.floor(F.col("y1") / STRIP_PX).cast("int"))
    return number_rows(
        sliced, ["image_id"], "__slice", ["y1", "x1", "block_order", "block_id"], "reading_pos"
    ).drop("__slice")


# ---------------------------------------------------------------------------- strips
def _extent() -> tuple[Column, Column]:
    """Vertical extent of a block; boxes under 2 px get one pixel of slack on each side."""
    y1, y2 = F.col("y1"), F.col("y2")
    thin = (y2 - y1) < 2
    return (
        F.when(thin, F.least(y1, y2) - 1).otherwise(y1),
        F.when(thin, F.greatest(y1, y2) + 1).otherwise(y2),
    )


def strip_cuts(blocks: DataFrame, px: int = STRIP_PX) -> DataFrame:
    """Cut lines of tall images: per slice below the first, the first y that no earlier block reaches.

    Reads only blocks at or below ``px`` (a Parquet range filter), so ordinary photographs cost nothing.
    Cuts are searched in the upper half of a slice, hence two cuts are at least ``px / 2`` apart.
    """
    lo, hi = _extent()
    tall = (
        blocks.where(F.col("y2") >= px - 1)
        .select("image_id", "y1", lo.alias("lo"), hi.alias("hi"))
        .withColumn("slice", F.explode(F.sequence(_slice(F.col("y1"), px), _slice(F.greatest("hi", "y1"), px))))
        .where("slice >= 1")
    )
    earlier = W.partitionBy("image_id", "slice").orderBy("y1").rowsBetween(W.unboundedPreceding, -1)
    home = F.col("y1").between(F.col("slice") * px, F.col("slice") * px + px // 2 - 1)
    free = F.coalesce(F.col("lo") >= F.max("hi").over(earlier), F.lit(True))
    cuts = (
        tall.withColumn("cut", F.when(home & free, F.col("y1")))
        .groupBy("image_id", "slice").agg(F.min("cut").alias("cut"))
    )
    above = W.partitionBy("image_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    return cuts.withColumn(
        "prev_strip",
        F.coalesce(F.last(F.when(F.col("cut").isNotNull(), F.col("slice")), ignorenulls=True).over(above), F.lit(0)),
    )


def assign_strips(rows: DataFrame, cuts: DataFrame, y: str = "y1", px: int = STRIP_PX, low: DataFrame | None = None) -> DataFrame:
    """Strip of every row by the position in column ``y``; only rows below ``px`` meet the cut table.

    ``low`` may give those rows that can lie below ``px`` (others among them do no harm), so that not all rows are made twice.
    """
    first = rows.where(F.col(y) < px).withColumn("strip", F.lit(0))
    below = (
        (rows if low is None else low).where(F.col(y) >= px).withColumn("slice", _slice(F.col(y), px))
        .join(cuts, ["image_id", "slice"], "left")
        .withColumn("strip", F.when(F.col(y) >= F.col("cut"), F.col("slice"))
                    .otherwise(F.coalesce("prev_strip", F.lit(0))))
        .drop("slice", "cut", "prev_strip")
    )
    return first.unionByName(below)


# --------------------------------------------------------------- nutrition mask (JN6)
def _masked(blocks: DataFrame, px: int, near: Column | None = None) -> DataFrame:
    """Blocks with ``strip`` and ``nutrition`` (own text, or level with a nutrition block).

    Instead of pairing blocks, two running extremes per strip answer "does any nutrition row overlap":
    the lowest end among rows starting no later, and the nearest start among rows starting later.
    ``near`` picks the blocks that can serve as values of nearby anchors; they become ``near_values``,
    one array per strip.
    """
    m, halo = V.NUTRITION_MARGIN_PX, HALO_PX
    cuts = strip_cuts(blocks, px)
    flagged = blocks.withColumn("lexical", F.coalesce(is_nutrition(F.col("text")), F.lit(False)))
    # near a cut a block also acts on the neighbouring strip: it is sent there as a ghost row
    probes = F.when(
        F.col("y2") + halo >= px, F.array_distinct(F.array("y1", F.col("y1") - halo, F.col("y2") + halo)),
    ).otherwise(F.array("y1"))
    placed = flagged.withColumn("__pos", F.explode(probes))
    # a filter is not pushed below the generator; this one tells Parquet that photographs need not be read again
    low = flagged.where((F.col("y1") >= px) | (F.col("y2") >= px - halo)).withColumn("__pos", F.explode(probes))
    placed = assign_strips(placed, cuts, "__pos", px, low)
    # One explicit shuffle for the whole layout. A block row turns into dozens of spans, so partitions
    # sized by their few shuffled bytes (as adaptive coalescing would do) leave most cores idle.
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(n, "image_id", "strip")
    part = W.partitionBy("image_id", "strip")
    starts_before = part.orderBy("y1").rangeBetween(W.unboundedPreceding, m)
    starts_after = part.orderBy(F.desc("y1")).rangeBetween(W.unboundedPreceding, -(m + 1))
    reach = F.max(F.when(F.col("lexical"), F.greatest("y2", "y1"))).over(starts_before)
    next_start = F.min(F.when(F.col("lexical"), F.col("y1"))).over(starts_after)
    overlap = F.coalesce(F.col("__reach") + m >= F.col("y1"), F.lit(False)) | F.coalesce(F.col("__next") - m <= F.col("y2"), F.lit(False))
    # this order holds for all windows that follow, those of the islands too
    out = placed.withColumn("__next", next_start).sortWithinPartitions("image_id", "strip", *READ).withColumn("__reach", reach)
    out = out.withColumn("nutrition", F.col("lexical") | overlap)
    if near is not None:
        out = out.withColumn("near_values", F.collect_list(near).over(part))
    return out.where(F.col("__pos") == F.col("y1")).drop("__pos", "lexical", "__next", "__reach")


def nutrition_mask(blocks: DataFrame, px: int = STRIP_PX) -> DataFrame:
    """JN6: every block with a ``nutrition`` flag."""
    return _masked(blocks, px).drop("strip")


# -------------------------------------------------------------------- lines (LAY3, LAY4)
def _fold_lines(blocks: Column) -> Column:
    """Greedy assignment of one island's blocks: first line whose middle is close enough, else a new line."""
    line_type = "array<struct<y1:int,y2:int,n:int>>"

    def close(line: Column, b: Column) -> Column:
        def height(r):
            return F.greatest(F.lit(1), r["y2"] - r["y1"])

        gap = F.abs((b["y1"] + b["y2"]) / 2 - (line["y1"] + line["y2"]) / 2)
        return gap <= F.least(height(b), height(line)) * V.LINE_OVERLAP_FACTOR

    def step(acc: Column, b: Column) -> Column:
        hit = F.coalesce(F.array_min(F.transform(acc["lines"], lambda ln, i: F.when(close(ln, b), i))), F.size(acc["lines"]))
        new_line = F.struct(b["y1"].alias("y1"), b["y2"].alias("y2"), F.lit(1).alias("n"))
        grown = F.transform(acc["lines"], lambda ln, i: F.when(i == hit, F.struct(
            F.least(ln["y1"], b["y1"]).alias("y1"), F.greatest(ln["y2"], b["y2"]).alias("y2"),
            (ln["n"] + 1).alias("n"))).otherwise(ln))
        return F.struct(
            F.when(hit == F.size(acc["lines"]), F.concat(acc["lines"], F.array(new_line))).otherwise(grown)
            .cast(line_type).alias("lines"),
            F.concat(acc["home"], F.array(hit.cast("int"))).alias("home"),
        )

    start = F.struct(F.array().cast(line_type).alias("lines"), F.array().cast("array<int>").alias("home"))
    return F.aggregate(blocks, start, step)


_BLOCK = ["x1", "block_order", "block_id", "y1", "x2", "y2", "text", "confidence", "nutrition"]


def _islands(masked: DataFrame) -> DataFrame:
    """Number the vertical islands of a strip: runs of blocks whose extents overlap.

    A block can only join a line it overlaps, so islands are independent and tiny. ``opens`` marks the first block of each,
    ``alone`` the blocks that are islands by themselves.
    """
    lo, hi = _extent()
    ordered = W.partitionBy("image_id", "strip").orderBy(*READ)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    opens = F.coalesce((lo >= F.max(hi).over(before)).cast("int"), F.lit(1))
    masked = masked.withColumn("opens", opens)
    if "near_values" in masked.columns:
        # one array per strip: the first block keeps it through the sorts that follow, and it is handed to the lines behind them
        masked = masked.withColumn("__rn", F.row_number().over(ordered)).withColumn("near_values", F.when(F.col("__rn") == 1, F.col("near_values"))).drop("__rn")
    return (
        masked
        .withColumns({
            "island": F.sum("opens").over(ordered.rowsBetween(W.unboundedPreceding, 0)),
            "__next": F.lead("opens", 1, 1).over(ordered),
        })
        .withColumn("alone", (F.col("opens") == 1) & (F.col("__next") == 1)).drop("__next")
    )


def cluster_lines(blocks: DataFrame, px: int = STRIP_PX) -> DataFrame:
    """LAY3: one row per text line: image columns, ``strip``, ``line_no`` (in strip; see ``image_lines``), box, sorted blocks."""
    return _strip_lines(blocks, px).drop(*_LINE_ORDER[1:])


_LINE_ORDER = ("y1", "island", "pos")


def _strip_lines(blocks: DataFrame, px: int, near: Column | None = None) -> DataFrame:
    """The lines of :func:`cluster_lines` with the columns they are ordered by. The text of their blocks is trimmed."""
    masked = _islands(_masked(blocks, px, near))
    image_cols = [c for c in ("scan_id", "image_type", "image_seq") if c in blocks.columns]
    extra = [] if near is None else ["near_values"]
    # member order inside an island is the (y1, x1) reading order the greedy rule depends on
    member = F.struct("y1", *[strip(F.col(c)).alias(c) if c == "text" else c for c in _BLOCK if c != "y1"])
    # The first block of an island stands for it. Most islands are one block, and gather no list: grouping all of them
    # costs more than the rest of the layout.
    island = W.partitionBy("image_id", "strip", "island")
    islands = (
        masked.withColumns({
            **{f"__{c}": F.min(c).over(island) for c in image_cols},
            "members": F.collect_list(F.when(~F.col("alone"), member)).over(island),
        })
        .where("opens = 1")
        .select(*[F.col(f"__{c}").alias(c) for c in image_cols], *extra, "image_id", "strip", "island", "members", member.alias("__own"))
    )
    folded = islands.withColumn("fold", F.when(F.size("members") > 1, _fold_lines(F.sort_array("members"))))
    single = F.array(F.struct(F.col("__own.y1").alias("y1"), F.col("__own.y2").alias("y2")))
    line_list = F.when(F.col("fold").isNull(), single).otherwise(
        F.transform(F.col("fold.lines"), lambda ln: F.struct(ln["y1"].alias("y1"), ln["y2"].alias("y2"))))
    lines = folded.select("*", F.posexplode(line_list).alias("pos", "line"))
    def left_first(b: Column) -> Column:
        return F.struct(*[b[c].alias(c) for c in ["x1", "y1", *[k for k in _BLOCK if k not in ("x1", "y1")]]])

    own = F.filter(F.sort_array("members"), lambda b, i: F.get(F.col("fold.home"), i) == F.col("pos"))
    in_strip = W.partitionBy("image_id", "strip").orderBy(*_LINE_ORDER)
    # most islands are one block, and need no function over arrays
    left_to_right = F.when(F.col("fold").isNull(), F.array(left_first(F.col("__own")))).otherwise(F.sort_array(F.transform(own, left_first)))
    total = F.aggregate(F.col("blocks"), F.lit(0.0), lambda a, b: a + F.greatest(F.lit(1), b["y2"] - b["y1"])) / F.size("blocks")
    first = F.col("blocks")[0]
    whole_strip = W.partitionBy("image_id", "strip")
    return (
        lines.select(
            *image_cols, *extra, "image_id", "strip", "island", "pos",
            F.col("line.y1").alias("y1"), F.col("line.y2").alias("y2"),
            left_to_right.alias("blocks"),
        )
        .withColumn("line_no", F.row_number().over(in_strip) - 1)
        .withColumns({c: F.first(c, ignorenulls=True).over(whole_strip) for c in extra})
        .withColumn("height", F.when(F.size("blocks") == 1, F.greatest(F.lit(1), first["y2"] - first["y1"]).cast("double")).otherwise(total))
        .withColumn("text", F.array_join(F.col("blocks")["text"], " "))
    )


def lines_of_images(blocks: DataFrame, px: int = STRIP_PX) -> DataFrame:
    """LAY3, LAY4: the lines of :func:`cluster_lines` numbered over whole images.

    Only images that reach ``px`` can have several strips, so the rows that carry numbers from strip to strip are made from these
    images' blocks alone; where there are none (a Parquet range filter tells), the layout runs once.
    """
    tall = blocks.where(F.col("y2") >= px - 1).select("image_id").distinct()
    return image_lines(cluster_lines(blocks, px), cluster_lines(blocks.join(tall, "image_id", "left_semi"), px))


def image_lines(lines: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """Lines numbered over the whole image, with ``up``, the box and height of the line above (null for the first).

    Strips only deal work out: every strip starts at the number of lines above it, and its first line looks at the last
    line of the strip above. Both come from one small row per strip, taken from ``cut``: the same lines, where only
    images of several strips are needed (all of ``lines`` if not given).
    """
    item = F.struct("y1", "y2", "height")
    strips = (lines if cut is None else cut).groupBy("image_id", "strip").agg(F.count("*").alias("__n"), F.max(F.struct("line_no", item.alias("last")))["last"].alias("__last"))
    down = W.partitionBy("image_id").orderBy("strip")
    above = strips.select("image_id", "strip", F.sum("__n").over(down.rowsBetween(W.unboundedPreceding, -1)).alias("__offset"), F.lag("__last").over(down).alias("__tail")).where("__offset > 0")
    up = F.lag(item).over(W.partitionBy("image_id", "strip").orderBy("line_no"))
    joined = lines.withColumn("up", up).join(above, ["image_id", "strip"], "left")
    return joined.withColumn("up", F.coalesce("up", "__tail")).withColumn("line_no", (F.col("line_no") + F.coalesce("__offset", F.lit(0))).cast("long")).drop("__offset", "__tail")


def proximate(upper: Column, lower: Column) -> Column:
    """LAY4: the lower line starts within 1.8 mean line heights of the upper line's end."""
    return (lower["y1"] - upper["y2"]) <= (upper["height"] + lower["height"]) / 2 * V.LINE_GAP_FACTOR


# -------------------------------------------------------------------- spans (LAY5-LAY8)

def _next_lines(lines: DataFrame, blocks: DataFrame, px: int, near: Column | None, marks: Column) -> DataFrame:
    """Attach the up to four lines after each line, across strips: ``__next1`` to ``__next4``, null where there is none.

    They are columns, not an array: functions over arrays would keep this step out of generated code.
    """
    k = V.MAX_FOLLOWING_LINES
    item = F.struct("y1", "y2", "height", "text", "blocks", "marks")
    in_strip = W.partitionBy("image_id", "strip").orderBy(*_LINE_ORDER)
    # First lines of the lower strips of tall images, addressed to the strip above. Strips below the
    # first consist of blocks at or below ``px``, so photographs contribute nothing to this branch.
    lower = _strip_lines(blocks.where(F.col("y2") >= px - HALO_PX), px, near).withColumn("marks", marks)
    if near is None:
        lower = lower.withColumn("near_values", F.lit(None).cast("array<string>"))
    heads = (
        lower.where((F.col("strip") >= 1) & (F.col("line_no") < k)).withColumn("__item", item)
        .groupBy("image_id", "strip").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "__item"))), lambda r: r["__item"]).alias("head"),
            F.first("near_values").alias("head_values"))
    )
    seq = W.partitionBy("image_id").orderBy("strip")
    chained = F.flatten(F.array_compact(F.array("head", *[F.lead("head", i).over(seq) for i in range(1, k)])))
    addressed = heads.withColumn("__above", F.coalesce(F.lag("strip").over(seq), F.lit(0))).select(
        "image_id", F.col("__above").alias("strip"), F.slice(chained, 1, k).alias("next_head"),
        F.flatten(F.array_compact(F.array("head_values", *[F.lead("head_values", i).over(seq) for i in range(1, k)])))
        .alias("next_values"))
    own = F.lit(0)
    for c in _NEXT:
        own = own + F.col(c).isNotNull().cast("int")
    out = (
        lines.select("*", *[F.lead(item, i + 1).over(in_strip).alias(c) for i, c in enumerate(_NEXT)]).withColumn("__have", own)
        .join(addressed, ["image_id", "strip"], "left")
        .withColumns({c: F.coalesce(c, F.get("next_head", i - F.col("__have"))) for i, c in enumerate(_NEXT)})
    )
    if near is not None:
        # spans that reach into the next strip look for values around their end as well
        reaches = F.col("next_values").isNotNull() & (F.col("__have") < k)
        out = out.withColumn("near_values", F.when(reaches, F.concat("near_values", "next_values"))
                             .otherwise(F.col("near_values")))
    return out.drop("next_head", "next_values", "__have")


_NEXT = tuple(f"__next{j}" for j in range(1, V.MAX_FOLLOWING_LINES + 1))
#: Bits of a line beside those of its groups: its blocks, its runs of blocks.
_SINGLES, _RUNS = 8, 9


def _first_run(n: Column, k: int | Column) -> Column:
    """LAY6: how many runs of 2 to ``k`` - 1 blocks a line of ``n`` blocks has."""
    return (k - 2) * (n + 1) - (F.shiftright(F.lit(k) * (k - 1), 1) - 1)


def _reach(line: Column, following: list[Column], wanted: Wanted) -> Column:
    """Bits of the groups of LAY7 to build: bit j for the line with j + 1 following lines, each near the previous."""
    out, chain, prev, marks, n = F.lit(0), F.lit(True), line, line["marks"], F.size(line["blocks"])
    for j, nxt in enumerate(following):
        chain = chain & F.coalesce(proximate(prev, nxt), F.lit(False))
        marks, n = marks.bitwiseOR(nxt["marks"]), n + F.size(nxt["blocks"])
        out = out.bitwiseOR(F.when(chain & wanted(marks, n), 1 << j).otherwise(0))
        prev = nxt
    return out


def span_rows(blocks: DataFrame, kinds: tuple[str, ...] = ("single", "line", "multi"),
              px: int = STRIP_PX, near: Column | None = None, near_guard: str | None = None,
              marks: Column | None = None, wanted: Wanted | None = None) -> DataFrame:
    """The rows of :func:`candidate_spans` before :func:`with_blocks`: ``text``, ``n_blocks`` and the line's columns.

    A line counts its spans and each number becomes a row, so most texts are judged before any array of blocks is built.
    """
    near_bit = 1 << 30
    marks = F.lit(0) if marks is None else marks
    wanted = wanted or (lambda marks, n_blocks: F.lit(True))
    if near is not None:
        marks = marks.bitwiseOR(F.when(F.col("text").rlike(near_guard), near_bit).otherwise(0))
    lines = _strip_lines(blocks, px, near).withColumn("marks", marks)
    multi = "multi" in kinds
    if multi:
        lines = _next_lines(lines, blocks, px, near, marks)
    following = [F.col(c) for c in _NEXT] if multi else []
    extra = [] if near is None else ["near_values"]
    if near is not None:
        around = F.col("marks")
        for nxt in following:
            around = around.bitwiseOR(F.coalesce(nxt["marks"], F.lit(0)))
        lines = lines.withColumn("near_values", F.when(around.bitwiseAND(near_bit) != 0, F.col("near_values")))
    image_cols = [c for c in ("scan_id", "image_type", "image_seq") if c in blocks.columns]
    n = F.size("blocks")
    bits = _reach(F.struct("y1", "y2", "height", "blocks", "marks"), following, wanted)
    if "single" in kinds:
        bits = bits.bitwiseOR(F.when(wanted(F.col("marks"), F.lit(1)), 1 << _SINGLES).otherwise(0))
    if "line" in kinds:
        bits = bits.bitwiseOR(F.when((n > 1) & wanted(F.col("marks"), F.lit(2)), 1 << _RUNS).otherwise(0))
    key = F.shiftleft(F.col("strip").cast("long"), 32) + F.col("line_no")
    lines = lines.select(
        *image_cols, *extra, "image_id", key.alias("__key"), F.col("text").alias("__text"), F.col("blocks").alias("__blocks"), n.alias("__n"),
        *[F.col(c) for c in _NEXT if multi], bits.alias("__bits"))
    d, n = F.col("__d"), F.col("__n")
    # numbers below 0 are groups of lines, then come the blocks, the full line, and its runs of 2, 3, ... blocks
    runs = F.when(n > 2, _first_run(n, F.least(F.lit(V.MAX_NGRAM + 1), n))).otherwise(0)
    last = F.when(F.getbit("__bits", F.lit(_RUNS)) == 1, n + runs).when(F.getbit("__bits", F.lit(_SINGLES)) == 1, n - 1).otherwise(-1)
    number = F.explode(F.sequence(F.lit(-V.MAX_FOLLOWING_LINES), last)).alias("__d")
    bit = F.when(d < 0, -d - 1).when(d < n, _SINGLES).otherwise(_RUNS)
    run = d - n - 1
    length = F.when(d <= n, 0)
    for k in range(V.MAX_NGRAM, 2, -1):
        length = length.when((n > k) & (run >= _first_run(n, k)), k)
    length = length.otherwise(2)
    spans = lines.select("*", number).where(F.getbit("__bits", bit) == 1).withColumn("__len", length)
    spans = spans.withColumn("__from", F.when(d > n, run - _first_run(n, F.col("__len"))).otherwise(0))
    single, length, start = F.get("__blocks", d), F.col("__len"), F.col("__from")
    joined = [F.col("__text")]
    text, size = F.when(d >= n, F.when(d == n, F.col("__text")).otherwise(F.array_join(F.slice("__blocks", start + 1, length)["text"], " "))).when(
        d >= 0, single["text"]), F.when(d > n, length).when(d == n, n).when(d >= 0, 1)
    several = n
    for j, nxt in enumerate(following):
        joined, several = [*joined, F.lit("\n"), nxt["text"]], several + F.size(nxt["blocks"])
        text, size = text.when(d == -j - 1, F.concat(*joined)), size.when(d == -j - 1, several)
    return spans.select(
        *image_cols, *extra, "image_id", text.alias("text"), (d < 0).alias("is_multi_line"),
        F.when(d < 0, 2).when(d < n, 0).otherwise(1).alias("stage"),
        F.when((d >= 0) & (d < n), single["block_order"].cast("long")).otherwise(F.col("__key")).alias("a"),
        F.when(d < 0, -d).otherwise(length).alias("b"), start.alias("c"),
        size.alias("n_blocks"), "__d", "__blocks", *[c for c in _NEXT if multi])


def with_blocks(rows: DataFrame) -> DataFrame:
    """Rows of :func:`span_rows` with the ``blocks`` of each span instead of those of its line."""
    blocks, stage, size = F.col("__blocks"), F.col("stage"), F.col("n_blocks")
    out = F.when((stage == 0) & (F.size(blocks) > 1), F.slice(blocks, F.col("__d") + 1, 1)).when(
        (stage == 1) & (F.col("b") > 0), F.slice(blocks, F.col("c") + 1, size))
    following = [c for c in _NEXT if c in rows.columns]
    for j in range(len(following)):
        out = out.when(F.col("__d") == -j - 1, F.concat(blocks, *[F.col(c)["blocks"] for c in following[:j + 1]]))
    return rows.withColumn("blocks", out.otherwise(blocks)).drop("__d", "__blocks", *following)


def candidate_spans(blocks: DataFrame, kinds: tuple[str, ...] = ("single", "line", "multi"),
                    px: int = STRIP_PX, near: Column | None = None, near_guard: str | None = None,
                    marks: Column | None = None, wanted: Wanted | None = None) -> DataFrame:
    """All candidate spans of every image.

    One row per span: image columns, ``text``, ``blocks``, ``is_multi_line``, ``n_blocks``,
    ``ocr_conf`` and the order key ``(stage, a, b, c)`` (blocks, then line runs, then line groups).

    A caller who looks for certain words gives ``marks``, an int of up to 30 bits over the ``text`` of one line, and ``wanted``, over the
    marks that a span's lines have together: spans that it does not hold for are not built. A line is judged once, however many spans hold it.
    """
    spans = with_blocks(span_rows(blocks, kinds, px, near, near_guard, marks, wanted))
    return spans.withColumn("ocr_conf", ocr_confidence(F.col("blocks")))


def ocr_confidence(blocks: Column) -> Column:
    """Mean confidence of a span's blocks."""
    total = F.aggregate(blocks, F.lit(0.0), lambda acc, b: acc + b["confidence"]) / F.size(blocks)
    return F.when(F.size(blocks) == 1, blocks[0]["confidence"]).otherwise(total)


def single_spans(blocks: DataFrame, px: int = STRIP_PX) -> DataFrame:
    """LAY5 without any layout: a block is its own span, so no line and no shuffle is needed
    (the nutrition flag is the block's own text only when the mask was not computed before)."""
    nutrition = F.col("nutrition") if "nutrition" in blocks.columns else is_nutrition(F.col("text"))
    keep = [c for c in ("scan_id", "image_type", "image_seq") if c in blocks.columns]
    member = F.struct("x1", "y1", "block_order", "block_id", "x2", "y2", "text", "confidence", nutrition.alias("nutrition"))
    return blocks.select(
        *keep, "image_id", strip(F.col("text")).alias("text"), F.array(member).alias("blocks"),
        F.lit(False).alias("is_multi_line"), F.lit(0).alias("stage"), F.col("block_order").cast("long").alias("a"),
        F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(1).alias("n_blocks"), F.col("confidence").alias("ocr_conf"),
    )
