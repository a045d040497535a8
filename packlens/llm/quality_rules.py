"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Counts of every whole text are taken in one map pass. For each (lang, source) a log-bucket quantile sketch of each ratio
is built as plain group counts: bucket counts of two sketches add up, so partial sketches merge map-side and
sketches of sources merge into those of their language and of the corpus without reading the texts again. Thresholds
are fences above the upper quartile of the documents that pass the base rules; a group with few of them takes the sketch of its
language, then of the corpus. Where a sketch has no spread at all, a share of ``TINY`` stands in for the fence, and a few offending
items (``RATIOS``) never fail a document. Verdicts are a join of counts with thresholds on (lang, source).

Words are runs of ``[^\\x20\\x09-\\x0D]+``. Fixed base rules: fewer than 20 words, or more than 30 % of the words in
8-word windows that occur twice.

Defined results: a null text has no words (and fails the base rule); null lang or source is a group of its own; each
row is judged by itself, repeated rows count as often as they occur; columns of the input that share a name with a
count are not touched, since counts travel in one struct column ``rule_counts``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import as_bytes, written

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps")
STRUCT = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
MIN_WORDS, REPEAT_PERCENT, RUN = 20, 30, 8
#: Relative error of a sketch, documents a group needs for thresholds of its own, width of the fence in interquartile ranges.
ERROR, MIN_GROUP, FENCE = 0.02, 200, 3.0
#: Limit of a share whose upper quartile is zero.
TINY = 0.01
#: Ratios, the count of offending items and how many of these any document may have, so that one repeated line or a short text's few
#: capitals do not fail it.
RATIOS = {
    "symbols": ("n_symbols / word_chars", "n_symbols", 10),
    "caps": ("n_caps / word_chars", "n_caps", 20),
    "dup_lines": ("n_dup_lines / n_lines", "n_dup_lines", 2),
    "repeats": ("n_repeat_words / n_words", "n_repeat_words", 4 * RUN),
    "word_length": ("word_chars / n_words", "word_chars", 100),
}

_SPACES = b" \t\n\r\x0b\x0c"
_CAPS = bytes(range(0x41, 0x5B))
_ODD = np.array([6364136223846793005], np.uint64)[0]


def _repeat_words(words: list[bytes]) -> int:
    """Words in runs of eight that occur at least twice; equal run hashes are confirmed on the words."""
    n = len(words) - RUN + 1
    if n < 2:
        return 0
    own: dict[bytes, int] = {}
    ids = np.array([own.setdefault(w, len(own)) for w in words], np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(RUN):
        key = key * _ODD + ids[k:k + n] * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    some = np.flatnonzero(twice)
    runs, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, RUN)[some], axis=0, return_inverse=True, return_counts=True)[1:]
    some = some[counts[runs.ravel()] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, some, 1)
    np.add.at(cover, some + RUN, -1)
    return int((np.cumsum(cover) > 0).sum())


def _counts(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    code_points = sum(map(len, words)) - (len(text) - len(text.translate(None, _CONTINUED)))
    return (len(words), code_points, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(words), len(lines),
            len(text) - len(text.translate(None, _CAPS)))


_CONTINUED = bytes(range(0x80, 0xC0))


def rule_counts(text: Column) -> Column:
    """Counts of a text as one struct. Python takes the text only and returns the counts; the other columns stay in the JVM."""

    def run(column: pa.Array) -> pa.Array:
        rows = [_counts(t) for t in as_bytes(column)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], list(COUNTS))

    return F.arrow_udf(run, STRUCT)(text)


def _ratio(name: str):
    return F.expr("try_divide({}, {})".format(*(f"rule_counts.{x.strip()}" for x in RATIOS[name][0].split("/"))))


def sketches(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Log-bucket sketch of each ratio: ``keys, ratio, bucket, n``; bucket null holds zeros. Adding ``n`` merges sketches."""
    values = F.array(*[F.struct(F.lit(r).alias("ratio"), _ratio(r).alias("value")) for r in RATIOS])
    rows = counted.select(*keys, F.inline(values)).where("value is not null")
    bucket = F.when(F.col("value") > 0, F.floor(F.log("value") / F.log(F.lit(1 + ERROR))).cast("int"))
    return rows.groupBy(*keys, "ratio", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartile_fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Upper fence of each ratio and group, with the number of values behind it; its width is three sketch errors at least."""
    window = Window.partitionBy(*keys, "ratio")
    ranked = sketch.select("*", F.sum("n").over(window).alias("total"), F.sum("n").over(window.orderBy(F.col("bucket").asc_nulls_first())).alias("upto"))
    value = F.coalesce(F.pow(F.lit(1 + ERROR), F.col("bucket") + 0.5), F.lit(0.0))
    low, high = (F.min(F.when(F.col("upto") >= q * F.col("total"), value)) for q in (0.25, 0.75))
    return ranked.groupBy(*keys, "ratio").agg(F.when(high > 0, high + FENCE * F.greatest(high - low, ERROR * high)).otherwise(TINY).alias("fence"), F.max("total").alias("n"))


def _base_failed() -> Column:
    c = F.col("rule_counts")
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])


def thresholds(counted: DataFrame) -> DataFrame:
    """One row per (lang, source) with the threshold of each ratio; documents that fail a base rule do not set thresholds."""
    fine = written(sketches(counted.where(~_base_failed()), ["lang", "source"]), "sketches")
    by_lang = quartile_fences(merged(fine, ["lang"]), ["lang"]).select(F.col("lang").alias("l"), F.col("ratio").alias("r"), F.col("fence").alias("f_lang"), F.col("n").alias("n_lang"))
    overall = quartile_fences(merged(fine, []), []).select(F.col("ratio").alias("o"), F.col("fence").alias("f_all"))
    own = quartile_fences(fine, ["lang", "source"])
    joined = own.join(by_lang, own["lang"].eqNullSafe(by_lang["l"]) & (own["ratio"] == by_lang["r"]), "left").join(overall, F.col("ratio") == F.col("o"), "left")
    fence = F.when(F.col("n") >= MIN_GROUP, F.col("fence")).when(F.col("n_lang") >= MIN_GROUP, F.col("f_lang")).otherwise(F.col("f_all"))
    limits = joined.select("lang", "source", "ratio", fence.alias("limit"))
    return limits.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).pivot("ratio", list(RATIOS)).agg(F.first("limit"))


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` with boolean columns ``rule_failed`` (a base rule) and ``rule_kept``."""
    c = F.col("rule_counts")
    base_failed = _base_failed()
    beyond = F.lit(False)
    for r, (_, items, few) in RATIOS.items():
        beyond = beyond | F.coalesce((_ratio(r) > F.col(f"limit_{r}")) & (c[items] > few), F.lit(False))
    limits = limits.select("t_lang", "t_source", *[F.col(r).alias(f"limit_{r}") for r in RATIOS])
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return joined.select(*[counted[f"`{x}`"] for x in counted.columns], base_failed.alias("rule_failed"), (~base_failed & ~beyond).alias("rule_kept"))


def _counted(docs: DataFrame, kept: Column) -> DataFrame:
    """``kept`` of each row as column ``own``, its group and its counts, written once: limits and verdicts read the same table."""
    group = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    return written(docs.select(kept.alias("own"), *group, rule_counts(F.col("text").cast("string")).alias("rule_counts")), "rule_counts")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each document."""
    counted = _counted(docs, F.col("doc_id"))
    named = [F.col("rule_counts")[c].alias(c) for c in COUNTS]
    found = judged(counted, thresholds(counted))
    return found.select(F.col("own").alias("doc_id"), *named[:5], F.col("rule_failed").alias("base_failed"), F.col("rule_kept").alias("kept"), *named[5:])


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that pass. Rows are written once with their counts, so that texts are counted once and meet no shuffle."""
    counted = _counted(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return judged(counted, written(thresholds(counted), "limits")).where("rule_kept").select("own.*")
