"""Confidence, geometry and error-rate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.functions.text import words


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def level_of(score: Column) -> Column:
    return (
        F.when(score >= V.LEVEL_HIGH, "HIGH").when(score >= V.LEVEL_MEDIUM, "MEDIUM").otherwise("LOW")
    )


def confidence(ocr: Column, has_label: Column, pattern: Column, spatial: Column, validity: Column,
               penalty: Column | None = None, corroborated: Column | None = None) -> Column:
    """SC13: weighted sum of the evidence dimensions, clamped to [0, 1]."""
    label = F.when(has_label, 1.0).otherwise(0.65)
    total = (
        0.30 * _unit(ocr) + 0.25 * label + 0.22 * _unit(pattern) + 0.13 * _unit(validity) + 0.10 * _unit(spatial)
    )
    if corroborated is not None:
        total = total + F.when(corroborated, 0.05).otherwise(0.0)
    if penalty is not None:
        total = total - penalty
    return F.round(_unit(total), 4)


def breakdown(ocr: Column, has_label: Column, pattern: Column, spatial: Column, validity: Column,
              corroborated: Column | None = None, penalty: Column | None = None) -> Column:
    """SC14: the dimensions the resolver gates on."""
    label = F.when(has_label, 1.0).otherwise(0.65)
    corr = F.lit(False) if corroborated is None else corroborated
    return F.struct(
        F.round(ocr, 4).alias("ocr_confidence"),
        F.round((label + spatial) / 2, 4).alias("association_confidence"),
        F.round((pattern + validity) / 2, 4).alias("semantic_confidence"),
        F.round(validity, 4).alias("completeness_confidence"),
        F.when(corr, 0.55).otherwise(0.5).alias("consistency_confidence"),
        has_label.alias("has_explicit_label"),
        corr.alias("cross_panel_corroborated"),
        F.round(F.lit(0.0) if penalty is None else penalty, 4).alias("penalty"),
    )


def confidence_tier(score: Column) -> Column:
    """SC20: display tier."""
    return F.when(score >= 0.8, "green").when(score >= 0.6, "amber").otherwise("red")


# -------------------------------------------------------------------- geometry
def union_bbox(blocks: Column) -> Column:
    """LAY9: tight box around an array of blocks; zeros for an empty array."""

    def edge(name: str, agg) -> Column:
        return F.coalesce(agg(F.transform(blocks, lambda b: b[name])), F.lit(0)).alias(name)

    return F.struct(edge("x1", F.array_min), edge("y1", F.array_min), edge("x2", F.array_max), edge("y2", F.array_max))


def mean_confidence(blocks: Column) -> Column:
    """LAY8: mean confidence of an array of blocks, 0 when empty."""
    return F.when(
        F.size(blocks) > 0,
        F.aggregate(blocks, F.lit(0.0), lambda acc, b: acc + b["confidence"]) / F.size(blocks),
    ).otherwise(0.0)


def average_ocr_confidence(blocks: Column) -> Column:
    """LAY10."""
    return F.round(mean_confidence(blocks), 4)


def edge_gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Distance between two intervals, 0 when they overlap."""
    return F.when(hi_a < lo_b, lo_b - hi_a).when(hi_b < lo_a, lo_a - hi_b).otherwise(0)


def polygon_to_block(polygon: Column, scale: Column, width: Column, height: Column) -> Column:
    """LAY12: polygon in OCR pixels -> clamped polygon and box in source pixels."""

    def clamp(v: Column, size: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.least(size.cast("double"), v / scale)), 1)

    scaled = F.transform(polygon, lambda p: F.array(clamp(p[0], width), clamp(p[1], height)))

    def edge(i: int, agg) -> Column:
        return agg(F.transform(scaled, lambda p: p[i])).cast("int")

    return F.struct(
        scaled.alias("polygon"),
        edge(0, F.array_min).alias("x1"), edge(1, F.array_min).alias("y1"),
        edge(0, F.array_max).alias("x2"), edge(1, F.array_max).alias("y2"),
    )


def clamp_confidence(raw: Column) -> Column:
    """Unreadable confidences count as 0.5."""
    return F.round(_unit(F.coalesce(raw.try_cast("double"), F.lit(0.5))), 4)


def megapixels(width: Column, height: Column) -> Column:
    """SC19."""
    return F.round(width.cast("double") * height / 1e6, 3)


# ----------------------------------------------------------------- error rates
def _rate(distance: Column, n_ref: Column, n_hyp: Column) -> Column:
    return F.when(n_ref == 0, F.when(n_hyp == 0, 0.0).otherwise(1.0)).otherwise(
        F.round(F.least(F.lit(1.0), distance / n_ref), 4)
    )


def cer(reference: Column, hypothesis: Column) -> Column:
    """AGG13: character error rate."""
    return _rate(F.levenshtein(reference, hypothesis), F.length(reference), F.length(hypothesis))


def wer(reference: Column, hypothesis: Column) -> Column:
    """AGG14: word error rate.

    Words that both sides hold become code points of the supplementary planes, so the built-in character distance counts
    words. Words of one side only equal nothing on the other, so one code point a side stands for all of them: the limit of 2^20
    code points is on distinct shared words, however many others there are.
    """
    from packlens.functions.text import let

    def distance(pair: Column) -> Column:
        def encode(side: Column, shared: Column, alone: int) -> Column:
            code = lambda w: let(F.array_position(shared, w), lambda p: F.when(p > 0, p + 0xFFFF).otherwise(alone))
            return F.decode(F.unhex(F.array_join(F.transform(side, lambda w: F.lpad(F.hex(code(w)), 8, "0")), "")), "UTF-32")

        return _rate(
            let(F.array_intersect(pair["ref"], pair["hyp"]), lambda v: F.levenshtein(encode(pair["ref"], v, 1), encode(pair["hyp"], v, 2))),
            F.size(pair["ref"]), F.size(pair["hyp"]),
        )

    return let(F.struct(words(reference).alias("ref"), words(hypothesis).alias("hyp")), distance)
