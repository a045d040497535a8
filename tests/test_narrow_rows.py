"""Consolidation carries the columns that are read, and decides the same with them; reviews are folded without Python."""

from packlens.functions import fixed_values as V
from packlens.operators import consolidate as C
from packlens.operators import extract as E
from packlens.streaming import streams as ST

LABEL = ("breakdown.has_explicit_label", "normalized.is_multipack")
DECIDING = (*LABEL, *[f"breakdown.{c}_confidence" for c in V.AUTO_RESOLVE_MIN], "normalized.value", "normalized.name", "raw_text", "raw_value", "x1", "y1", "x2", "y2")
GROUP = ["scan_id", "declaration_type"]


def _found(make_blocks):
    return E.extract_candidates(make_blocks({
        ("a", "FRONT"): [(0, "MRP Rs. 50.00 (Incl. of all taxes)", 0.9, 10, 20, 300, 40), (1, "Net Qty 80 g", 0.9, 10, 100, 200, 120)],
        ("b", "BACK"): [(0, "MRP Rs. 50.00", 0.8, 10, 20, 300, 40), (1, "NET WEIGHT 90 g", 0.95, 10, 100, 200, 120), (2, "Rs. 70/-", 0.9, 10, 300, 100, 320),
                        (3, "Consumer Care: 1800-425-4449", 0.9, 10, 500, 300, 520)],
    }), ("mrp", "quantity", "care")).localCheckpoint()


def test_narrowed_candidates_decide_the_same(make_blocks):
    """Rows with only what is read later: the same values, conflicts and decisions."""
    found = _found(make_blocks)
    steps = [
        (("raw_value",), C.merge_same_value, [*GROUP, "raw_value", "image_id", "confidence", "n_merged", "n_cross"]),
        (("raw_value", *LABEL), C.consolidate, [*GROUP, "raw_value", "image_id", "confidence", "has_conflict", "confidence_level"]),
        (DECIDING, lambda c: C.resolve(C.consolidate(c)), [*GROUP, "resolution_status", "raw_value", "confidence", "n_candidates"]),
    ]
    for columns, step, read in steps:
        whole, thin = (sorted(map(str, step(C.arbitrate(c)).select(*read).collect())) for c in (found, C.narrowed(found, *columns)))
        assert whole == thin and len(whole) > 2


def test_merged_rows_hold_what_was_named(make_blocks):
    found = _found(make_blocks)
    thin = C.merge_same_value(C.arbitrate(C.narrowed(found, "raw_value", *LABEL)))
    assert not {"raw_text", "spatial_relation", "x1"} & set(thin.columns) and "raw_value" in thin.columns
    assert thin.schema["normalized"].dataType.names == ["is_multipack"] and thin.schema["breakdown"].dataType.names == ["has_explicit_label"]
    whole = C.merge_same_value(C.arbitrate(found))
    assert {"raw_text", "normalized", "breakdown"} <= set(whole.columns)


def test_reviews_are_folded_without_python(spark, tmp_path):
    schema = "declaration_id long, action string, value string, reviewed_by string, acted_at timestamp, action_id long"
    states = ST.review_states(spark.readStream.schema(schema).parquet(str(tmp_path)))
    assert "InPandas" not in states._jdf.queryExecution().analyzed().toString()
    assert states.columns == ["declaration_id", "t", "action_id", "action", "value", "reviewed_by", "fixed", "fix_t", "fix_id", "fix_value"]
