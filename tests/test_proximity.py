"""Neighbour join against all pairs, with cells divided and dealt; evidence payload."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.operators import proximity
from packlens.operators.evidence import evidence_payload

BOX = "image_id int, block_id int, block_order int, text string, x1 int, y1 int, x2 int, y2 int"


def boxes():
    r = np.random.default_rng(3)
    rows = []
    for image, count, wide, tall in ((1, 150, 3000, 3000), (2, 200, 60_000, 30), (3, 120, 5, 5), (4, 60, 400, 9000)):
        for i in range(count):
            x, y = int(r.integers(-50, wide)), int(r.integers(-50, tall))
            rows.append((image, 1000 * image + i, i, "t", x, y, x + int(r.integers(0, 400)), y + int(r.integers(0, 120))))
    rows.append((5, 9000, 0, "t", 10, 10, 5, 5))  # an inverted box
    rows.append((5, 9001, 1, "t", 12, 12, 14, 14))
    return rows


def gap(a1, a2, b1, b2):
    return b1 - a2 if a2 < b1 else a1 - b2 if b2 < a1 else 0


@pytest.mark.parametrize("dense", [2000, 20, 3])
def test_neighbours_equal_all_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(proximity, "DENSE", dense)
    rows = boxes()
    blocks = spark.createDataFrame(rows, BOX)
    anchors = blocks.where("block_order % 5 = 0").select("image_id", F.col("block_id").alias("anchor_id"), F.array("block_id").alias("block_ids"), "x1", "y1", "x2", "y2")
    expected = Counter()
    for a in rows:
        for b in rows:
            if a[2] % 5 == 0 and a[0] == b[0] and a[1] != b[1]:
                dx, dy = gap(a[4], a[6], b[4], b[6]), gap(a[5], a[7], b[5], b[7])
                if dx <= 250 and dy <= 80:
                    expected[a[0], a[1], b[1], dx, dy] += 1
    got = proximity.neighborhood(anchors, blocks).select("image_id", "anchor_id", "block_id", "dx", "dy")
    assert Counter(map(tuple, got.where("image_id < 5").collect())) == Counter({k: n for k, n in expected.items() if k[0] < 5})


def test_wide_dense_row_spreads(spark):
    """One row of 100,000 blocks: no cell key holds more than a few of them."""
    blocks = spark.range(100_000).selectExpr("1 image_id", "id block_id", "cast(id as int) block_order", "'t' text", "cast(id * 8 as int) x1", "0 y1", "cast(id * 8 + 30 as int) x2", "20 y2")
    anchors = blocks.where("block_id % 1000 = 0").select("image_id", F.col("block_id").alias("anchor_id"), F.array("block_id").alias("block_ids"), "x1", "y1", "x2", "y2")
    assert proximity.neighborhood(anchors, blocks).count() == sum(len(range(max(0, a - 35), min(100_000, a + 36))) - 1 for a in range(0, 100_000, 1000))
    cells = proximity._in_cells(blocks.selectExpr("*", "x1 rx1", "y1 ry1", "x2 rx2", "y2 ry2")).groupBy("cx", "cy").count()
    assert cells.agg(F.max("count")).first()[0] < 200


def test_evidence_payload(spark):
    blocks = spark.createDataFrame([("i", "b1", "MRP", 0.9, 1, 2, 3, 4), ("i", "b2", None, 0.4, 5, 1, 9, 3), ("j", "b1", "other", 0.1, 0, 0, 1, 1)], "image_id string, block_id string, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    found = [("i", "FRONT", "MRP", 1, 0, 0, 0, 0, ["b2", "b1"]), ("i", "FRONT", "MRP", 1, 1, 0, 0, 0, ["b1"]), ("i", None, "MRP", 2, 0, 0, 0, 0, []), ("j", "BACK", "MRP", 1, 0, 0, 0, 0, ["gone"])]
    candidates = spark.createDataFrame(found, "image_id string, image_type string, declaration_type string, stage int, a int, b int, c int, ext_seq int, block_ids array<string>")
    got = {(r["image_id"], r["stage"], r["a"]): r["evidence"].asDict(True) for r in evidence_payload(candidates, blocks).collect()}
    first = got["i", 1, 0]
    assert len(got) == 4 and first["bounding_box"] == {"x1": 1, "y1": 1, "x2": 9, "y2": 4} and first["average_ocr_confidence"] == 0.65 and first["image_type"] == "FRONT"
    assert [b["id"] for b in first["blocks"]] == first["ocr_block_ids"] == ["b2", "b1"] and first["blocks"][0] == {"id": "b2", "text": None, "confidence": 0.4, "bbox": {"x1": 5, "y1": 1, "x2": 9, "y2": 3}}
    for key in (("i", 2, 0), ("j", 1, 0)):
        assert got[key]["contributing_blocks_count"] == 0 and got[key]["average_ocr_confidence"] == 0.0 and got[key]["bounding_box"] == {"x1": 0, "y1": 0, "x2": 0, "y2": 0}


def test_evidence_payload_reads_stored_candidates(spark):
    blocks = spark.createDataFrame([("i", "b1", "MRP", 0.9, 1, 2, 3, 4)], "image_id string, block_id string, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    candidates = spark.createDataFrame([("i", "FRONT", "MRP", 1, 0, 0, 0, 0, ["b1"])], "image_id string, image_type string, declaration_type string, stage int, a int, b int, c int, ext_seq int, block_ids array<string>")
    plan = evidence_payload(candidates, blocks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("FileScan parquet") == 2
