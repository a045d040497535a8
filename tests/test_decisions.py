"""Resolver, rules, conversation and file sources on small fixtures."""

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from packlens.operators import analytics as A
from packlens.operators import consolidate as C
from packlens.operators import conversation as CV
from packlens.operators import evaluate as EV
from packlens.operators import rules as RU
from packlens.operators import scans as SC
from packlens.sources import tables as T

CAND = (
    "scan_id string, declaration_type string, raw_text string, raw_value string, confidence double, confidence_level string, "
    "normalized struct<value:double,name:string>, breakdown struct<ocr_confidence:double,association_confidence:double,"
    "semantic_confidence:double,completeness_confidence:double>, image_id string, image_seq int, stage int, a bigint, b int, c int, "
    "ext_seq int, block_ids array<string>, x1 int, y1 int, x2 int, y2 int, has_conflict boolean"
)


def cand(scan, raw, conf, dims, seq=0, name=None):
    return (scan, "X", raw, raw, conf, "HIGH", (None, name), dims, f"i{seq}", seq, 0, 0, 0, 0, 0, [f"b{seq}"], 0, 0, 1, 1, False)


def test_resolver_outcomes(spark):
    good = (0.95, 0.85, 0.9, 0.9)
    rows = [
        cand("semantics", "NOT A COMMODITY", 0.99, (0.99, None, 0.4, None)),
        cand("compatible", "Pune", 0.6, (None, None, None, 0.3)), cand("compatible", "Flat 1, Pune, 411001", 0.9, good, 1),
        cand("different", "Mumbai, 400001", 0.9, good), cand("different", "Delhi, 110001", 0.95, good, 1),
        cand("same", "100", 0.85, good), cand("same", "100.00", 0.85, good, 1),
    ]
    got = {r["scan_id"]: r for r in C.resolve(spark.createDataFrame(rows, CAND)).collect()}
    assert got["semantics"]["resolution_status"] == "NEEDS_REVIEW"
    assert got["compatible"]["resolution_status"] == "AUTO_RESOLVED"
    assert got["different"]["resolution_status"] == "CONFLICT" and got["different"]["confidence"] == 0.0
    assert got["same"]["resolution_status"] == "AUTO_RESOLVED"


def test_rules(spark):
    scans = spark.createDataFrame([("empty",), ("low",), ("ok",)], "scan_id string")
    decls = spark.createDataFrame(
        [("low", "MRP", "MRP ??0", 0.55, "NOT_DETECTED", "b", 0), ("ok", "MRP", "MRP 5", 0.95, "AUTO_RESOLVED", "b", 0)],
        "scan_id string, declaration_type string, raw_text string, confidence double, resolution_status string, source_block_id string, seq int")
    findings = RU.evaluate_presence(scans, decls)
    by = {(r["scan_id"], r["rule_code"]): r for r in findings.collect()}
    assert len(by) == 12
    assert by["low", "LMR_2011_R06_MRP"]["status"] == "REVIEW" and by["ok", "LMR_2011_R06_MRP"]["status"] == "PASS"
    overall = {r["scan_id"]: r["overall_status"] for r in RU.compliance_summary(findings, decls).collect()}
    assert overall == {"empty": "FAIL", "low": "FAIL", "ok": "FAIL"}


def test_intents_and_history(spark):
    asked = [
        ("Hello there!", None, "GREETING_OR_CHITCHAT"), ("What is the MRP printed on the box?", None, "SPECIFIC_DECLARATION_CHECK"),
        ("The back photo is blurry and has too much glare", None, "IMAGE_QUALITY_DIAGNOSTIC"),
        ("What are the mandatory provisions under Rule 6 of LMR 2011?", None, "LEGAL_REGULATION_INQUIRY"),
        ("What is the price of it?", "Oil $1L", "SPECIFIC_DECLARATION_CHECK"), ("thanks a lot", None, "POLITENESS_OR_THANKS"),
    ]
    df = spark.createDataFrame([(m, p) for m, p, _ in asked], "text string, product_name string")
    got = {r["text"]: r for r in CV.classify_intents(df).collect()}
    assert [got[m]["intent"] for m, _, _ in asked] == [i for _, _, i in asked]
    assert got[asked[2][0]]["panel_referenced"] == "BACK"
    assert got[asked[4][0]]["rewritten_query"] == "What is the price of 'Oil $1L'?"
    talk = spark.createDataFrame([(1, i, "Human", f"Message {i}") for i in range(10)], "conv_id int, turn int, role string, text string")
    kept = CV.prune_history(talk).orderBy("turn").collect()
    assert len(kept) == 8 and kept[-1]["content"] == "Message 9" and kept[0]["role"] == "user"


def test_evaluator(spark):
    rows = [(f"s{i}", [("MRP", {"amount": "10"})], [("MRP", {"amount": "10"})]) for i in range(50)]
    labelled = spark.createDataFrame(rows, T.LABELLED_SCHEMA)
    assert EV.gate(labelled).first()["status"] == "COMPLETED"
    assert EV.gate(labelled.limit(0)).first()["status"] == "benchmark dataset pending"
    micro = EV.prf(EV.labelled_outcomes(labelled)).where("type = 'ALL'").first()
    assert (micro["tp"], micro["f1"]) == (50, 1.0)


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" MRP 10 \n", encoding="utf-8")
    (tmp_path / "a.JPG").write_bytes(b"x")
    (tmp_path / "b.png").write_bytes(b"yy")
    (tmp_path / "c.gif").write_bytes(b"z")
    cases = [{"id": f"c{i}", "description": "d", "image_condition": "x", "expected_pipeline_behavior": {"image_quality": "ok"}} for i in range(3)]
    (tmp_path / "cases.json").write_text(json.dumps(cases, indent=1))
    assert [tuple(r) for r in T.read_ground_truth(spark, str(tmp_path / "*.txt")).collect()] == [("a", "MRP 10")]
    assert sorted(r["filename"] for r in T.list_images(spark, str(tmp_path)).collect()) == ["a.JPG", "b.png"]
    assert T.read_cases(spark, str(tmp_path / "cases.json")).where("expected_pipeline_behavior.image_quality = 'ok'").count() == 3
    pairs = spark.createDataFrame([("a", "MRP 1O")], "stem string, hypothesis string").join(
        T.read_ground_truth(spark, str(tmp_path / "*.txt")), "stem", "left")
    assert EV.error_rates(pairs).select(F.col("cer")).first()["cer"] == 0.1667


def test_bulk_codes_are_dense_and_unique(spark):
    """One year holds nearly all rows; numbers go on after the highest code, in order, over many ranges."""
    scans = spark.createDataFrame([("SCAN-2025-000007",), ("SCAN-2025-000003",), ("SCAN-2024-x",)], "scan_code string")
    incoming = spark.range(5000).selectExpr("id", "case when id = 11 then null when id % 1000 = 5 then 2026 when id = 8 then 2024 else 2025 end as year", "id % 10 as at", "'n' as number_of")
    rows = SC.assign_codes(incoming, scans, ["at", "id"]).collect()
    assert len(rows) == 5000
    by_year = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
        by_year.setdefault(r["year"], []).append(r)
    for year, start in ((2025, 8), (2026, 1), (2024, 1)):
        assert [r["number"] for r in by_year[year]] == list(range(start, start + len(by_year[year])))
        assert by_year[year][0]["scan_code"] == f"SCAN-{year}-{start:06d}"
    assert by_year[None][0]["scan_code"] is None and SC.assign_codes(incoming.limit(0), scans, ["at", "id"]).count() == 0


def test_checklist_items_fan_out_behind_the_join(spark):
    scans = spark.createDataFrame([("s1",), ("s2",), ("s2",), (None,)], "scan_id string")
    rows = [("s1", "MRP", "CONFIRMED", False), ("s1", "MRP", "NEEDS_REVIEW", False), ("s1", "NET_QUANTITY", "REJECTED", False),
            ("s2", "MRP", "AUTO_RESOLVED", True), ("s2", "nothing", "CONFIRMED", False), (None, "MRP", "CONFIRMED", False)]
    decls = spark.createDataFrame(rows, "scan_id string, declaration_type string, resolution_status string, has_conflict boolean")
    items = A.checklist(scans, decls)
    # of the shuffles only the one of the counted facts is by item; the 19 items of each scan are not shuffled
    plan = A.completeness(items)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("item#" in line for line in keys) == 1
    found = sorted((r["scan_id"], r["status"], r["matching"]) for r in items.where("status <> 'NOT_DETECTED'").collect())
    assert found == [("s1", "CONFIRMED", 2), ("s1", "REJECTED", 1), ("s2", "CONFLICT", 1), ("s2", "CONFLICT", 1)] and items.count() == 4 * 19
    assert sorted(map(str, A.completeness(items).collect())) == sorted(map(str, [
        Row(scan_id="s1", present=1, of_items=19), Row(scan_id="s2", present=2, of_items=38), Row(scan_id=None, present=0, of_items=19)]))
