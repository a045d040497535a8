"""Rules from JSON rows against a plain evaluation, compiled and as data."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packlens.operators.rule_conditions import evaluate_rules

DECLS = ("scan_id int, declaration_id int, declaration_type string, confidence double, resolution_status string, raw_text string, "
         "normalized_value struct<currency:string,amount:double,taxes_inclusive:boolean>, extra map<string,string>, note string")
ROWS = [
    (1, 1, "MRP", 0.9, "AUTO_RESOLVED", "MRP Rs. 50.00", ("INR", 50.0, True), {"panel": "FRONT"}, '{"lot": {"n": 7}}'),
    (1, 2, "MRP", 0.75, "CONFIRMED", "MRP 20", ("USD", 20.0, False), {}, "{}"),
    (2, 3, "MRP", 0.75, "CONFIRMED", "", ("INR", None, True), None, None),
    (2, 4, "NET_QUANTITY", 0.5, "AUTO_RESOLVED", None, None, {"panel": "BACK"}, "no json"),
    (3, 5, "MRP", 0.99, "CONFLICT", "MRP 1", ("INR", 1.0, True), {}, None),
    (3, 6, None, 0.9, "CONFIRMED", "x", None, None, None),
]
SAMPLE = {"type": "presence", "target": "MRP", "min_confidence": 0.80, "conditions": [
    {"field": "normalized_value.currency", "operator": "in", "value": ["INR", "Rs", "₹"]}, {"field": "normalized_value.taxes_inclusive", "operator": "eq", "value": True}]}
VALUES = [("normalized_value.amount", "gte", 20), ("normalized_value.amount", "lte", 49.5), ("normalized_value.amount", "eq", 50), ("normalized_value.amount", "eq", "50.0"), ("normalized_value.amount", "in", [20, "x", 1]),
          ("normalized_value.currency", "neq", "INR"), ("raw_text", "regex", r"Rs\. \d+"), ("raw_text", "exists", True), ("raw_text", "exists", False), ("nowhere.at_all", "exists", None), ("extra.panel", "eq", "FRONT"),
          ("note.lot.n", "gte", 7), ("raw_text", "gte", "MRP 2"), (None, "eq", "x"), ("raw_text", None, "MRP 1"), ("raw_text", "almost", "MRP 1"), ("normalized_value.amount", "neq", None), ("normalized_value.amount", "eq", None), ("raw_text", "in", [])]


def rules():
    out = {"sample": SAMPLE, "none": {"target": "MRP"}, "no_target": {"conditions": []}, "soft": {**SAMPLE, "type": "conditional", "on_low_confidence": "FAIL"}, "broken": None}
    for i, (field, operator, value) in enumerate(VALUES):
        c = {"value": value} | ({"field": field} if field else {}) | ({"operator": operator} if operator else {})
        out[f"c{i}"] = {"target": "MRP", "conditions": [c]}
        out[f"q{i}"] = {"target": "NET_QUANTITY", "conditions": [c, SAMPLE["conditions"][0]]}
    return out


def text_of(decl, path):
    d = dict(zip(("scan_id", "declaration_id", "declaration_type", "confidence", "resolution_status", "raw_text", "normalized_value", "extra", "note"), decl))
    head, *rest = path.split(".")
    v = d.get(head)
    if head == "normalized_value" and v is not None and rest:
        v = dict(zip(("currency", "amount", "taxes_inclusive"), v)).get(rest[0])
    elif head == "extra" and rest:
        v = (v or {}).get(rest[0])
    elif head == "note" and rest:
        v = {'{"lot": {"n": 7}}': 7}.get(v)
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def same(v, o):
    if o is None:
        return v is None
    if v is None:
        return False
    if isinstance(o, bool):
        return v.lower() == str(o).lower()
    if isinstance(o, (int, float)):
        try:
            return float(v) == o
        except ValueError:
            return False
    return v == o


def met(decl, c):
    v, op, o = text_of(decl, c.get("field", "raw_text")), c.get("operator", "eq"), c.get("value")
    if op == "exists":
        return (v is None) if o is False else v is not None
    if op == "eq":
        return same(v, o)
    if v is None:
        return False
    if op == "neq":
        return not same(v, o)
    if op == "in":
        return any(same(v, x) for x in o)
    if op == "regex":
        return re.search(o, v) is not None
    if op in ("gte", "lte"):
        try:
            a, b = (v, o) if isinstance(o, str) else (float(v), o)
        except ValueError:
            return False
        return a >= b if op == "gte" else a <= b
    return False


def expected():
    out = []
    for code, r in rules().items():
        for d in ROWS:
            if r and r.get("target") and d[2] == r["target"]:
                own = r.get("conditions", [])
                n = sum(met(d, c) for c in own)
                status = ("REVIEW" if d[4] in ("NEEDS_REVIEW", "CONFLICT") else ("NOT_APPLICABLE" if r.get("type") == "conditional" else "FAIL") if n < len(own)
                          else r.get("on_low_confidence", "REVIEW") if d[3] < r.get("min_confidence", 0.7) else "PASS")
                out.append((code, d[0], d[1], len(own), n, status))
    return Counter(out)


@pytest.mark.parametrize("most", [256, 25])
def test_rules_from_json(spark, most):
    """``most`` below the number of distinct conditions: they are judged as data."""
    decls = spark.createDataFrame(ROWS, DECLS)
    table = spark.createDataFrame([(k, "{not json" if r is None else json.dumps(r, ensure_ascii=False)) for k, r in rules().items()], "rule_code string, rule string")
    got = Counter(map(tuple, evaluate_rules(decls, table, most=most).collect()))
    assert got == expected()


def test_no_rules_or_declarations(spark):
    decls = spark.createDataFrame(ROWS, DECLS)
    table = spark.createDataFrame([("sample", json.dumps(SAMPLE))], "rule_code string, rule string")
    assert evaluate_rules(decls.limit(0), table).count() == 0 and evaluate_rules(decls, table.where(F.lit(False))).count() == 0
