"""Golden cases of the value normalisers."""

import pytest
from pyspark.sql import functions as F

from packlens.functions import normalize as N
from packlens.functions import scores as S
from packlens.functions.text import title_case, truncate_message


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,amount", [("10", 10.0), ("99.00", 99.0), ("120,50", 120.5), ("1,299", 1299.0),
                                        ("3,500.00", 3500.0), ("0", None), ("100000", None), ("abc", None)])
def test_amount(spark, raw, amount):
    assert one(spark, N.norm_amount(F.lit(raw))["amount"]) == amount


@pytest.mark.parametrize("value,unit,out,canonical", [
    ("79", "g", "g", 79.0), ("500", "gm", "g", 500.0), ("1", "kg", "kg", 1000.0), ("750", "mL", "ml", 750.0),
    ("2", "litres", "L", 2000.0), ("475", None, None, None), ("30", "Tablets", "tablets", 30.0), ("1", "U", "units", 1.0)])
def test_quantity(spark, value, unit, out, canonical):
    q = one(spark, N.norm_quantity(F.lit(value), F.lit(unit).cast("string")))
    assert (q["unit"], q["canonical_value"]) == (out, canonical)


@pytest.mark.parametrize("text,date", [
    ("08/2026", "2026-08"), ("AUG 2026", "2026-08"), ("15/08/2026", "2026-08-15"), ("31/02/2026", "2026-02-31"),
    ("15 AUG 26", "2026-08-15"), ("12/25", "2025-12"), ("Nov 2025", "2025-11")])
def test_date(spark, text, date):
    assert one(spark, N.norm_date(F.lit(text), F.lit("EXPIRY_DATE")))["date"] == date


def test_relative_date_and_no_date(spark):
    d = one(spark, N.norm_date(F.lit("Best Before 9 Months From Manufacture"), F.lit("BEST_BEFORE")))
    assert (d["date"], d["is_relative"], d["relative_duration"], d["relative_unit"]) == (None, True, 9, "MONTHS")
    assert one(spark, N.norm_date(F.lit("05/2005"), F.lit("x"))) is None  # years 2000-2019 are not read


def test_country(spark):
    c = one(spark, N.norm_country(F.lit("BANGLADESH")))
    assert (c["country"], c["is_recognized"]) == ("Bangladesh", True)
    assert one(spark, N.norm_country(F.lit("INDONESIA JAKARTA")))["country"] == "India"  # first alias contained
    assert one(spark, N.norm_country(F.lit("high valley")))["country"] == "High Valley"


def test_contacts(spark):
    assert one(spark, N.norm_email(F.lit("care @ example . com")))["email"] == "care@example.com"
    assert one(spark, N.norm_phone(F.lit("10015043001129")))["valid"] is False
    assert one(spark, N.norm_phone(F.lit("+91 9876543210")))["number"] == "+91 98765 43210"


@pytest.mark.parametrize("raw,code", [("AB23K91", "AB23K91"), ("printed on the pack", None), ("No", None),
                                      ("STREET, KOLKATA-700017, WEST BENGAL", None), ("PLAIN", None), ("LOT A12", "A12")])
def test_batch(spark, raw, code):
    assert one(spark, N.batch_value(F.lit(raw))) == code


def test_commodity_and_titles(spark):
    assert one(spark, N.norm_commodity(F.lit("BISCUITS")))["commodity_name"] == "Biscuits"
    assert one(spark, N.norm_commodity(F.lit("(")))["commodity_name"] is None
    assert one(spark, title_case(F.lit("haldiram's high-fiber"))) == "Haldiram'S High-Fiber"


@pytest.mark.parametrize("line,name,address", [
    ("ABC LTD., PLOT 5 ROAD, PUNE 411001", "ABC LTD.", "PLOT 5 ROAD, PUNE 411001"),
    ("Foo Enterprises, 12/4 Baker Lane", "Foo Enterprises", "12/4 Baker Lane"),
    ("XYZ Foods - Kochi 682001", "XYZ Foods", "- Kochi 682001"),
    ("Simple Name", "Simple Name", None)])
def test_split_name_address(spark, line, name, address):
    r = one(spark, N.split_name_address(F.lit(line)))
    assert (r["name"], r["address"]) == (name, address)


def test_confidence_and_error_rates(spark):
    c = one(spark, S.confidence(F.lit(0.95), F.lit(True), F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert abs(c - 0.985) < 1e-4
    assert one(spark, S.wer(F.lit("a b c"), F.lit("a x c d"))) == 0.6667
    assert one(spark, S.cer(F.lit(""), F.lit("x"))) == 1.0
    assert one(spark, truncate_message(F.lit("x" * 401), 400)).endswith("x... [truncated]")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_wer_against_brute_force(spark):
    pairs = [("the cat sat on the mat", "the cat on mat the"), ("a", "b c d"), ("é ü é", "é é"), ("x y z", "")]
    got = spark.createDataFrame(pairs, "r string, h string").select("r", "h", S.wer(F.col("r"), F.col("h")).alias("w")).collect()
    for r in got:
        ref, hyp = r["r"].split(), r["h"].split()
        assert abs(r["w"] - min(1.0, levenshtein(ref, hyp) / len(ref))) < 1e-4


def test_wer_beyond_a_million_distinct_words(spark):
    """Words of one side only share a code point, so more of them than there are code points change nothing."""
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_200_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("r"))
    got = long.select(S.wer(F.col("r"), F.lit("w2 zz w1200000")).alias("a"), S.wer(F.lit("w7 x w9 w7"), F.concat(F.lit("w7 y "), F.col("r"))).alias("b")).first()
    assert got["a"] == 1.0 and got["b"] == 1.0
    pairs = [(a, b) for a in ("p q r s", "p x q y r", "x x y", "q p") for b in ("p q", "z p z q z r", "r q p", "z z z")]
    for r in spark.createDataFrame(pairs, "r string, h string").select("r", "h", S.wer(F.col("r"), F.col("h")).alias("w")).collect():
        ref, hyp = r["r"].split(), r["h"].split()
        assert abs(r["w"] - min(1.0, levenshtein(ref, hyp) / len(ref))) < 1e-4
