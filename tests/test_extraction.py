"""Golden packages: blocks in, typed candidates out."""

from pyspark.sql import functions as F

from packlens.functions.text import FIRST, ci
from packlens.operators import consolidate as C
from packlens.operators import extract as E
from packlens.operators import layout as L

# FIXED VALUES: label texts of the golden cases, as the contract gives them (FULL_PANEL, PACKS).
FULL_PANEL = [
    ("b1", "BRITANNIA GOOD DAY BUTTER COOKIES", 0.98, 10, 20, 300, 50), ("b2", "GENERIC NAME: BISCUITS", 0.95, 10, 60, 200, 80),
    ("b3", "NET WEIGHT 827 g", 0.96, 10, 90, 180, 110), ("b4", "10 N x 82.7 g = 827 g", 0.94, 10, 120, 240, 140),
    ("b5", "MRP Rs. 120.00 (INCL. OF ALL TAXES)", 0.97, 10, 150, 320, 170),
    ("b6", "NUTRITION INFORMATION (Approx. per 100g)", 0.96, 10, 200, 350, 220),
    ("b7", "Serving Size: Approx. 15g (Approx. 2 Biscuits)", 0.95, 10, 230, 350, 250),
    ("b8", "Energy 492 kcal, Protein 7g", 0.94, 10, 260, 300, 280),
    ("b9", "Total Sugars 20.5g, Added Sugars 20.3g", 0.95, 10, 290, 320, 310), ("b10", "Trans fatty acids 0g", 0.94, 10, 320, 220, 340),
    ("b11", "Lic. No. 10015043001129", 0.95, 10, 360, 250, 380),
    ("b12", "For Feedback Contact Consumer Care: 1-800-4254449", 0.96, 10, 400, 400, 420),
    ("b13", "E-mail: feedback@britindia.com", 0.97, 10, 430, 280, 450), ("b14", "Batch No. printed on the pack", 0.93, 10, 460, 260, 480),
]
PACKS = {
    "quantity": [("b1", "Net", 0.95, 10, 100, 40, 120), ("b2", "Qty", 0.94, 45, 100, 75, 120), ("b3", "79", 0.98, 80, 100, 100, 120),
                 ("b4", "g", 0.92, 105, 100, 115, 120)],
    "noisy": [("b1", "NETWEIGHT: 475 MRPE PKD1 BATCH:", 0.95, 10, 100, 300, 130)],
    "mrpe": [("b1", "MRPE 20.00 (INCL OF ALL TAXES)", 0.95, 10, 100, 200, 130)],
    "lot": [("b1", "LOT No.", 0.99, 10, 10, 80, 30)],
    "batch": [("b1", "Batch No. AB23K91", 0.99, 10, 10, 100, 30)],
    "compact": [("b1", "10Nx82.7g=827g", 0.99, 10, 10, 150, 30)],
    "phone": [("b1", "1-800-4254449", 0.99, 10, 10, 150, 30)],
    "marketer": [("b1", "Marketed By:", 0.99, 10, 10, 150, 30), ("b2", "BRITANNIA INDUSTRIES LTD.,", 0.99, 10, 50, 150, 70),
                 ("b3", "5/1A HUNGERFORD STREET, KOLKATA-700017", 0.99, 10, 90, 150, 110)],
    "packed": [("b1", "PKD.", 0.99, 10, 10, 50, 30), ("b2", "08/2026", 0.99, 60, 10, 150, 30)],
    "pouch": [("b1", "Haldiram's Bhujia", 0.99, 10, 10, 200, 30), ("b2", "NET WEIGHT 5 N x 200 g = 1 kg", 0.96, 10, 50, 300, 80),
              ("b3", "MRP Rs 250/- (Incl. of all taxes)", 0.98, 10, 100, 280, 130), ("b4", "Lic. No. 10012022000213", 0.95, 10, 150, 250, 180),
              ("b5", "Batch No. BJU459", 0.97, 10, 200, 200, 230)],
    "cosmetic": [("b1", "Generic Name: Body Wash", 0.95, 10, 10, 200, 30), ("b2", "Net Vol. 250 ml", 0.97, 10, 50, 150, 80),
                 ("b3", "Mfg. Date: 12/2025", 0.98, 10, 100, 180, 130), ("b4", "See bottom for Batch No.", 0.95, 10, 150, 250, 180),
                 ("b5", "Marketed By: ABC Cosmetics LLP", 0.99, 10, 200, 300, 230), ("b6", "Mumbai 400001", 0.99, 10, 240, 150, 270)],
    "mouse": [("b1", "Name of Commodity", 0.98, 10, 10, 180, 30), ("b2", "Wireless Mouse", 0.99, 10, 40, 180, 70),
              ("b3", "SKU: M-8930", 0.95, 10, 80, 150, 110), ("b4", "Net Quantity: 1U", 0.98, 10, 120, 180, 150),
              ("b5", "Country of Origin", 0.99, 10, 160, 180, 190), ("b6", "Vietnam", 0.98, 10, 200, 150, 230),
              ("b7", "Maximum Retail Price ₹1,299", 0.97, 10, 240, 300, 270)],
    "detergent": [("b1", "Detergent Powder", 0.98, 10, 10, 180, 30), ("b2", "MRP: ₹3,500.00 (inclusive of taxes)", 0.99, 10, 50, 350, 80),
                  ("b3", "Manufactured & Marketed By:", 0.96, 10, 90, 280, 120), ("b4", "CleanCo Enterprises Private Limited", 0.99, 10, 130, 320, 160),
                  ("b5", "Plot 42, Sector 5", 0.99, 10, 170, 200, 200), ("b6", "Gurugram, Haryana - 122001", 0.99, 10, 210, 250, 240),
                  ("b7", "Email: help@cleanco.in", 0.98, 10, 250, 250, 280)],
    "screws": [("b1", "Steel Screws 10mm", 0.98, 10, 10, 200, 30), ("b2", "Quantity: 50 Pieces", 0.96, 10, 50, 200, 80),
               ("b3", "MFG: Nov 2025", 0.95, 10, 90, 150, 120), ("b4", "Imported By: Hardware India Ltd.", 0.99, 10, 130, 320, 160),
               ("b5", "Made in Taiwan", 0.98, 10, 170, 200, 200), ("b6", "MRP: Rs. 499/-", 0.97, 10, 210, 200, 240)],
    "full": FULL_PANEL,
}


def test_golden_packages(spark, make_blocks):
    blocks = make_blocks({(name, "BACK"): rows for name, rows in PACKS.items()}).withColumn("scan_id", F.col("image_id"))
    rows = C.arbitrate(E.extract_candidates(blocks)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["stage"], r["a"], r["b"], r["c"], r["ext_seq"])):
        by.setdefault((r["image_id"], r["declaration_type"]), []).append(r)

    def first(image, dtype):
        return by[image, dtype][0]

    def last(image, dtype):  # the reference cases look at the last candidate of a type
        return by[image, dtype][-1]

    q = first("quantity", "NET_QUANTITY")
    assert (q["normalized"]["value"], q["normalized"]["unit"], q["x1"], q["x2"]) == (79.0, "g", 10, 115) or len(q["block_ids"]) < 4
    whole = [r for r in by["quantity", "NET_QUANTITY"] if len(r["block_ids"]) == 4][0]
    assert (whole["normalized"]["value"], whole["normalized"]["unit"], whole["x1"], whole["x2"]) == (79.0, "g", 10, 115)
    noisy = first("noisy", "NET_QUANTITY")
    assert (noisy["normalized"]["value"], noisy["normalized"]["unit"]) == (475.0, None) and noisy["confidence_level"] != "HIGH"
    assert ("noisy", "DATE_OF_PACKING") not in by and ("noisy", "MRP") not in by
    assert (first("mrpe", "MRP")["normalized"]["amount"], first("mrpe", "MRP")["normalized"]["taxes_inclusive"]) == (20.0, True)
    assert ("lot", "BATCH_OR_LOT_NUMBER") not in by and first("batch", "BATCH_OR_LOT_NUMBER")["raw_value"] == "AB23K91"
    assert ("compact", "NET_QUANTITY") in by and ("compact", "BATCH_OR_LOT_NUMBER") not in by
    assert ("phone", "CONSUMER_CARE_PHONE") in by and ("phone", "BATCH_OR_LOT_NUMBER") not in by
    best = max(by["marketer", "MARKETER_NAME"], key=lambda r: r["confidence"])
    assert best["raw_value"] == "BRITANNIA INDUSTRIES LTD."
    assert first("marketer", "MARKETER_ADDRESS")["raw_value"] == "5/1A HUNGERFORD STREET, KOLKATA-700017"
    packed = first("packed", "DATE_OF_PACKING")
    assert (packed["raw_value"], packed["spatial_relation"]) == ("08/2026", "nearby_block")
    assert last("pouch", "NET_QUANTITY")["normalized"]["canonical_value"] == 1000.0
    assert last("pouch", "MRP")["normalized"]["amount"] == 250.0 and last("pouch", "BATCH_OR_LOT_NUMBER")["raw_value"] == "BJU459"
    assert ("pouch", "CONSUMER_CARE_PHONE") not in by
    assert last("cosmetic", "NET_QUANTITY")["normalized"]["value"] == 250.0
    assert last("cosmetic", "DATE_OF_MANUFACTURE")["normalized"]["date"] == "2025-12"
    assert ("cosmetic", "BATCH_OR_LOT_NUMBER") not in by
    assert "ABC Cosmetics LLP" in last("cosmetic", "MARKETER_NAME")["raw_value"]
    assert last("mouse", "COMMODITY_NAME")["normalized"]["commodity_name"] == "Wireless Mouse"
    assert last("mouse", "NET_QUANTITY")["normalized"]["value"] == 1.0
    assert last("mouse", "COUNTRY_OF_ORIGIN")["normalized"]["country"] == "Vietnam"
    assert last("mouse", "MRP")["normalized"]["amount"] == 1299.0
    assert last("detergent", "MRP")["normalized"]["amount"] == 3500.0
    assert "CleanCo" in last("detergent", "MANUFACTURER_NAME")["raw_value"] and ("detergent", "MARKETER_NAME") in by
    assert "Haryana" in last("detergent", "MANUFACTURER_ADDRESS")["raw_value"]
    assert last("detergent", "CONSUMER_CARE_EMAIL")["normalized"]["email"] == "help@cleanco.in"
    assert last("screws", "NET_QUANTITY")["normalized"]["value"] == 50.0
    assert last("screws", "DATE_OF_MANUFACTURE")["normalized"]["date"] == "2025-11"
    assert "Hardware India" in last("screws", "IMPORTER_NAME")["raw_value"]
    assert last("screws", "COUNTRY_OF_ORIGIN")["normalized"]["country"] == "Taiwan"


def test_full_panel_has_no_conflicts(spark, make_blocks):
    cons = C.consolidate(C.arbitrate(E.extract_candidates(make_blocks({("full", "BACK"): FULL_PANEL}))))
    by = {r["declaration_type"]: r for r in cons.collect()}
    assert by["NET_QUANTITY"]["normalized"]["canonical_value"] == 827.0
    assert by["MRP"]["normalized"]["amount"] == 120.0
    assert by["COMMODITY_NAME"]["normalized"]["commodity_name"] == "Biscuits"
    assert "1800" in by["CONSUMER_CARE_PHONE"]["normalized"]["digits"]
    assert by["CONSUMER_CARE_EMAIL"]["normalized"]["email"] == "feedback@britindia.com"
    assert "BATCH_OR_LOT_NUMBER" not in by
    assert not any(r["has_conflict"] for r in by.values())


def test_conflicting_prices_on_two_panels(spark, make_blocks):
    blocks = make_blocks({("f", "FRONT"): [("b", "MRP ₹10", 0.95, 20, 20, 100, 40)], ("b", "BACK"): [("b", "MRP ₹20", 0.94, 20, 20, 100, 40)]})
    rows = C.consolidate(C.arbitrate(E.extract_candidates(blocks))).where("declaration_type = 'MRP'").collect()
    assert len(rows) == 2 and all(r["has_conflict"] for r in rows) and all(r["confidence_level"] == "MEDIUM" for r in rows)
    resolved = C.resolve(C.consolidate(C.arbitrate(E.extract_candidates(blocks)))).collect()
    assert {r["resolution_status"] for r in resolved if r["declaration_type"] == "MRP"} == {"NOT_DETECTED"}


def test_reading_order(spark, make_blocks):
    blocks = make_blocks({("i", "FRONT"): [("1", "Bottom", 0.9, 50, 300, 200, 330), ("2", "Top Right", 0.9, 300, 50, 450, 80),
                                           ("3", "Top Left", 0.9, 50, 50, 200, 80)]})
    got = [r["text"] for r in L.reading_order(blocks).orderBy("reading_pos").collect()]
    assert got == ["Top Left", "Top Right", "Bottom"]


def tall_image(n=120):
    """A long page: lines of two blocks, some overlapping, with nutrition rows and separated dates."""
    rows = []
    for i in range(n):
        y = i * 24
        text = ["MRP Rs. %d.00" % (i + 1), "Protein 6.7 g", "PKD.", "Batch No.", "Marketed By: Foo %d Ltd., Plot 4" % i, "Sector 9"][i % 6]
        rows.append((f"l{i}", text, 0.9, 10, y, 150, y + 20))
        rows.append((f"r{i}", ["500 g", "12/2025", "AB%d" % i, "word"][i % 4], 0.8, 160, y + (i % 5), 300, y + 18 + (i % 9)))
    return rows


def test_strips_do_not_change_results(spark, make_blocks):
    """Splitting a tall image into strips gives the spans and candidates of the unsplit image."""
    blocks = make_blocks({("tall", "OTHER"): tall_image(), ("small", "BACK"): FULL_PANEL})

    def result(px):
        return {(r["image_id"], r["declaration_type"], r["raw_value"], tuple(r["block_ids"]), r["confidence"])
                for r in E.extract_candidates(blocks, px=px).collect()}

    whole, split = result(100000), result(640)
    assert whole == split and len(whole) > 300
    assert L.cluster_lines(blocks, 640).where("strip > 0").count() > 0


def brute_lines(blocks):
    lines = []
    for b in sorted(blocks, key=lambda b: (b["y1"], b["x1"], b["block_order"])):
        for ln in lines:
            y1, y2 = min(x["y1"] for x in ln), max(x["y2"] for x in ln)
            limit = 0.6 * min(max(1, b["y2"] - b["y1"]), max(1, y2 - y1))
            if abs((b["y1"] + b["y2"]) / 2 - (y1 + y2) / 2) <= limit:
                ln.append(b)
                break
        else:
            lines.append([b])
    return {tuple(sorted(x["block_id"] for x in ln)) for ln in lines}


def test_lines_against_brute_force(spark, make_blocks):
    import random

    rng = random.Random(7)
    rows = []
    for i in range(400):
        y, x = rng.randrange(0, 2500), rng.randrange(0, 300)
        rows.append((str(i), "t", 0.9, x, y, x + 20, y + rng.choice([0, 1, 2, 8, 20, 21, 60])))
    blocks = make_blocks({("r", "OTHER"): rows})
    expected = brute_lines([r.asDict() for r in blocks.collect()])
    for px in (700, 100000):
        got = {tuple(sorted(b["block_id"] for b in r["blocks"])) for r in L.cluster_lines(blocks, px).collect()}
        assert got == expected


def test_row_order_does_not_matter(spark, make_blocks):
    blocks = make_blocks({("full", "BACK"): FULL_PANEL})
    a = C.consolidate(C.arbitrate(E.extract_candidates(blocks))).select("declaration_type", "raw_value", "confidence").collect()
    b = C.consolidate(C.arbitrate(E.extract_candidates(blocks.orderBy(F.desc("block_id"))))).select("declaration_type", "raw_value", "confidence").collect()
    assert sorted(a) == sorted(b)


def test_strips_do_not_change_line_numbers(make_blocks):
    from packlens.operators.layout import cluster_lines, image_lines

    blocks = [(f"b{i}", f"line {i}", 0.9, 10, i * 20 + i % 3, 200, i * 20 + 16) for i in range(300)]
    tall = make_blocks({("tall", "OTHER"): blocks})

    def rows(px):
        out = image_lines(cluster_lines(tall, px))
        return sorted((r["line_no"], r["y1"], r["up"] and r["up"]["y2"]) for r in out.collect())

    assert rows(640) == rows(100_000) and [r[0] for r in rows(640)] == list(range(300))


def test_spans_without_guards_are_not_built(make_blocks):
    # anchor and value on different lines, a toll-free number that a line end divides, spaces of other alphabets
    pack = [("b1", "MRP", 0.9, 10, 10, 60, 30), ("b2", "Rs. 120.00", 0.9, 10, 35, 90, 55), ("b3", " Customer Care 1 ", 0.9, 10, 300, 200, 320),
            ("b4", "800 425 4449", 0.9, 10, 325, 200, 345), ("b5", "plain words", 0.9, 10, 600, 200, 620), ("b6", "more of them", 0.9, 10, 625, 200, 645)]
    blocks = make_blocks({("pack", "FRONT"): pack})
    keys = ("declaration_type", "raw_value", "stage", "a", "b", "c", "confidence")
    marks, wanted = E.line_marks(("care",))
    few, every = L.candidate_spans(blocks, marks=marks, wanted=wanted), L.candidate_spans(blocks)
    rows = [sorted(map(tuple, E.candidates_from_spans(s, ("care",)).select(*keys).collect()), key=str) for s in (few, every)]
    assert rows[0] == rows[1] and "CONSUMER_CARE_PHONE" in {r[0] for r in rows[0]}
    assert few.count() < every.count()
    assert {r["text"] for r in L.candidate_spans(blocks, kinds=("single",)).collect()} == {"MRP", "Rs. 120.00", "Customer Care 1", "800 425 4449", "plain words", "more of them"}


def test_spans_of_lines_of_many_blocks(make_blocks):
    """Numbered spans against all runs of 2 to 6 blocks, for lines of 1 to 9 blocks, in order."""
    images = {(f"i{n}", "FRONT"): [(f"b{k}", f"w{k}", 0.9, 10 + 50 * k, 10, 40 + 50 * k, 30) for k in range(n)] for n in range(1, 10)}
    got = L.candidate_spans(make_blocks(images)).orderBy("stage", "a", "b", "c").collect()
    for n in range(1, 10):
        runs = [(0, n)] * (n > 1) + [(s, k) for k in range(2, min(6, n - 1) + 1) for s in range(n - k + 1)]
        want = [(0, f"w{k}", [f"i{n}.b{k}"]) for k in range(n)] + [(1, " ".join(f"w{s + j}" for j in range(k)), [f"i{n}.b{s + j}" for j in range(k)]) for s, k in runs]
        mine = [r for r in got if r["image_id"] == f"i{n}"]
        assert [(r["stage"], r["text"], [b["block_id"] for b in r["blocks"]]) for r in mine] == want
        assert all(r["n_blocks"] == len(r["blocks"]) and not r["is_multi_line"] for r in mine)


def test_callers_filter_does_not_repeat_the_values(make_blocks):
    blocks = make_blocks({("pack", "FRONT"): PACKS["quantity"]})
    every = E.extract_candidates(blocks, ("quantity",))
    few = every.where("normalized.is_multipack OR normalized.unit = 'g'")
    used = [df._jdf.queryExecution().optimizedPlan().toString().count("canonical_value, CASE") for df in (every, few)]
    assert used[0] == used[1] > 0


def test_first_characters_change_no_match(spark):
    texts = ["MRP 5", "m.r.p. Rs 7/-", "xMRP 5", "12 TABLETS", "12.5.6 ml", "5, kg", "7 Kg", "1 2 capſ", "411001 road", "5  L", "3units", "3.5unit 9 m", "Net Wt. 5 g", "éNET WT 5",
             "10 N x 50 g = 500 g", "PacKed by X", "MFG. by A", "imp. date 1", "Dist by Q", "B.B. 3", "uſe by 4", "6 months from mfg", "lot no 5\nB. NO. 7", "FSSAI 1", "LIC NO", "baŕ 5ml", "5́ ml", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = [(F.regexp_extract_all("t", F.lit(f"(?m)(?Uid)({p})"), 1), F.regexp_extract_all("t", F.lit("(?m)(?Uid)(" + ci(p)[6:] + ")"), 1)) for p in FIRST]
    flat = [c.alias(f"{side}{i}") for i, pair in enumerate(pairs) for side, c in zip("ab", pair)]
    for r in rows.select("t", *flat).collect():
        assert all(r[f"a{i}"] == r[f"b{i}"] for i in range(len(pairs))), r["t"]
