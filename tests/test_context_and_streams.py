"""Context selection with findings, savings, rule versions, and the streamed upsert against the batch one."""

from pyspark.sql import functions as F

from packlens.operators.analytics import context_savings
from packlens.operators.conversation import context_counts, select_context
from packlens.operators.review import apply_folds, apply_reviews, fold_buckets, fold_status, upsert_declarations
from packlens.operators.rules import rules_as_of
from packlens.streaming import streams as ST
from packlens.streaming.keyed_table import KeyedTable

QUESTION = "question_id string, scan_id int, intent string, target_fields array<string>, panel_referenced string, requires_scan_data boolean"


def frames(spark):
    questions = spark.createDataFrame([
        ("a", 1, "SPECIFIC_DECLARATION_CHECK", ["mrp"], None, True), ("b", 1, "SPECIFIC_DECLARATION_CHECK", ["dates", "fssai"], None, True),
        ("c", 1, "PRODUCT_COMPLIANCE_OVERVIEW", [], None, True), ("d", 1, "LEGAL_REGULATION_INQUIRY", [], None, False), ("e", 2, "SPECIFIC_DECLARATION_CHECK", ["mrp"], None, True)], QUESTION)
    scans = spark.createDataFrame([(1, "Tea", "Leaf", "CREATED"), (2, "Mug", None, "CREATED")], "scan_id int, product string, brand string, status string")
    quality = spark.createDataFrame([(1, 0, "FRONT", "ACCEPTED", 120.0, 0.01, []), (2, 0, "FRONT", "ACCEPTED", 120.0, 0.01, [])], "scan_id int, seq int, panel_type string, quality_status string, blur_score double, glare_score double, warnings array<string>")
    decls = spark.createDataFrame([(1, i, t, t.lower(), 0.9, "CONFIRMED") for i, t in enumerate(["MRP", "NET_QUANTITY"])], "scan_id int, seq int, declaration_type string, raw_text string, confidence double, resolution_status string")
    findings = spark.createDataFrame([(1, f"RULE_{k}", s, "m") for k, s in (("A", "FAIL"), ("B", "PASS"), ("MRP", "PASS"), ("Z", "REVIEW"))], "scan_id int, rule_code string, status string, message string")
    return questions, scans, quality, decls, findings


def test_context_has_sections_findings_and_note(spark):
    rows = select_context(*frames(spark)).orderBy("question_id", "section", "pos").collect()
    of = lambda q: [r["line"] for r in rows if r["question_id"] == q]
    rules = ["--- Applicable Rule Findings ---", "• Rule RULE_A [FAIL]: m"]
    assert of("a") == ["Active Product: Tea (Leaf) | Session Status: CREATED", "--- Extracted Target Declarations ---", "• [MRP] 'mrp' (Confidence: 0.90, Review: CONFIRMED)", *rules, "• Rule RULE_MRP [PASS]: m", "• Rule RULE_Z [REVIEW]: m"]
    assert of("b")[1:] == ["*(Note: No extracted declaration matched target fields: dates, fssai)*", *rules, "• Rule RULE_Z [REVIEW]: m"]
    assert of("c")[1:] == ["--- Extracted Declarations Overview ---", "• [MRP]: 'mrp' (Conf: 0.90)", "• [NET_QUANTITY]: 'net_quantity' (Conf: 0.90)", "--- Rule Engine Flags & Issues ---", "• Rule RULE_A [FAIL]: m", "• Rule RULE_Z [REVIEW]: m"]
    assert of("d") == [] and of("e") == ["Active Product: Mug | Session Status: CREATED"]


def test_context_broadcasts_no_table_of_scans(spark):
    kept = []
    rows = select_context(*frames(spark), keep=lambda r: kept.append(r) or r)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (rows, kept[0])]
    assert len(kept) == 1 and not any("Broadcast" in p for p in plans)


def test_review_states_meet_by_later_action_and_later_correction():
    corrected = (5, 2, "CORRECTED", "x", "u", True, 5, 2, "x")
    confirmed = (5, 3, "CONFIRMED", None, "v", False, 0, 0, None)
    older = (4, 9, "CORRECTED", "y", "w", True, 4, 9, "y")
    assert ST._later(corrected, confirmed) == ST._later(confirmed, corrected) == (5, 3, "CONFIRMED", None, "v", True, 5, 2, "x")
    assert ST._later(ST._later(older, confirmed), corrected) == (5, 3, "CONFIRMED", None, "v", True, 5, 2, "x")


def test_savings_of_every_intent(spark):
    questions, _, quality, decls, findings = frames(spark)
    counts = context_counts(questions, quality, decls, findings)
    saved = context_savings(*[F.col(c) for c in ("intent", "n_decl", "n_quality", "n_findings", "n_matched", "n_violations")])
    assert {r["question_id"]: r["s"] for r in counts.select("question_id", saved.alias("s")).collect()} == {"a": 30 + 25, "b": 25, "c": 40, "d": 60 + 25 + 120, "e": 0}


def test_rule_versions_over_months(spark):
    rules = spark.createDataFrame([("R", "1", True, "2020-01-15", "2020-03-10"), ("R", "2", True, "2020-03-10", None), ("R", "9", False, "2020-01-01", None)], "rule_code string, rule_version string, is_active boolean, f string, t string")
    rules = rules.selectExpr("rule_code", "rule_version", "is_active", "timestamp(f) valid_from", "timestamp(t) valid_to")
    seen = spark.createDataFrame([(i, "R", d) for i, d in enumerate(["2020-01-14", "2020-01-15", "2020-03-09", "2020-03-10", "2024-06-01"])], "inspection_id int, rule_code string, d string").selectExpr("inspection_id", "rule_code", "timestamp(d) inspected_at")
    assert {r["inspection_id"]: r["rule_version"] for r in rules_as_of(seen, rules).collect()} == {1: "1", 2: "1", 3: "2", 4: "2"}


def test_streamed_upsert_equals_batch(spark, tmp_path):
    old = "scan_id int, declaration_type string, declaration_id int, resolution_status string, reviewed boolean, reviewed_value string, machine_value string"
    existing = spark.createDataFrame([(1, "MRP", 1, "CONFIRMED", True, "r1", "m1"), (2, "MRP", 2, "NEEDS_REVIEW", False, None, "m2"), (3, "MRP", 3, "REJECTED", True, None, "m3")], old)
    new = "scan_id int, declaration_type string, resolution_status string, machine_value string, confidence double"
    fresh = spark.createDataFrame([(1, "MRP", "AUTO_RESOLVED", "n1", 0.9), (1, "NET_QUANTITY", "AUTO_RESOLVED", "q1", 0.8), (2, "NET_QUANTITY", "NOT_DETECTED", None, 0.0), (4, "MRP", "NEEDS_REVIEW", "n4", 0.5)], new)
    table = KeyedTable(spark, f"{tmp_path}/table", "scan_id", buckets=4)
    table.create(upsert_declarations(existing, fresh.limit(0)))
    for scan in (4, 1, 2):
        fresh.where(F.col("scan_id") == scan).coalesce(1).write.mode("append").parquet(f"{tmp_path}/incoming")
    stream = spark.readStream.schema(new).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/incoming")
    ST.drain(stream, ST.upsert_batches(table), f"{tmp_path}/checkpoint")
    assert table.latest() == 3
    got, expected = table.read(3), upsert_declarations(existing, fresh)
    assert sorted(map(str, got.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_merge_writes_touched_buckets_only_and_repeats(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k", buckets=8)
    table.create(spark.range(40).selectExpr("id k", "0 v"))
    plus = lambda current, batch: current.unionByName(batch).groupBy("k").agg(F.sum("v").cast("int").alias("v"))
    batch = spark.createDataFrame([(3, 5), (100, 7)], "k long, v int")
    for _ in range(2):  # a batch that runs again gives the same version
        touched = table.merge(batch, 0, plus)
        assert len(touched) <= 2 and dict(table.read(1).where("v > 0").collect()) == {3: 5, 100: 7} and table.read(1).count() == 41
    assert {p.name for p in (tmp_path / "v=1").iterdir() if p.name.startswith("bucket=")} == {f"bucket={b}" for b in touched}
    assert table.read(0).count() == 40
    for n in range(1, 4):
        table.merge(spark.range(40).selectExpr("id k", "1 v"), n, plus)
    assert not (tmp_path / "v=1").exists() and table.read(4).where("k = 3 AND v = 8").count() == 1  # unnamed folders are gone
    table.merge(batch.limit(0), 4, plus)
    assert table.latest() == 5 and table.read(5).count() == 41


def test_streamed_reviews_equal_the_fold(spark, tmp_path):
    """Files out of order, equal times, corrections without a value, unknown actions, many actions on one declaration."""
    rows = [(i % 3, ("CONFIRMED", "CORRECTED", "REJECTED", "CORRECTED")[i % 4], (None, f"v{i}", "x", "")[i % 4], f"u{i}", 1_600_000_000 + (i * 37 % 50) // 2, i) for i in range(60)]
    rows += [(7, "VIEWED", "x", "u", 1_600_000_000, 900), (None, "REJECTED", None, "u", 1_600_000_000, 901)]
    schema = "declaration_id int, action string, value string, reviewed_by string, s long, action_id int"
    actions = spark.createDataFrame(rows, schema).selectExpr("declaration_id", "action", "value", "reviewed_by", "timestamp_seconds(s) acted_at", "action_id")
    for part in (2, 0, 3, 1):
        actions.where(F.col("action_id") * 7 % 4 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/incoming")
    table = KeyedTable(spark, f"{tmp_path}/table", "declaration_id", buckets=2)
    table.create(spark.createDataFrame([], ST.REVIEW_TABLE))
    stream = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/incoming")
    ST.drain(ST.review_states(stream), ST.merge_reviews(table), f"{tmp_path}/checkpoint", mode="update")
    decls = spark.createDataFrame([(i, 1, "MRP", "m", "AUTO_RESOLVED", None, "m", "n", False, None) for i in (0, 1, 2, 7)],
                                  "declaration_id int, scan_id int, declaration_type string, machine_value string, resolution_status string, reviewed_value string, canonical_value string, normalized_value string, reviewed boolean, reviewed_by string")
    folds = table.read(table.latest()).withColumn("declaration_id", F.col("declaration_id").cast("int"))
    got, expected = apply_folds(decls, folds).collect(), apply_reviews(decls, actions).collect()
    assert table.latest() == 4 and sorted(map(str, got)) == sorted(map(str, expected))
    by_id = {r["declaration_id"]: r for r in expected}
    assert not by_id[7]["reviewed"] and by_id[7]["reviewed_at"] is None
    for i in (0, 1, 2):
        mine = sorted((r[4], r[5], r) for r in rows if r[0] == i and (r[1] != "CORRECTED" or r[2]))
        fix = [m[2][2] for m in mine if m[2][1] == "CORRECTED"][-1]
        last = mine[-1][2]
        assert by_id[i]["canonical_value"] == by_id[i]["normalized_value"] == fix and by_id[i]["reviewed_by"] == last[3] and by_id[i]["machine_value"] == "m"
        assert by_id[i]["reviewed_value"] == {"CONFIRMED": "m", "REJECTED": None}.get(last[1], fix)


def test_streamed_statuses_follow_event_time(spark, tmp_path):
    """Files out of order give the same status as the batch fold; minutes the watermark has not passed stay open."""
    rows = [(1, "upload", 0, 1), (1, "process", 70, 2), (1, "ocr_done", 75, 3), (1, "extract", 200, 4), (2, "upload", 10, 5), (2, "last_image_deleted", 20, 6), (3, "upload", 90_000, 7)]
    df = spark.createDataFrame(rows, "scan_id int, event string, s long, seq long").selectExpr("scan_id", "event", "timestamp_seconds(1600000000 + s) ts", "seq")
    for seq in ((3, 6), (1, 4), (5, 2), (7,)):
        df.where(F.col("seq").isin(*seq)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/incoming")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/incoming")
    got = fold_buckets(ST.run_to_table(spark, ST.status_buckets(stream))).collect()
    assert sorted(got) == sorted(fold_status(df.where("scan_id < 3")).collect())
    assert {r["scan_id"]: r["status"] for r in got} == {1: "DECLARATIONS_EXTRACTED", 2: "CREATED"}


def test_streamed_statuses_with_open_minutes(spark, tmp_path):
    """Update mode: minutes that the watermark has not passed count as well, and a minute seen in two files is kept once."""
    rows = [(1, "upload", 0, 1), (1, "process", 70, 2), (1, "ocr_done", 75, 3), (1, "extract", 200, 4), (2, "upload", 10, 5), (2, "last_image_deleted", 20, 6), (3, "upload", 90_000, 7), (3, "process", 90_001, 8)]
    df = spark.createDataFrame(rows, "scan_id int, event string, s long, seq long").selectExpr("scan_id", "event", "timestamp_seconds(1600000000 + s) ts", "seq")
    for seq in ((3, 6), (1, 4), (5, 2, 8), (7,)):
        df.where(F.col("seq").isin(*seq)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/incoming")
    buckets = ST.status_buckets(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/incoming"), delay="2 days")
    table = KeyedTable(spark, f"{tmp_path}/table", "scan_id", buckets=2)
    table.create(spark.createDataFrame([], buckets.schema))
    ST.drain(buckets, ST.keep_buckets(table), f"{tmp_path}/checkpoint", mode="update")
    assert sorted(fold_buckets(table.read(table.latest())).collect()) == sorted(fold_status(df).collect())


def test_upload_state_expires_and_no_repeat_is_kept(spark, tmp_path):
    """Each batch brings a hundred new hashes, the first ten again and a null one: the state holds a batch, the table all hashes once."""
    schema = "scan_id bigint, sha256 string"
    table = KeyedTable(spark, f"{tmp_path}/table", "scan_id", buckets=4)
    table.create(spark.createDataFrame([], schema))
    sizes = []
    for k in range(4):
        new = spark.range(100).selectExpr("id % 5 scan_id", f"concat('h', id + {100 * k}) sha256")
        again = spark.range(20).selectExpr("id % 5 scan_id", "concat('h', id % 10) sha256").unionByName(spark.sql("SELECT cast(null AS bigint) scan_id, cast(null AS string) sha256"))
        new.unionByName(again).write.mode("append").parquet(f"{tmp_path}/incoming")
        uploads = spark.readStream.schema(schema).parquet(f"{tmp_path}/incoming")
        done = ST.drain(ST.dedupe_images(uploads, idle="0 seconds"), ST.keep_first_uploads(table), f"{tmp_path}/checkpoint")
        sizes.append(done.lastProgress.stateOperators[0].numRowsTotal)
    assert max(sizes) <= 111
    rows = table.read(table.latest()).collect()
    assert len(rows) == len(set(rows)) == 401


def test_trend_drops_late_rows_and_forgets_closed_windows(spark, tmp_path):
    """A row is late once the batch before last has moved the watermark past its window."""
    batches = [[(0, "a"), (60, "a"), (7200, "b")], [(10, "a"), (90_000, "a")], [(20, "a"), (89_990, "a"), (90_010, None)], [(30, "a"), (180_000, "b"), (180_001, "b")]]
    schema = "s long, action string"
    table = KeyedTable(spark, f"{tmp_path}/table", "window_start", buckets=4)
    seen, expected, state = [], {}, 0
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/incoming")
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/incoming").selectExpr("timestamp_seconds(s) ts", "action")
        trend = ST.action_trend(events)
        if k == 0:
            table.create(spark.createDataFrame([], trend.schema))
        done = ST.drain(trend, ST.keep_windows(table), f"{tmp_path}/checkpoint", mode="update")
        state = done.lastProgress.stateOperators[0].numRowsTotal
        mark = max((s for b in batches[:max(0, k - 1)] for s, _ in b), default=0) - 3600
        for s, action in rows:
            start = s // 3600 * 3600
            if k < 2 or start + 3600 > mark:
                expected[start, action] = expected.get((start, action), 0) + 1
        seen.append(len(expected))
    got = {(int(r["w"]), r["action"]): r["n"] for r in table.read(table.latest()).selectExpr("unix_seconds(window_start) w", "action", "n").collect()}
    assert got == expected and got[0, "a"] == 3 and state < len(expected)


def test_upsert_refreshes_the_whole_snapshot(spark):
    """A reviewed row with candidates, one without, a new row and one that is no longer detected."""
    existing = spark.createDataFrame(
        [(1, "MRP", 10, "CONFIRMED", True, "rev", "m", "n"), (1, "BATCH", 11, "REJECTED", True, None, "m", "n"), (2, "MRP", 12, "AUTO_RESOLVED", False, None, "m", "n")],
        "scan_id int, declaration_type string, declaration_id int, resolution_status string, reviewed boolean, reviewed_value string, machine_value string, normalized_value string")
    fresh = spark.createDataFrame(
        [(1, "MRP", "NOT_DETECTED", None, 0.7, "raw", "7", True, "two"), (3, "MRP", "AUTO_RESOLVED", "9", 0.9, "nine", "8", False, "one"), (2, "MRP", "NOT_DETECTED", None, 0.1, "x", "9", False, "none")],
        "scan_id int, declaration_type string, resolution_status string, machine_value string, confidence double, raw_text string, source_block_id string, has_conflict boolean, resolution_reason string")
    rows = {(r["scan_id"], r["declaration_type"]): r.asDict() for r in upsert_declarations(existing, fresh, "v2").collect()}
    assert set(rows) == {(1, "MRP"), (1, "BATCH"), (3, "MRP")}
    pick = lambda key: [rows[key][c] for c in ("raw_text", "source_block_id", "has_conflict", "resolution_reason", "normalized_value", "canonical_value", "confidence", "extractor_version")]
    preserved = "Machine extraction updated; human review preserved."
    assert pick((1, "MRP")) == ["raw", "7", True, preserved, "n", "rev", 0.0, "v2"]
    assert pick((1, "BATCH")) == ["", None, False, preserved, "n", None, 0.0, "v2"]
    assert pick((3, "MRP")) == ["nine", "8", False, "one", "9", "9", 0.9, "v2"]
