"""What the layout must not do per block: read photographs twice, group every island, carry a strip's values with every row."""

from pyspark.sql import functions as F

from packlens.operators import layout as L

ROWS = [
    ("Net", 0.9, 10, 100, 40, 120), ("Qty", 0.9, 45, 100, 75, 120), ("80 g", 0.9, 80, 102, 100, 122),
    ("PKD.", 0.9, 10, 140, 50, 160), ("05/2024", 0.9, 60, 300, 150, 320),
]


def _blocks(make_blocks):
    return make_blocks({("a", "FRONT"): [(i, *r) for i, r in enumerate(ROWS)]})


def _plan(df, step="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), step)().toString()


def test_islands_are_not_grouped(make_blocks):
    lines = L.cluster_lines(_blocks(make_blocks))
    assert not [x for x in _plan(lines).splitlines() if "Aggregate [" in x and "island" in x]
    got = [(r["line_no"], r["text"], r["y1"], r["y2"]) for r in lines.orderBy("line_no").select("line_no", "text", "blocks.text", "y1", "y2").toDF("line_no", "text", "t", "y1", "y2").collect()]
    assert got == [(0, "Net Qty 80 g", 100, 122), (1, "PKD.", 140, 160), (2, "05/2024", 300, 320)]


def test_photographs_are_read_once(spark, make_blocks, tmp_path):
    _blocks(make_blocks).write.parquet(str(tmp_path / "b"))
    masked = L.nutrition_mask(spark.read.parquet(str(tmp_path / "b")))
    scans = [x for x in _plan(masked, "sparkPlan").splitlines() if "FileScan parquet" in x and "text" in x.split("Batched")[0]]
    assert len(scans) == 2
    assert [x for x in scans if "GreaterThanOrEqual(y2," in x and f"GreaterThanOrEqual(y1,{L.STRIP_PX})" in x]


def test_values_of_a_strip_stay_on_one_row(make_blocks):
    near = F.when(F.col("text").rlike("[0-9]"), F.col("text"))
    masked = L._masked(_blocks(make_blocks), L.STRIP_PX, near)
    assert masked.where(F.size("near_values") == 2).count() == 5
    assert L._islands(masked).where("near_values IS NOT NULL").count() == 1
    lines = L._strip_lines(_blocks(make_blocks), L.STRIP_PX, near)
    assert [sorted(r[0]) for r in lines.select("near_values").collect()] == [["05/2024", "80 g"]] * 3
