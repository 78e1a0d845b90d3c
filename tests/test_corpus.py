import duckdb
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.operators import corpus as C
from spandrel.sources import exports as X

SPANS = "doc string, page int, ord int, text string, b array<float>"


def boxed(spark, rows, schema=SPANS):
    return spark.createDataFrame(rows, schema).withColumn("bbox", G.box_of(F.col("b"))).drop("b")


def test_gaps(spark):
    grid = [("d", 1, 10 * r + c, str(r * c), [100.0 * c, 20.0 * r, 100.0 * c + 30, 20.0 * r + 10]) for r in range(8) for c in range(4)]
    prose = [("d", 2, i, "word", [0.0, 12.0 * i, 30.0, 12.0 * i + 10]) for i in range(40)]
    none = boxed(spark, [], "doc string, page int, role string, b array<float>")
    got = C.coverage_gaps(boxed(spark, grid + prose), none).collect()
    assert [(r.page, r.n, r["columns"], r["rows"], tuple(r.bbox)) for r in got] == [(1, 32, 4, 8, (0, 0, 330, 150))]
    covered = boxed(spark, [("d", 1, "Table", [0.0, 0.0, 400.0, 400.0])], "doc string, page int, role string, b array<float>")
    assert C.coverage_gaps(boxed(spark, grid + prose), covered).count() == 0


def test_likely_tables_and_snap(spark):
    schema = "region_id int, doc string, page int, source string, n_cols int, n_rows int, b array<float>"
    regions = boxed(spark, [(1, "d", 1, "text", 2, 3, [0.0, 0.0, 100.0, 50.0]), (2, "d", 1, "text", 1, 3, [0.0, 0.0, 9.0, 9.0]), (3, "d", 1, "lines", 2, 2, [0.0, 0.0, 100.0, 48.0]), (4, "d", 1, "lines", 2, 2, [300.0, 0.0, 400.0, 50.0])], schema)
    words = boxed(spark, [("d", 1, 0, "12", [10.0, 10.0, 20.0, 20.0]), ("d", 1, 1, "May", [-40.0, 10.0, -20.0, 20.0])])
    kept = C.likely_tables(regions, words)
    assert sorted(r.region_id for r in kept.collect()) == [1, 4]
    assert {r.region_id: r.bbox.x0 for r in C.snapped(kept, words).collect()} == {1: -40, 4: 300}


def test_picks(spark):
    tables = spark.createDataFrame([("d", 1, f"t{i}", r, 3) for i, r in enumerate([2, 3, 12, 13, 5])], "doc string, page int, table_id string, n_rows int, n_cols int")
    assert [r.table_id for r in C.corpus_tables(tables, 2, 10).collect()] == ["t1", "t2"]
    assert C.table_pages(spark.createDataFrame([("d", p) for p in (1, 2)], "doc string, page int"), tables, 5).count() == 1
    e = boxed(spark, [("d", 1, 0, "b", [50.0, 3.0, 60.0, 9.0]), ("d", 1, 1, "a", [0.0, 4.0, 9.0, 9.0])])
    assert [r.text for r in C.layout_order(e, ["doc"]).orderBy("ord").collect()] == ["a", "b"]
    assert [r[0] for r in C.smallest_first(spark.createDataFrame([(2,), (1,)], "n int"), "n").collect()] == [1, 2]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1), ("b", None), ("c", 0.9)], "t string, error double")
    assert X.to_duckdb(df, duckdb.connect(), "x").sql("SELECT count(*) FROM x").fetchall() == [(3,)] and X.to_arrow(df).num_rows == 3
    X.worst_first_csv(df, str(tmp_path / "c"))
    assert [r.t for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["c", "a", "b"]
    grid = spark.createDataFrame([("d", "t", 0, 0, "<x>")], "doc string, table_id string, row int, col int, text string")
    assert "<td>&lt;x&gt;</td>" in X.report_html(grid, spark.createDataFrame([("t", "Suspect")], "table_id string, impression string")).first().html
