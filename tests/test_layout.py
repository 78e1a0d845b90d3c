import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.operators import layout as L
from spandrel.operators import regions as R
from spandrel.operators import validator as W


def frame(spark, words, doc="d"):
    rows = [(doc, 1, i, t, *map(float, b)) for i, (t, *b) in enumerate(words)]
    df = spark.createDataFrame(rows, "doc string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    return df.select("doc", "page", "ord", "text", *(F.col(s).cast("float") for s in G.SIDES))


def boxes(spark, rows, schema="doc string, page int, ord int, role string, b array<float>"):
    return spark.createDataFrame(rows, schema).withColumn("bbox", G.box_of(F.col("b"))).drop("b")


def test_column_intervals(spark):
    n = lambda spans: L.column_intervals(frame(spark, [("w", a, 0, b, 5) for a, b in spans]), ["doc"]).count()
    assert n([(0, 30), (33, 80)]) == 1 and n([(0, 30), (100, 130)]) == 2 and n([(100, 140), (132, 140)]) == 1


def test_anchor_is_not_a_chain(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (0, 2, 4, 6)], "g string, y double")
    assert [r.anchor for r in L.anchor_clusters(df, ["g"], "y", 3.0).orderBy("cluster").collect()] == [0, 4]
    assert [(r["mean"], r.n) for r in L.mean_clusters(df, ["g"], "y", 3.0).orderBy("cluster").collect()] == [(2.0, 3), (6.0, 1)]
    assert [r.cluster for r in L.lag_clusters(df, ["g"], "y", 3.0).collect()] == [0] * 4


WORDS = [("Item", 0, 0, 20, 10), ("2023", 100, 0, 130, 10), ("2022", 200, 0, 230, 10), ("Net", 0, 20, 15, 30), ("sales", 18, 20, 40, 30), ("$", 90, 20, 94, 30), ("600", 105, 20, 130, 30), ("(5", 205, 20, 225, 30), (")", 232, 20, 236, 30)]


def test_structure_words(spark):
    got = {(r.row, r.col): (r.text, r.is_header) for r in L.structure_words(frame(spark, WORDS), ["doc"]).collect()}
    assert got[0, 1] == ("2023", False) and {t for t, _ in got.values()} >= {"Net sales", "$ 600", "(5 )"}


def test_header_band():
    words = [("2024", 100, 0, 120, 10), ("Q1", 100, 20, 120, 30), ("Q2", 200, 20, 220, 30), ("a", 0, 40, 10, 50), ("1", 105, 40, 115, 50), ("2", 205, 40, 215, 50)]
    grid, _, header = L.structure(np.array([w[1:] for w in words], np.float32), [w[0] for w in words])
    assert header == 2 and grid == [["", "2024", ""], ["", "Q1", "Q2"], ["a", "1", "2"]]


def test_symbol_column_goes_right():
    words = [("h", 0, 0, 5, 5), ("a", 0, 20, 5, 25), ("$", 50, 20, 54, 25), ("10", 62, 20, 70, 25), ("20", 100, 20, 110, 25), ("b", 0, 40, 5, 45), ("$", 50, 40, 54, 45), ("30", 62, 40, 70, 45), ("40", 100, 40, 110, 45)]
    grid, areas, header = L.structure(np.array([w[1:] for w in words], np.float32), [w[0] for w in words])
    assert header == 1 and grid[1:] == [["a", "$10", "20"], ["b", "$30", "40"]] and areas[1][1][0] == 50


def test_empty_structure():
    assert L.structure(np.zeros((0, 4), np.float32), []) == ([], [], 0) and L.ascii_page(np.zeros((0, 4)), []) == ""


def test_xy_cut(spark):
    stacked = [("a", 0, 0, 50, 10), ("b", 0, 40, 50, 50)]
    columns = [("a", 0, 0, 50, 10), ("b", 100, 0, 150, 10)]
    cluster = [("a", 0, 0, 50, 10), ("b", 52, 0, 90, 10), ("c", 0, 12, 50, 22)]
    assert [L.xy_cut(frame(spark, w), ["doc"]).count() for w in (stacked, columns, cluster)] == [2, 2, 1]


def test_document_text(spark):
    words = [("L1b", 30, 0, 50, 10), ("L1a", 0, 0, 20, 10), ("L2a", 0, 12, 20, 22), ("R1a", 200, 0, 220, 10)]
    assert L.document_text(frame(spark, words), ["doc"]).first().text == "L1a L1b L2a\n\nR1a"


def test_ascii(spark):
    words = [("ab", 0, 0, 10, 10), ("cd", 50, 1, 60, 11), ("x", 0, 20, 5, 30)]
    assert L.words_to_ascii(frame(spark, words), ["doc"]).first().text == "ab        cd\nx"


def test_merge_and_counts(spark):
    r = boxes(spark, [("d", 1, i, "Table", [float(i), 1.0, 10.0 + i, 12.0]) for i in (1, 2, 3)] + [("d", 2, 0, "Table", [0.0, 0.0, 1.0, 1.0])])
    out = L.merge_regions(r, ["doc", "page"]).collect()
    assert len(out) == 1 and tuple(out[0].bbox) == (2, 1, 12, 12)
    words = frame(spark, [("a", 0, 0, 10, 5), ("b", 40, 0, 50, 5), ("c", 80, 0, 90, 5)])
    claimed = spark.createDataFrame([("d", 2)], "doc string, claimed long")
    assert [(x.claimed, x.n_columns) for x in L.column_mismatch(claimed, words, ["doc"]).collect()] == [(2, 3)]


def test_region_joins(spark):
    regions = boxes(spark, [("d", 1, 0, "Table", [0.0, 0.0, 100.0, 100.0]), ("d", 1, 1, "Table", [10.0, 10.0, 110.0, 110.0]), ("d", 1, 2, "Other", [200.0, 0.0, 300.0, 100.0])])
    spans = boxes(spark, [("d", 1, i, "", b) for i, b in enumerate([[1.0, 1.0, 9.0, 9.0], [210.0, 1.0, 220.0, 9.0], [0.0, 300.0, 9.0, 309.0]])])
    assert [r.ord for r in R.orphans(spans, regions).orderBy("ord").collect()] == [1, 2]
    from spandrel.operators.detectors import region_pairs

    assert [(r.i, r.j) for r in region_pairs(regions).collect()] == [(0, 1)]
    a = R.agreement(regions, regions.where("ord < 2")).first()
    assert a.agreement == pytest.approx(2 / 3) and not a.accepted
    assert [r.ord for r in R.disagreeing(regions, regions.where("ord < 2")).collect()] == [2]


def test_register_or_match(spark):
    prior = boxes(spark, [("d", 1, 7, "Table", [0.0, 0.0, 100.0, 100.0])]).withColumns({"element_id": F.lit("slot7"), "seq": F.lit(0)})
    new = boxes(spark, [("d", 1, 0, "Table", [1.0, 1.0, 101.0, 101.0]), ("d", 1, 1, "Table", [300.0, 0.0, 400.0, 50.0]), ("d", 1, 2, "Text", [0.0, 0.0, 100.0, 100.0]), ("d", 2, 3, "Table", [0.0, 0.0, 100.0, 100.0])])
    new = new.withColumns({"region_id": F.col("ord"), "mint": F.concat(F.lit("m"), F.col("ord").cast("string"))})
    assert [r.element_id for r in R.register_or_match(new, prior).orderBy("ord").collect()] == ["slot7", "m1", "m2", "m3"]


def test_greedy_matching(spark):
    rows = lambda side: [("d", 1, i, *map(float, b)) for i, b in enumerate(side)]
    schema = "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double"
    left = spark.createDataFrame(rows([(0, 0, 10, 10), (0, 0, 10, 9)]), schema)
    right = spark.createDataFrame(rows([(0, 0, 10, 10)]), schema)
    assert [r.match for r in R.one_to_one(left, right).orderBy("ord").collect()] == [0, None]
    both = left.withColumn("parser", F.lit("a")).unionByName(right.withColumn("parser", F.lit("b")))
    assert {r.region for r in R.cluster_parsers(both).collect()} == {0}


def test_reconstruction_score(spark):
    texts = [["Item", "2023", "2022"], ["Product", "600", "550"], ["Service", "(300)", "250"]]
    obs = spark.createDataFrame([("t", x, 100.0 * c, 20.0 * r, 100.0 * c + 40, 20.0 * r + 10) for r, row in enumerate(texts) for c, x in enumerate(row)], "table_id string, text string, x0 float, y0 float, x1 float, y1 float")
    hyp = spark.createDataFrame([("t", r, c, x) for r, row in enumerate(texts) for c, x in enumerate(row)], "table_id string, row int, col int, text string")
    assert W.validate(obs, hyp).first().error == 0
    for how in ("swap", "drop", "merge", "shift", "transpose"):
        assert W.validate(obs, W.corrupt(hyp, how, 1, 1 if how == "transpose" else 2)).first().error > 0.015, how
    lost = hyp.withColumn("text", F.replace(F.replace("text", F.lit("("), F.lit("")), F.lit(")"), F.lit("")))
    assert W.validate(obs, lost).first().sign_violations > 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "c"]), max_size=8), st.lists(st.sampled_from(["a", "b", "ab", "c"]), max_size=8))
def test_alignment_uses_each_token(obs, hyp):
    pairs = W.align(obs, hyp)
    assert {i for i, _ in pairs if i is not None} == set(range(len(obs))) and {j for _, j in pairs if j is not None} == set(range(len(hyp)))
