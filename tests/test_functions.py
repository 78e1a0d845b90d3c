import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.functions import numbers as N
from spandrel.functions import text as X


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_parse_num(spark):
    rows = ["$7,310.25", "(418)", "$ (655)", "9%", "—", "Harvest", "2031-2032", "( 655", "", None, "-", "3e5", " 8 "]
    assert values(spark, rows, N.parse_num) == [7310.25, -418, -655, 9, None, None, None, 655, None, None, None, None, 8]


def test_parse_cell(spark):
    rows = ["1e5", "inf", "(902)", "902-", "$1,000", "abc", "", None, "12 %"]
    assert values(spark, rows, N.parse_cell) == [1e5, float("inf"), -902, None, 1000, None, None, None, 12]


def test_parse_plain(spark):
    assert values(spark, ["(1,000)", "$5", "x", None, "3%"], N.parse_plain) == [-1000, 5, None, None, 3]


def test_parse_number(spark):
    rows = ["$ (655)", "2.5M", "90CR", "90DR", "9%", "4-", "P3", "n/a", "(3,118)", "6", "5mk", "5drcr", "\t(5)", "(7", "8 k", "k", "-3b", "$", "1,0.5", "(2)%", "1.2.3", None]
    got = values(spark, rows, N.parse_number)
    assert [g and g.value for g in got] == [-655, 2.5e6, -90, 90, 9, -4, None, None, -3118, 6, None, None, -5, None, 8000, None, -3e9, None, 10.5, -2, None, None]
    assert got[0].transforms == ["strip currency", "paren→neg", "signed"] and got[4].percent and got[9].integral and not got[1].integral
    assert got[1].transforms == ["scale ×1e+06"] and got[5].transforms == ["trailing−→neg", "signed"] and got[14].transforms == ["scale ×1000"] and got[16].scale == 1e9


def test_sign_fix(spark):
    assert values(spark, ["(902)", "150CR", "150DR", "150-", "—", "n/a", "(x)"], N.sign_fix) == ["-902", "-150", "150", "-150", "—", "n/a", "(x)"]


def test_clean_cell(spark):
    assert values(spark, ["27......", "27.5", "Oats ....  3,210", "1987 . . . .", ""], X.clean_cell) == ["27", "27.5", "Oats 3,210", "1987", ""]


def test_total_label(spark):
    rows = ["Total revenue", "Sumitomo", "Net income", "Interest expense, net", "Gross profit", "Subtotal", "the sum", ""]
    assert values(spark, rows, X.is_total_label) == [True, False, True, False, True, True, True, False]


def test_predicates(spark):
    assert values(spark, ["2023", "1899", "20234", "x"], X.is_year) == [True, False, False, False]
    assert values(spark, ["$", "( )", "—", "$5"], X.is_symbol_only) == [True, False, True, False]
    assert values(spark, ["-", "N/A", "0"], N.is_placeholder) == [True, True, False]
    assert values(spark, ["table", " Picture ", "x"], X.role_of) == ["Table", "Figure", "Other"]
    assert values(spark, ["(5)", "5", "5 cr", "a"], X.number_sign) == [-1, 1, -1, None]


def test_contents_agree(spark):
    rows = [("$1,234", "1,234", True), ("100", "1000", False), ("North America", "north america (a)", True), ("$", "x", True), ("abc", "abd", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(X.contents_agree(F.col("a"), F.col("b")) != F.col("want")).count() == 0


box = st.tuples(*(st.integers(0, 50) for _ in range(4))).map(lambda t: (min(t[0], t[2]), min(t[1], t[3]), max(t[0], t[2]), max(t[1], t[3])))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(box, box), min_size=20, max_size=60))
def test_iou(spark, pairs):
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in pairs], [*(f"a{i}" for i in range(4)), *(f"b{i}" for i in range(4))])
    a, b = (G.box(*(F.col(f"{s}{i}") for i in range(4))) for s in "ab")
    for (p, q), (x, y) in zip(pairs, df.select(G.iou(a, b), G.iou(b, a)).collect()):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        common = max(w, 0) * max(h, 0)
        size = sum((t[2] - t[0]) * (t[3] - t[1]) for t in (p, q)) - common
        assert x == y == pytest.approx(common / size if common else 0, abs=1e-6) and 0 <= x <= 1


def test_coordinates(spark):
    b = spark.range(1).select(
        G.pixels_to_points(G.box(200, 200, 400, 400), F.lit(2.0)).alias("p"), G.crop_to_page(G.box(5, 5, 15, 25), F.lit(100.0), F.lit(200.0)).alias("c"),
        G.to_top_left(F.lit(10.0), F.lit(700.0), F.lit(20.0), F.lit(690.0), F.lit("BOTTOMLEFT"), F.lit(792.0)).alias("f"),
    ).first()
    assert tuple(b.p) == (100, 100, 200, 200) and tuple(b.c) == (105, 205, 115, 225) and tuple(b.f) == (10, 92, 20, 102)


def test_labels_and_urls(spark):
    assert values(spark, ["Plain Text", " TABLE ", "SectionHeader", "side_note", "chart"], X.canonical_label) == ["Text", "Table", "Section-header", "Side Note", "Chart"]
    assert values(spark, ["a+b%20c", "100%", "%zz%41", "caf%C3%A9", "%ff", ""], X.percent_decoded) == ["a b c", "100%", "%zzA", "café", "\ufffd", ""]
    assert values(spark, ["a b/c", "é~_.-", ""], X.url_encoded) == ["a%20b%2Fc", "%C3%A9~_.-", ""]
