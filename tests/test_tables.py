import pytest
from pyspark.sql import functions as F

from spandrel.operators import detectors as D
from spandrel.operators import render as M
from spandrel.operators import tables as T
from spandrel.operators import typed as Y
from spandrel.sources.readers import grid_cells


def table(spark, *grids, headers=1):
    df = spark.createDataFrame([(f"t{i}", g, headers) for i, g in enumerate(grids)], "table_id string, grid array<array<string>>, header_rows int")
    return grid_cells(df)


def model(spark, *grids, **k):
    return T.model(*table(spark, *grids, **k))


def outcome(df):
    return {r.table_id: r for r in df.collect()}


GOOD = [["Crop", "2031", "2030"], ["Oats", "410", "395"], ["Rye", "125", "142"], ["Total harvest", "535", "537"]]
BAD = [["Item", "Amount"], ["a", "100"], ["b", "200"], ["Total", "999"]]
NONE = [["Item", "Amount"], ["a", "100"], ["b", "200"]]


def test_model_and_reconcile(spark):
    grid = model(spark, GOOD, BAD)
    kinds = {(r.table_id, r.row): r.row_kind for r in T.row_kinds(grid).collect()}
    assert [kinds["t0", i] for i in range(4)] == ["Header", "Data", "Data", "Total"]
    assert {(r.table_id, r.col): r.col_type for r in T.column_types(grid).collect()}["t0", 0] == "Label"
    assert {(r.table_id, r.col): r.ok for r in T.reconcile(grid).collect()} == {("t0", 1): True, ("t0", 2): True, ("t1", 1): False}


def test_grand_total_meets_only_the_rows_since_the_last_total(spark):
    rows = [["Item", "Amount"], ["a", "10"], ["b", "5"], ["Subtotal", "15"], ["c", "3"], ["Total", "18"]]
    assert [(r.sum, r.ok) for r in T.reconcile(model(spark, rows)).orderBy("row").collect()] == [(15, True), (3, False)]


def test_percent_totals_and_sections_are_left_out(spark):
    rows = [["Item", "Amount"], ["Revenue:", ""], ["a", "10"], ["b", "5"], ["c", "1"], ["Total", "16%"]]
    grid = model(spark, rows)
    assert T.reconcile(grid).count() == 0 and {r.row: r.row_kind for r in T.row_kinds(grid).collect()}[1] == "Section"


def test_impressions(spark):
    tables, cells = table(spark, GOOD, BAD, NONE)
    got = {r.table_id: r.impression for r in D.assess(tables, T.model(tables, cells)).collect()}
    assert got == {"t0": "Confirmed", "t1": "Suspect", "t2": "NoIssues"}


def test_year_headers_are_headers_and_number_headers_are_not(spark):
    numbers = [["x", "10", "20"], ["a", "1", "2"], ["b", "3", "4"]]
    got = {r.table_id: r.header_missing for r in T.header_missing(model(spark, GOOD, numbers)).collect()}
    assert got == {"t0": False, "t1": True}


def test_structure_check(spark):
    stray = [["i", "v"], ["a", "1"], ["b", "see note"], ["c", "3"]]
    empty = [["i", "v", "w"], ["a", "1", "2"], ["b", "", "2"], ["c", "3", "4"]]
    tables, cells = table(spark, GOOD, stray, empty)
    got = outcome(D.structure(tables, T.model(tables, cells)))
    assert not got["t0"].flagged and got["t0"].confidence == 0.9
    assert got["t1"].severity == "Error" and "non-numeric" in got["t1"].reason and "empty" in got["t2"].reason


def test_arithmetic_check(spark):
    tables, cells = table(spark, GOOD, BAD, NONE)
    got = outcome(D.arithmetic(tables, T.model(tables, cells)))
    assert [got[f"t{i}"].flagged for i in range(3)] == [False, True, False] and got["t0"].confidence == 0.97 and got["t2"].confidence == 0.6


def test_adjudication(spark):
    out = spark.createDataFrame([("a", "c", False, None, 0.9, None), ("b", "c", True, "Error", None, "r"), ("c", "c", False, None, 0.8, None), ("d", "c", False, None, 0.7, None)], "table_id string, check_id string, flagged boolean, severity string, confidence double, reason string")
    cands = spark.createDataFrame([("e1", "a"), ("e2", "b"), ("e3", "c"), ("e3", "d"), ("e4", None)], "element_id string, table_id string")
    got = {r.element_id: (r.verdict, r.confidence, r.winner) for r in D.adjudicate(out, cands).collect()}
    assert got == {"e1": ("Winner", 0.9, "a"), "e2": ("Ambiguous", 0.0, None), "e3": ("Equivalent", 0.7, None), "e4": ("Equivalent", 0.0, None)}


def test_doubled_cells(spark):
    cells = spark.createDataFrame([("t", 0, 0, 0, "first", False), ("t", 0, 0, 1, "last", False), ("t", 9, 9, 2, "out", False)], "table_id string, row int, col int, ord int, text string, is_header boolean")
    tables = spark.createDataFrame([("t", 1, 2)], "table_id string, n_rows int, n_cols int")
    assert [r.text for r in T.dense_grid(tables, cells).orderBy("col").collect()] == ["last", ""]
    assert {(r.row, r.col): r.text for r in T.cell_at(cells).collect()}[0, 0] == "first"


def test_empty_tables(spark):
    tables, cells = table(spark)
    assert T.reconcile(T.model(tables, cells)).count() == 0 and D.assess(tables, T.model(tables, cells)).count() == 0


def test_markdown_round_trip(spark):
    tables, cells = table(spark, GOOD)
    back = M.markdown_cells(M.table_markdown(T.dense_grid(tables, cells)))
    assert sorted((r.row, r.col, r.text) for r in back.collect()) == sorted((i, j, x) for i, row in enumerate(GOOD) for j, x in enumerate(row))
    piped = M.table_markdown(T.dense_grid(*table(spark, [["a|b"], ["c"]]))).first().markdown
    assert piped == "| a\\|b |\n| --- |\n| c |"


def test_html(spark):
    html = M.table_html(model(spark, [["h<b>&"], ["x"]])).first().html
    assert html == "<table><tr><th>h&lt;b&gt;&amp;</th></tr><tr><td>x</td></tr></table>"


def test_materialize_and_melt(spark):
    grid = model(spark, [["Segment", "Revenue", "Share"], ["Parks", "$100", "12%"], ["Studios", "$220.5", "n/a"], ["Other", "x", "8%"]])
    typed = Y.materialize(grid)
    kinds = {r.col: r.dtype for r in typed.select("col", "dtype").distinct().collect()}
    assert kinds == {0: "label", 1: "currency", 2: "percent"} and typed.where("NOT ok").count() == 1
    names = Y.column_names(grid)
    melted = sorted((r.row, r.variable, r.value, r.ids["Segment"]) for r in Y.melt(typed, names).collect())
    assert melted == [(0, "Revenue", 100, "Parks"), (0, "Share", 12, "Parks"), (1, "Revenue", 220.5, "Studios"), (2, "Share", 8, "Other")]
    assert [tuple(r) for r in Y.to_frame(typed, names, "t0").collect()][0] == ("Parks", 100.0, 12.0)
    assert {r.col: r.violations for r in Y.report(typed).collect()} == {0: 0, 1: 1, 2: 0}


def test_plain_types(spark):
    grid = model(spark, [["Segment", "Revenue", ""], ["Parks", "100......", ""], ["Studios", "220.5", ""]])
    assert [(r.name, r.dtype) for r in Y.plain_types(grid).orderBy("col").collect()] == [("Segment", "Text"), ("Revenue", "Float"), ("col2", "Empty")]


def test_names_and_sections(spark):
    grid = model(spark, [["a", "a", "", ""], ["Costs:", "", "", ""], ["x", "1", "2", "3"], ["Gains:", "", "", ""], ["y", "1", "2", "3"]])
    assert [r.name for r in Y.column_names(grid).orderBy("col").collect()] == ["a", "a_2", "col_2", "col_3"]
    got = Y.promote_sections(grid).where("col = 0").orderBy("row").select("text", "section").collect()
    assert [tuple(r) for r in got] == [("a", "Section"), ("x", "Costs:"), ("y", "Gains:")]


def test_catch_metrics(spark):
    evals = spark.createDataFrame([("a", True, True, ["answer_support"]), ("b", True, False, []), ("c", False, True, []), ("d", True, False, ["structural_validity"])], "name string, matched boolean, wrong boolean, flagged_by array<string>")
    r = D.catch_metrics(evals).first()
    assert (r.n_wrong, r.catch_rate, r.false_alarm_rate, r.missed, r.caught_answer_support) == (2, 0.5, 0.5, ["c"], 1)


def test_sections_and_document(spark):
    rows = [("d", 0, "Paragraph", "intro", 1), ("d", 1, "Heading", "H", 1), ("d", 2, "ListItem", "x", 1), ("d", 3, "Figure", "seen", 2)]
    e = spark.createDataFrame(rows, "doc string, ord int, role string, text string, page int")
    assert [(r.section, r.heading) for r in M.sections(e, ["doc"]).orderBy("ord").collect()] == [(0, None), (1, "H"), (1, "H"), (1, "H")]
    assert M.document_markdown(e, ["doc"]).first().markdown == "intro\n\n## H\n\n- x\n\n## Text in figures\n\n### Page 2\n\nseen"
    assert M.summary(e, ["doc"]).first().summary.startswith("4 elements\nH\nintro")


def test_markdown_keeps_what_a_pipe_table_says(spark):
    text = "intro | no row\n| a | b |\n| --- | :-: |\n| - | -- |\n  | c||\n| x | |"
    df = spark.createDataFrame([("t", text)], "table_id string, markdown string")
    got = [(r.row, r.col, r.text) for r in M.markdown_cells(df).orderBy("row", "col").collect()]
    assert got == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (2, 0, "x"), (2, 1, "")]


def test_from_html(spark):
    html = "<table><tr><th>Crop</th><th>Yield</th></tr><tr><td>Oats</td><td>$410</td></tr><tr><td>Rye</td><td>(12)</td></tr></table><table><tr><td>other</td></tr></table>"
    typed, names = Y.from_html(spark.createDataFrame([("t", html)], "table_id string, html string"))
    assert sorted((r.row, r.value) for r in typed.where("col = 1").collect()) == [(0, 410), (1, -12)] and [r.name for r in names.orderBy("col").collect()] == ["Crop", "Yield"]
    html = "<table><tr><td>a</td><td>b</td></tr><tr><td>North</td><td></td></tr><tr><td>x</td><td>1</td></tr><tr><td>South</td><td></td></tr><tr><td>y</td><td>2</td></tr></table>"
    typed, names = Y.from_html(spark.createDataFrame([("t", html)], "table_id string, html string"), sections=True)
    assert [tuple(r) for r in Y.to_frame(typed, names, "t").collect()] == [("North", "x", 1), ("South", "y", 2)]


def test_outputs(spark, tmp_path):
    import json

    from spandrel.sources import exports as E

    tables, cells = table(spark, GOOD, BAD)
    grid = T.model(tables, cells)
    got = {r.table_id: json.loads(r.json) for r in E.evidence_json(tables, D.assess(tables, grid), grid).collect()}
    assert (got["t0"]["impression"], got["t0"]["rows"], got["t0"]["cols"], got["t0"]["col_types"]) == ("confirmed", 4, 3, ["label", "numeric", "numeric"])
    assert got["t1"]["impression"] == "suspect" and any(not s["positive"] for s in got["t1"]["signals"])
    flags = {r.table_id: json.loads(r.json) for r in E.judged_json(D.arithmetic(tables, grid)).collect()}
    assert not flags["t0"]["flagged"] and flags["t0"]["signals"] == [] and [s["check"] for s in flags["t1"]["signals"]] == ["intrinsic_arithmetic"]
    E.table_files(M.table_html(grid), str(tmp_path / "html"))
    assert spark.read.text(str(tmp_path / "html")).where("value LIKE '<table>%'").count() == 2
    e = spark.createDataFrame([("d", 0, "Title", "<T>"), ("d", 1, "Paragraph", "p")], "doc string, ord int, role string, text string")
    assert E.prose_html(e, ["doc"]).first().html == "<h1>&lt;T&gt;</h1>\n<p>p</p>"


def test_placed_risk(spark):
    from spandrel.operators import layout as L

    tables, cells = table(spark, [["a", "1"], ["b", ""], ["", ""]], [])
    got = {r.table_id: r.risk for r in L.placed_risk(tables, cells).collect()}
    assert (got["t0"].merged_cell_rows, got["t0"].empty_cells, round(got["t0"].column_count_variance, 4)) == (2, 3, 0.6667)
    assert (got["t1"].merged_cell_rows, got["t1"].empty_cells, got["t1"].column_count_variance) == (0, 0, 0)


def test_truth_of_two_documents(spark):
    box = "struct<x0:float,y0:float,x1:float,y1:float>"
    parsed = spark.createDataFrame([("A1", "A", 1, 0, (0.0, 0.0, 9.0, 9.0)), ("B1", "B", 1, 0, (0.0, 0.0, 10.0, 10.0))], f"table_id string, doc string, page int, ord int, bbox {box}")
    truth = spark.createDataFrame([("A", "t", 1, 0, (0.0, 0.0, 10.0, 10.0))], f"doc string, name string, page int, ord int, bbox {box}")
    assert [r.table_id for r in D.match_truth(truth, parsed).collect()] == ["A1"]
    with pytest.raises(ValueError):
        D.match_truth(truth.drop("doc"), parsed)
    assert [r.table_id for r in D.match_truth(truth.drop("doc"), parsed.where("doc = 'B'")).collect()] == ["B1"]
