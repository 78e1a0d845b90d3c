import json

import pytest
from pyspark.sql import functions as F

from spandrel.sources import readers as S
from spandrel.sources import text_tables as X
from spandrel.sources.sidecars import apply_tool, run_command


def span(text, x, y, w=30):
    return {"text": text, "bbox": [x, y, x + w, y + 10]}


QDOC = {
    "format": "pdf",
    "pages": [
        {"page": 1, "width": 612, "height": 792, "spans": [span(t, 50 + 170 * c, 100 + 20 * r) for r, row in enumerate([["Crop", "2031", "2030"], ["Oats", "410", "395"], ["Rye", "125", "142"], ["Total", "535", "537"]]) for c, t in enumerate(row)],
         "table_regions": [{"bbox": [40, 90, 480, 200]}]},
        {"page": 2, "width": 612, "height": 792, "spans": [span("Use", 50, 100), span("2031", 270, 100), span("2,340", 270, 120), span("Seed", 50, 120), span("Feed", 50, 140), span("7", 298, 140, 7), span("Total", 50, 160), span("2,347", 270, 160)],
         "table_regions": [{"bbox": [40, 90, 380, 175], "figure_score": 0.2}]},
    ],
}


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    (path / "a.qdoc").write_text(json.dumps(QDOC))
    (path / "b.qdoc").write_bytes(b"%PDF not json")
    return str(path)


def test_text_layers(spark, folder):
    pages, spans, regions = S.text_layers(spark, folder, "*.qdoc")
    assert sorted(r.page for r in pages.collect()) == [1, 2] and spans.count() == 20
    first = spans.where("page = 1 AND ord = 0").first()
    assert (first.text, first.confidence, first.rotated, tuple(first.bbox)) == ("Crop", 1.0, False, (50, 100, 80, 110))
    assert [round(r.figure_score, 2) for r in regions.orderBy("page").collect()] == [0, 0.2] and S.files(spark, folder).count() == 2


DOCLING = {
    "pages": {"1": {"size": {"width": 612, "height": 792}}},
    "tables": [{"prov": [{"page_no": 1, "bbox": {"l": 48, "t": 730, "r": 300, "b": 650, "coord_origin": "BOTTOMLEFT"}}], "data": {"num_rows": 2, "num_cols": 2, "table_cells": [
        {"bbox": {"l": 48, "t": 62, "r": 150, "b": 80, "coord_origin": "TOPLEFT"}, "text": "Crop", "start_row_offset_idx": 0, "start_col_offset_idx": 0, "column_header": True},
        {"text": "64", "start_row_offset_idx": 1, "start_col_offset_idx": 1}]}}],
    "texts": [{"label": "list_item", "text": "barley  north", "prov": []}, {"label": "text", "text": "seen in chart", "prov": []}, {"label": "text", "text": " ", "prov": []}, {"label": "list_item", "text": "barley south", "prov": []}, {"label": "section_header", "text": "Yields", "prov": [{"page_no": 1, "bbox": {"l": 3, "t": 20, "r": 9, "b": 12, "coord_origin": "TOPLEFT"}}]}],
    "groups": [{"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/1"}]}, {"children": [{"$ref": "#/texts/3"}, {"$ref": "#/groups/0"}]}],
    "pictures": [{"prov": [{"page_no": 1, "bbox": {"l": 0, "t": 100, "r": 50, "b": 50, "coord_origin": "BOTTOMLEFT"}}], "children": [{"$ref": "#/texts/1"}]}],
    "body": {"children": [{"$ref": "#/texts/4"}, {"$ref": "#/groups/0"}, {"$ref": "#/pictures/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/2"}, {"$ref": "#/texts/40"}]},
}


def rows(spark, doc, schema):
    return spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.lit("d").alias("doc"), F.from_json("j", schema).alias("x")).select("doc", "x.*")


def test_docling(spark):
    docs = rows(spark, DOCLING, S.DOCLING)
    tables, cells = S.docling_tables(docs)
    assert tuple(tables.first().bbox) == (48, 62, 300, 142)
    got = {(r.row, r.col): (r.text, r.is_header, tuple(r.bbox)) for r in cells.collect()}
    assert got == {(0, 0): ("Crop", True, (48, 62, 150, 80)), (1, 1): ("64", False, (0, 0, 0, 0))}
    assert sorted(r.role for r in S.docling_regions(docs).collect()) == ["Figure", "Table", "Text"]
    elements = [(r.role, r.text) for r in S.docling_elements(docs).orderBy("ord").collect()]
    assert elements == [("Heading", "Yields"), ("ListItem", "barley north"), ("ListItem", "barley south"), ("Figure", "seen in chart")]


def test_layout_and_cloud(spark):
    got = S.layout_regions(rows(spark, {"regions": [{"bbox": [100, 200, 1080, 600]}], "scale": 2}, S.LAYOUT)).first()
    assert (got.label, got.confidence, tuple(got.bbox)) == ("Table", 1.0, (50, 100, 540, 300))
    tables, cells = S.cloud_tables(rows(spark, {"tables": [{"page": 1, "bbox": [0, 0, 9, 9], "n_rows": 1, "n_cols": 1, "cells": [{"row": 0, "col": 0, "text": "x"}]}]}, S.CLOUD))
    assert tuple(cells.first().bbox) == (0, 0, 9, 9) and not cells.first().is_header
    words = S.region_words(rows(spark, {"text": "a", "words": [{"text": "a", "x0": 1, "y0": 2, "x1": 3, "y1": 4}]}, S.LITEPARSE_REGION))
    assert tuple(words.first().bbox) == (1, 2, 3, 4)
    spans = S.liteparse_spans(rows(spark, {"pages": [{"page": 1, "textItems": [{"text": "a", "x": 1, "y": 2, "width": 3, "height": 4, "confidence": 0.5}, {"text": " "}]}]}, S.LITEPARSE_DOC))
    assert [tuple(r.bbox) for r in spans.collect()] == [(1, 2, 4, 6)]


def test_truth(spark):
    doc = {"tables": [{"name": "t", "page": 1, "bbox": [0, 0, 1, 1], "cells": [["a", "b"], ["c"]]}]}
    truth, cells = S.truth_tables(rows(spark, doc, S.TRUTH))
    assert truth.first().column_types == [] and sorted((r.row, r.col, r.text, r.is_header) for r in cells.collect()) == [(0, 0, "a", True), (0, 1, "b", True), (1, 0, "c", False)]


def test_html_grids():
    html = "<table><tr><th colspan=2>A &amp; B</th></tr><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>"
    assert X.html_grids(html) == [([["A & B", ""], ["x", "1"], ["", "2"]], 1)]
    assert X.html_grids("<p>none</p>") == []


def test_text_grids():
    pipes = "text\n| a | b |\n|---|---|\n| 1 | 2 |\nmore"
    assert X.pipe_grids(pipes) == [[["a", "b"], ["1", "2"]]] and X.pipe_grids("| a | b |") == []
    block = "Date      Value\n2020      10\n2021      200\n\nprose here"
    assert X.aligned_grids(block) == [[["Date", "Value"], ["2020", "10"], ["2021", "200"]]]
    assert len(X.grids(pipes + "<table><tr><td>x</td></tr></table>")) == 2


def test_scan(spark):
    df = spark.createDataFrame([(1, "| a | b |\n| 1 | 2 |"), (2, None), (3, "")], "id long, text string")
    assert sorted((r.id, r.row, r.col, r.text) for r in X.scan(df, "text", "id").collect()) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "1"), (1, 1, 1, "2")]


def test_sidecar(spark, folder):
    assert apply_tool(S.files(spark, folder, "*.qdoc"), lambda b: str(len(b))).count() == 2
    assert run_command(["cat"], b"x") == "x"
    with pytest.raises(RuntimeError):
        run_command(["false"], b"")


def test_pages_remapped_and_crops_rebased(spark):
    docs = rows(spark, DOCLING, S.DOCLING)
    again = S.remapped_pages(docs, spark.createDataFrame([("d", 1, 17), ("x", 1, 3)], "doc string, sub int, page int"))
    tables, cells = S.docling_tables(again)
    assert (tables.first().page, {r.page for r in cells.collect()}, tuple(tables.first().bbox)) == (17, {17}, (48, 62, 300, 142))
    assert {r.page for r in S.docling_elements(again).collect()} == {1, 17}  # a text without a place is on page 1
    crops = spark.createDataFrame([(tables.first().table_id, 4, 100.0, 200.0)], "table_id string, page int, x0 double, y0 double")
    moved, parts = S.rebased(tables, cells, crops)
    assert (moved.first().page, tuple(moved.first().bbox)) == (4, (148, 262, 400, 342)) and {tuple(r.bbox) for r in parts.collect()} == {(148, 262, 250, 280), (100, 200, 100, 200)}


def test_pages_to_run_on(spark, folder):
    pages, _, _ = S.text_layers(spark, folder, "*.qdoc")
    got = S.extent_pages(S.files(spark, folder, "*.qdoc"), pages).collect()
    assert sorted((r.page, r.width, r.height) for r in got) == [(1, 612, 792), (1, 612, 792), (2, 612, 792)] and len({r.doc for r in got}) == 2


def test_bare_text():
    text = "Crop        (spring)  (autumn)\nOats   $      41,000    39,500\nRye           12,500    14,200\n\nTotal  $      53,500    53,700"
    # a word whose middle is within two places of the label column's end belongs to the label
    assert X.structured_text(text) == ([["Crop (spring)", "", "(autumn)"], ["Oats $", "41,000", "39,500"], ["Rye", "12,500", "14,200"], ["Total $", "53,500", "53,700"]], 1)
    assert X.structured_text("") == ([], 0) and X.structured_text("one line") == ([["one line"]], 0) and X.structured_text("ab cd\nef") == ([["ab cd"], ["ef"]], 1)


def test_word_boxes(spark):
    docs = spark.createDataFrame([("d", [("a", 1.0, 2.0, 3.0, 4.0)])], f"doc string, words array<struct<{S.WORDS.replace(' ', ':')}>>".replace(",:", ", "))
    assert tuple(S.word_boxes(docs).first().bbox) == (1, 2, 3, 4)
