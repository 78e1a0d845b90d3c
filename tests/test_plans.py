import json

import pytest
from pyspark.sql import functions as F

from spandrel.operators import detectors as D
from spandrel.operators.registry import Registry
from spandrel.plans import commands as C
from spandrel.plans import ops as O
from spandrel.sources import readers as S
from tests.test_sources import DOCLING, QDOC, folder, rows  # noqa: F401


@pytest.fixture(scope="module")
def state(spark, folder):  # noqa: F811
    s = C.load(spark, folder)
    return s | O.run_chain(s, ["pdf-text"])[-1][2]


def test_reconstruction(spark, state):
    grid = {(r.page, r.row, r.col): r.text for r in state["cells"].collect()}
    assert grid[1, 3, 0] == "Total" and grid[1, 3, 2] == "537" and grid[2, 2, 2] == "7"


def test_eval_finds_the_planted_failure(spark, state):
    truth = {"tables": [
        {"name": "yields", "page": 1, "bbox": [40, 90, 480, 200], "cells": [["Crop", "2031", "2030"], ["Oats", "410", "395"], ["Rye", "125", "142"], ["Total", "535", "537"]]},
        {"name": "uses", "page": 2, "bbox": [40, 90, 380, 175], "cells": [["Use", "2031"], ["Seed", "2,340"], ["Feed", "7"], ["Total", "2,347"]]},
    ]}
    evals, report = C.evaluate(state, *S.truth_tables(rows(spark, truth, S.TRUTH)))
    got = {r.name: r for r in evals.collect()}
    assert not got["yields"].wrong and got["yields"].flagged_by == [] and got["uses"].wrong and "structural_validity" in got["uses"].flagged_by
    r = report.first()
    assert (r.n_tables, r.n_wrong, r.catch_rate, r.false_alarm_rate) == (2, 1, 1.0, 0.0)


def test_chain(spark, folder, state):  # noqa: F811
    out = O.run_chain(C.load(spark, folder), ["regions", "text-grid", "structure", "sign-fix"])
    assert [n for _, n, _ in out] == ["regions", "text-grid", "structure", "sign-fix"] and out[-1][2]["cells"].where("text = '535'").count() == 1
    with pytest.raises(ValueError):
        O.run_chain(state, ["nope"])
    with pytest.raises(ValueError):
        O.run_chain(state, ["sign-fix"])
    with pytest.raises(ValueError):
        O.run_chain(state, ["regions", "merge"])
    with pytest.raises(NotImplementedError):
        O.extractor_for("pptx", 0)


def test_route(spark):
    flags = spark.createDataFrame([(1, "totals do not reconcile", "<td>(5)</td>", None), (2, "non-numeric cell", "", None), (3, "low OCR confidence", "", []), (4, "empty", "", ["markdown"])], "table_id int, reasons string, html string, tried array<string>")
    assert [r.candidates for r in O.route(flags).orderBy("table_id").collect()] == [["sign-fix", "markdown", "docling"], ["markdown", "docling"], ["docling", "markdown"], ["docling"]]


def test_escalation_fixes_signs(spark):
    grid = [["Item", "Amount"], ["a", "100"], ["b", "50 CR"], ["Total", "50"]]
    df = spark.createDataFrame([("t", grid, 1)], "table_id string, grid array<array<string>>, header_rows int")
    tables, cells = S.grid_cells(df)
    place = {"doc": F.lit("d"), "page": F.lit(1)}
    state = {"tables": tables.withColumns(place | {"bbox": F.lit(None).cast(S.G.BOX_TYPE)}), "cells": cells.withColumns(place)}
    tries = O.escalate(state)
    assert tries[-1][1] == "best" and len(tries) >= 2


def test_parse_logs_and_explains(spark, folder, tmp_path):  # noqa: F811
    registry = Registry(spark, str(tmp_path / "reg"))
    s = C.parse(spark, folder, registry)
    assert registry.current().count() == 2 and {r.verdict for r in registry.verdicts.collect()} == {"Winner", "Ambiguous"}
    assert {r.impression for r in C.explain(s).collect()} == {"Confirmed", "Suspect"} and C.explain(s, True).count() == 1
    assert C.ls(registry).count() == 2 and C.check(s).count() >= 1 and C.inspect(s).count() == 2
    typed, names = C.materialize(s)
    assert typed.where("dtype = 'int'").count() > 0 and names.count() > 0


def test_pipeline(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0, 500, None), ("d", 3, 612.0, 792.0, 0, 50.0), ("d", 4, 612.0, 792.0, 0, 0.0)], "doc string, page int, width double, height double, chars long, stddev double")
    registry = Registry(spark, str(tmp_path / "reg"))
    s = C.pipeline(pages, rows(spark, DOCLING, S.DOCLING), registry)
    assert [r.page for r in s["markers"].collect()] == [3] and registry.observations.count() == 1 and registry.verdicts.count() == 0
    assert C.text(s["elements"]).first().markdown.startswith("## Yields") and "4 elements" in C.text(s["elements"], True).first().summary
    done = spark.createDataFrame([], "kind string, source string")
    assert C.enrich(s["elements"], "summary", done).count() == 1
    assert C.enrich(s["elements"], "summary", C.enrich(s["elements"], "summary", done)).count() == 0


def test_judge(spark):
    box = lambda r, c: [100.0 * c + 5, 20.0 * r + 5, 100.0 * c + 95, 20.0 * r + 15]
    good = [["Item", "Amount"], ["a", "100"], ["b", "200"], ["Total", "300"]]
    boxes = [[box(r, c) for c in range(2)] for r in range(4)]
    words = [{"text": t, "bbox": [*box(r, c)[:2], box(r, c)[0] + 12, box(r, c)[3]]} for r, row in enumerate(good) for c, t in enumerate(row)]
    swapped = [good[0], ["a", "200"], ["b", "100"], good[3]]
    dropped = good[:2] + good[3:]
    base = {"header_rows": 1, "source": "s", "page": 1, "cell_boxes": boxes, "source_words": words, "region": [0.0, 0.0, 300.0, 100.0]}
    judged = [{**base, "id": "good", "grid": good}, {**base, "id": "swap", "grid": swapped, "alt_grid": good, "alt_cell_boxes": boxes, "alt_header_rows": 1}, {**base, "id": "drop", "grid": dropped, "cell_boxes": boxes[:2] + boxes[3:]}]
    df = spark.createDataFrame([(json.dumps(j),) for j in judged], "j string").select(F.from_json("j", S.JUDGE).alias("x")).select("x.*")
    got = {(r.table_id, r.check_id): r.flagged for r in C.judge(df).collect()}
    assert not any(v for (t, _), v in got.items() if t == "good")
    assert got["swap", "cross_tier_agreement"] and not got["swap", "reconstruction_error"] and got["drop", "reconstruction_error"]


def test_escalation_parses_again(spark):
    wrong, right = [["Crop", "Yield"], ["Oats", "4"], ["Rye", "5"], ["Total", "99"]], [["Crop", "Yield"], ["Oats", "4"], ["Rye", "5"], ["Total", "9"]]
    whole = F.struct(*(F.lit(float(v)).cast("float").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 90, 90))))

    def parsed(name, *grids):
        df = spark.createDataFrame([(f"{name}{k}", g, 1) for k, g in enumerate(grids)], "table_id string, grid array<array<string>>, header_rows int")
        tables, cells = S.grid_cells(df)
        place = {"doc": F.lit("d"), "page": F.substring("table_id", 2, 1).cast("int")}
        return {"tables": tables.withColumns(place | {"bbox": whole}), "cells": cells.withColumns(place)}

    seen = []
    again = O.Op("docling", "Extract", "Document", "HtmlTable", 2, lambda state: seen.append(1) or parsed("n", right, right))
    ops = O.OPS | {"docling": again}
    state = parsed("t", wrong, right) | {"spans": None}
    tries = O.escalate(state, ops=ops)
    assert [n for _, n, _ in tries] == ["markdown", "docling", "best"] and [k for k, _, _ in tries[:2]] == [1, 1] and len(seen) == 1
    cells = {(r.table_id, r.row, r.col): r.text for r in tries[-1][2]["cells"].collect()}
    assert cells["t0", 3, 1] == "9" and cells["t1", 3, 1] == "9" and len(cells) == 16
    assert O.errors(O.checks(tries[-1][2])).where("errors > 0").count() == 0


def test_chain_without_input(spark, folder):  # noqa: F811
    s = C.load(spark, folder)
    with pytest.raises(ValueError, match="nothing to work on"):
        O.run_chain(s | {"regions": s["regions"].limit(0)}, ["regions", "text-grid"])


def test_explain_and_judge_as_json(spark, state):
    got = [json.loads(r.json) for r in C.explain_json(state).collect()]
    assert sorted(x["impression"] for x in got) == ["confirmed", "suspect"]


def test_support(spark):
    spans = spark.createDataFrame([("d", 1, 0, "1,250", [10.0, 0.0, 20.0, 5.0])], "doc string, page int, ord int, text string, b array<float>").withColumn("bbox", S.G.box_of(F.col("b")))
    claims = spark.createDataFrame([(i, "d", 1, t, [0.0, 0.0, 50.0, 10.0]) for i, t in enumerate(["1250", "9,999", ""])], "claim_id int, doc string, page int, asserted string, b array<float>").withColumn("bbox", S.G.box_of(F.col("b"))).drop("b")
    assert [r.supported for r in D.answer_support(claims, spans).orderBy("claim_id").collect()] == [True, False, False]


def test_merge_loses_no_single_region(spark):
    r = spark.createDataFrame([("d", 1, [0.0, 0.0, 9.0, 9.0]), ("d", 1, [0.0, 0.0, 9.0, 7.0]), ("d", 2, [1.0, 1.0, 5.0, 5.0])], "doc string, page int, b array<float>").withColumn("bbox", S.G.box_of(F.col("b"))).drop("b")
    with pytest.raises(ValueError):
        O.merged({"regions": r})
    assert O.merged({"regions": r.where("page = 1")})["regions"].count() == 1


def test_pipeline_logs_markers_prose_and_regions(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0, 500, None), ("d", 3, 612.0, 792.0, 0, 50.0)], "doc string, page int, width double, height double, chars long, stddev double")
    registry = Registry(spark, str(tmp_path / "reg"))
    s = C.pipeline(pages, rows(spark, DOCLING, S.DOCLING), registry, ("markers", "tables", "prose", "regions"))
    got = registry.observations.collect()
    assert sorted(r.kind for r in got) == ["Document", "HtmlTable", "ImageRef", "Region", "Region", "Region"]
    image, prose = (next(r for r in got if r.kind == k) for k in ("ImageRef", "Document"))
    assert (image.page, image.status, image.artifact_id) == (3, "OcrDeferred", s["markers"].first().artifact_id)
    assert [e["text"] for e in json.loads(prose.payload)] == ["Yields", "barley north", "barley south", "seen in chart"]
    blank = C.pipeline(pages.where("page = 3"), rows(spark, DOCLING, S.DOCLING), Registry(spark, str(tmp_path / "two")))
    assert sorted(r.text for r in blank["elements"].collect()) == ["barley north", "barley south", "seen in chart"] and blank["regions"].count() == 0


def test_derived_artifacts_are_logged(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0, 500, None), ("d", 3, 612.0, 792.0, 0, 50.0)], "doc string, page int, width double, height double, chars long, stddev double")
    docling, registry = rows(spark, DOCLING, S.DOCLING), Registry(spark, str(tmp_path / "reg"))
    C.import_docling(docling, registry)
    assert registry.observations.count() == 1 and registry.verdicts.count() == 1
    s = C.pipeline(pages, docling, registry, ("markers", "prose"))
    C.materialize(s, registry)
    C.text(s["elements"], registry=registry)
    C.enrich(s["elements"], "summary", spark.createDataFrame([], "kind string, source string"), registry)
    C.ocr(s["markers"], s["markers"].select("artifact_id", F.lit("read").alias("text")), registry)
    got = registry.observations.collect()
    ids = {r.artifact_id: r.kind for r in got}
    derived = sorted((r.kind, [ids[p] for p in r.parents]) for r in got if r.generation == 1)
    assert derived == [("DbTable", ["HtmlTable"]), ("Enrichment", ["Document"]), ("Enrichment", ["ImageRef"]), ("Text", ["Document"])]
    assert registry.lineage.count() == 4
