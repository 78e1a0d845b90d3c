"""The commands of the system as functions: each takes frames or paths and returns frames."""

from __future__ import annotations

import functools
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.functions.text import content_id
from spandrel.operators import detectors as D
from spandrel.operators import layout as L
from spandrel.operators import regions as R
from spandrel.operators import registry as V
from spandrel.operators import render as M
from spandrel.operators import tables as T
from spandrel.operators import triage as P
from spandrel.operators import typed as Y
from spandrel.plans import ops as O
from spandrel.sources import exports as X
from spandrel.sources import readers as S


def load(spark: SparkSession, path: str, glob: str = "*.qdoc") -> O.State:
    pages, spans, regions = S.text_layers(spark, path, glob)
    return {"pages": pages, "spans": spans, "regions": regions}


def artifacts(state: O.State, generation: int = 0, extractor: str = "pdf-text") -> DataFrame:
    """The state's tables as registry artifacts; the id comes from document, page, box and content."""
    html = M.table_html(T.model(state["tables"], state["cells"]))
    t = state["tables"].join(html, "table_id")
    key = F.concat_ws("|", "doc", "page", F.to_json("bbox"), "html")
    gen = F.lit(generation)
    return t.select(
        "table_id", content_id(key, gen).alias("artifact_id"), content_id(key, gen).alias("element_id"), gen.alias("generation"), "doc", "page", "bbox", F.sha2("html", 256).alias("content_hash"),
        F.lit("ok").alias("status"), F.lit("HtmlTable").alias("kind"), F.lit(False).alias("is_manual"), F.array().cast("array<string>").alias("parents"), F.col("html").alias("payload"), F.struct("page", "table_id").alias("ord"),
    )


def logged(rows: DataFrame, kind: str, payload: Column, generation: int = 0) -> DataFrame:
    """rows (doc and, where they have them, page, bbox, status, parents and artifact_id) as registry artifacts of a kind."""
    have = lambda c, other: F.col(c) if c in rows.columns else other
    page, bbox, gen = have("page", F.lit(1)).cast("int"), have("bbox", F.lit(None)).cast(G.BOX_TYPE), F.lit(generation)
    own = have("artifact_id", content_id(F.concat_ws("|", F.lit(kind), "doc", page, F.to_json(bbox), payload), gen))
    return rows.select(
        own.alias("artifact_id"), own.alias("element_id"), gen.alias("generation"), "doc", page.alias("page"), bbox.alias("bbox"), F.sha2(payload, 256).alias("content_hash"), have("status", F.lit("ok")).alias("status"), F.lit(kind).alias("kind"),
        F.lit(False).alias("is_manual"), have("parents", F.array()).cast("array<string>").alias("parents"), payload.alias("payload"), F.struct(page.alias("page"), own.alias("table_id")).alias("ord"),
    )


def documents(elements: DataFrame) -> DataFrame:
    """The prose of each document as an artifact: its elements in order, as JSON."""
    listed = F.to_json(F.array_sort(F.collect_list(F.struct("ord", "role", "text", "page", "bbox"))))
    return logged(elements.groupBy("doc").agg(listed.alias("listed")), "Document", F.col("listed"))


def adjudicate_and_append(state: O.State, registry: V.Registry, generation: int = 0) -> DataFrame:
    """Check every table, judge it as the sole candidate of its element, and log both. Returns the verdicts."""
    rows = artifacts(state, generation).persist()
    named = rows.select("table_id", "artifact_id", "element_id")
    outcomes = O.checks(state).join(named, "table_id").drop("table_id").withColumnRenamed("artifact_id", "table_id")
    verdicts = D.adjudicate(outcomes, named.select("element_id", F.col("artifact_id").alias("table_id")))
    verdicts = verdicts.select("element_id", F.array("element_id").alias("candidates"), "flagged", "verdict", "winner", "confidence", F.lit("sole candidate").alias("rationale"))
    registry.append(rows, verdicts)
    return verdicts


def parse(spark: SparkSession, path: str, registry: V.Registry, op: str = "pdf-text", escalate: bool = False) -> O.State:
    state = load(spark, path)
    state |= O.run_chain(state, [op])[-1][2]
    adjudicate_and_append(state, registry)
    if escalate:
        for step, _, made in O.escalate(state):
            adjudicate_and_append(state | made, registry, step)
    return state


def chain(spark: SparkSession, path: str, ops: list[str], registry: V.Registry | None = None) -> O.State:
    state = load(spark, path)
    for generation, _, made in O.run_chain(state, ops):
        state |= made
        if registry and "tables" in made:
            adjudicate_and_append(state, registry, generation)
    return state


def judge(grids: DataFrame) -> DataFrame:
    """Outcomes for judge rows: the grid checks always, the residual where there are words, the second parse where one is given."""
    rows = grids.withColumn("table_id", F.col("id"))
    tables, cells = S.grid_cells(rows, "grid", "cell_boxes")
    place = rows.select("table_id", F.coalesce("source", F.lit("")).alias("doc"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce(S.G.box_of(F.col("region")), G.box(0, 0, 0, 0)).alias("bbox"))
    tables = tables.join(place, "table_id")
    spans = rows.select(F.coalesce("source", F.lit("")).alias("doc"), F.coalesce("page", F.lit(0)).alias("page"), F.col("table_id").alias("of"), F.posexplode("source_words").alias("ord", "w"))
    spans = spans.select(F.concat_ws("#", "doc", "of").alias("doc"), "page", "ord", "w.text", G.box_of(F.col("w.bbox")).alias("bbox"))
    own = tables.withColumn("doc", F.concat_ws("#", "doc", "table_id"))
    out = O.checks({"tables": tables, "cells": cells}).unionByName(D.residual(own, cells, spans))
    alt = rows.where("alt_grid IS NOT NULL")
    _, other = S.grid_cells(alt, "alt_grid", "alt_cell_boxes", "alt_header_rows")
    return out.unionByName(D.cross_tier(tables.join(alt.select("table_id"), "table_id", "left_semi"), cells, other))


def check(state: O.State) -> DataFrame:
    return O.checks(state).where("flagged")


def evaluate(state: O.State, truth: DataFrame, truth_cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per truth table (by document where it names one): matched, wrong, flagged_by; and the catch rates over all."""
    tables = state["tables"]
    if "truth_id" not in truth.columns:
        truth = truth.withColumn("truth_id", F.col("name"))
    match = D.match_truth(truth, tables)
    grid = T.model(tables, state["cells"])
    want = T.dense_grid(truth_cells.groupBy("table_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols")), truth_cells)
    got = grid.join(match.where("table_id IS NOT NULL").select("table_id", "truth_id"), "table_id").select(F.col("truth_id").alias("table_id"), "row", "col", "text")
    wrong = D.grid_diff(got, want).groupBy(F.col("table_id").alias("truth_id")).agg(F.count(F.lit(1)).alias("divergences"))
    outcomes = D.arithmetic(tables, grid).unionByName(D.structure(tables, grid)).unionByName(D.sampled_support(tables, state["cells"], state["spans"]))
    flags = outcomes.where("flagged").groupBy("table_id").agg(F.array_sort(F.collect_list("check_id")).alias("flagged_by"))
    evals = match.join(flags, "table_id", "left").join(wrong, "truth_id", "left")
    evals = evals.select(*(["doc"] if "doc" in truth.columns else []), "name", F.col("table_id").isNotNull().alias("matched"), (F.col("divergences").isNotNull() | F.col("table_id").isNull()).alias("wrong"), F.coalesce("divergences", F.lit(0)).alias("divergences"), "iou", F.coalesce("flagged_by", F.array().cast("array<string>")).alias("flagged_by"))
    return evals, D.catch_metrics(evals)


def inspect(state: O.State) -> DataFrame:
    """Per page: size, spans, table regions, rotated spans, lowest confidence."""
    s = state["spans"].groupBy("doc", "page").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("rotated").cast("int")).alias("rotated"), F.min("confidence").alias("confidence"))
    r = state["regions"].groupBy("doc", "page").agg(F.count(F.lit(1)).alias("regions"))
    return state["pages"].join(s, ["doc", "page"], "left").join(r, ["doc", "page"], "left").fillna(0, ["spans", "rotated", "regions"])


def explain(state: O.State, suspect_only: bool = False) -> DataFrame:
    found = D.assess(state["tables"], T.model(state["tables"], state["cells"]))
    return found.where("impression = 'Suspect'") if suspect_only else found


def explain_json(state: O.State) -> DataFrame:
    """table_id and json of what explain says."""
    grid = T.model(state["tables"], state["cells"])
    return X.evidence_json(state["tables"], D.assess(state["tables"], grid), grid)


def judge_json(grids: DataFrame) -> DataFrame:
    return X.judged_json(judge(grids))


def impressions(state: O.State) -> DataFrame:
    return explain(state).groupBy("impression").agg(F.count(F.lit(1)).alias("n"))


def import_docling(docs: DataFrame, registry: V.Registry | None = None) -> O.State:
    """Tables, cells, regions and elements from docling rows (doc and its columns); tables are adjudicated and logged."""
    tables, cells = S.docling_tables(docs)
    state = {"tables": tables, "cells": cells, "regions": S.docling_regions(docs), "elements": S.docling_elements(docs)}
    if registry:
        adjudicate_and_append(state, registry)
    return state


def segment(words: DataFrame, keys: list) -> DataFrame:
    """Blocks of each page with their number of columns."""
    blocks = L.xy_cut(words, keys)
    return blocks.join(L.column_count(words, keys), keys, "left")


def region_check(spans: DataFrame, regions: DataFrame, words: DataFrame) -> DataFrame:
    blocks = L.xy_cut(words, ["doc", "page"]).select("doc", "page", G.box("x0", "y0", "x1", "y1").alias("bbox"))
    return R.region_panel(spans, regions, blocks)


def triage(pages: DataFrame) -> DataFrame:
    return pages.withColumn("klass", P.page_class(F.col("chars"), F.coalesce("stddev", F.lit(100.0))))


def pipeline(pages: DataFrame, docling: DataFrame, registry: V.Registry, log: tuple = ("tables",)) -> O.State:
    """Triage, markers for what needs OCR, tables, prose and regions of the text pages. Detectors don't run on this path.

    `log` says what goes to the registry, in one write: any of markers, tables, prose and regions (the reference's command
    logs the first three, and regions on request). Prose without a place stays: it has no page to be judged by.
    """
    classed = triage(pages)
    state = import_docling(docling)
    wanted = classed.where("klass = 'text'").select("doc", "page")
    unplaced = state["elements"].where(F.col("bbox") == G.box(0, 0, 0, 0))
    unplaced = unplaced.join(wanted, ["doc", "page"], "left_anti")
    for name in ("tables", "regions", "elements"):
        state[name] = state[name].join(wanted, ["doc", "page"], "left_semi")
    state["elements"] = state["elements"].unionByName(unplaced.select(*state["elements"].columns))
    state["markers"] = P.ocr_markers(classed)
    kinds = {
        "markers": lambda: logged(state["markers"], "ImageRef", F.lit("")),
        "tables": lambda: artifacts(state).drop("table_id"),
        "prose": lambda: documents(state["elements"]),
        "regions": lambda: logged(state["regions"], "Region", F.to_json(F.struct("ord", "label", "role"))),
    }
    registry.append(functools.reduce(DataFrame.unionByName, [kinds[k]() for k in log]))
    return state


def of_documents(made: DataFrame, elements: DataFrame) -> DataFrame:
    """made (doc, ...) with parents: the artifact of its document's prose."""
    return made.join(documents(elements).select("doc", F.array("artifact_id").alias("parents")), "doc")


def materialize(state: O.State, registry: V.Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed cells and column names, section rows promoted; logged as one derived artifact a table."""
    grid = Y.promote_sections(T.model(state["tables"], state["cells"]))
    typed, names = Y.materialize(grid), Y.column_names(grid)
    if registry:
        listed = lambda df, name: df.groupBy("table_id").agg(F.to_json(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in df.columns if c != "table_id"]))))).alias(name))
        parts = artifacts(state).select("table_id", "doc", "page", "bbox", F.array("artifact_id").alias("parents"))
        parts = parts.join(listed(names, "names"), "table_id", "left").join(listed(typed, "typed"), "table_id", "left")
        registry.append(logged(parts, "DbTable", F.to_json(F.struct("names", "typed")), 1))
    return typed, names


def text(elements: DataFrame, summary: bool = False, registry: V.Registry | None = None) -> DataFrame:
    made = M.summary(elements, ["doc"]) if summary else M.document_markdown(elements, ["doc"])
    if registry:
        registry.append(logged(of_documents(made, elements), "Summary" if summary else "Text", F.col("summary" if summary else "markdown"), 1))
    return made


def enrich(elements: DataFrame, kind: str, registry_enrichments: DataFrame, registry: V.Registry | None = None) -> DataFrame:
    """New enrichments of a kind (doc as source): what is on record already is not made again."""
    work = V.enrichment_work(elements.select(F.lit(kind).alias("kind"), F.col("doc").alias("source")).distinct(), registry_enrichments)
    made = M.summary(elements, ["doc"]).withColumnRenamed("doc", "source").join(work, "source")
    made = made.select("kind", "source", content_id(F.concat(F.lit("enrich:"), "kind", F.lit(":"), "source"), F.lit(1)).alias("artifact_id"), F.col("summary").alias("text"))
    if registry:
        registry.append(logged(of_documents(made.withColumn("doc", F.col("source")), elements), "Enrichment", F.col("text"), 1))
    return made


def ls(registry: V.Registry) -> DataFrame:
    return M.previews(registry.current().withColumn("text", F.col("payload"))).select("element_id", "kind", "generation", "page", "preview")


def ocr(markers: DataFrame, texts: DataFrame, registry: V.Registry | None = None) -> DataFrame:
    """Recognized texts (artifact_id, text) as enrichments of the images that wait for them; blank ones are not logged."""
    found = markers.join(texts, "artifact_id").withColumn("parents", F.array("artifact_id"))
    if registry:
        read = found.where(F.trim("text") != "").select("doc", "page", "bbox", "parents", "text")
        registry.append(logged(read, "Enrichment", F.col("text"), 1))
    return found.select(F.lit("ocr").alias("kind"), F.col("artifact_id").alias("source"), "text")


def timed(stages: list) -> tuple[list, list]:
    """Runs (name, function) stages; returns their results and (name, milliseconds)."""
    out, log = [], []
    for name, run in stages:
        began = time.perf_counter()
        out.append(run())
        log.append((name, round((time.perf_counter() - began) * 1000)))
    return out, log
