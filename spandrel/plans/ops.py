"""The op graph: named ops over frames, chains of them, and escalation of flagged tables.

State is a dict of frames that share keys: spans (doc, page, ord, text, bbox, ...), regions (region_id, doc, page, bbox,
figure_score), words (table_id, ord, text, x0..y1), tables and cells. An op takes the state and returns the frames it makes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.functions.numbers import sign_fix
from spandrel.operators import detectors as D
from spandrel.operators import layout as L
from spandrel.operators import regions as R
from spandrel.operators import render as M
from spandrel.operators import tables as T
from spandrel.storage import saved

State = dict[str, DataFrame]


@dataclass(frozen=True)
class Op:
    """kind: Layout (1 to n), Extract, Transform or Merge (n to 1); takes and makes: kinds of artifact; tier: cost, 0 to 3."""

    id: str
    kind: str
    takes: str
    makes: str
    tier: int
    run: Callable[[State], State] | None


def page_regions(state: State) -> State:
    r = state["regions"].withColumn("region_id", F.concat_ws("#", "doc", "page", "ord")) if "region_id" not in state["regions"].columns else state["regions"]
    return {"regions": r.withColumns({"label": F.lit("Table"), "role": F.lit("Table"), "confidence": F.lit(1.0)})}


def text_grid(state: State) -> State:
    inside = R.spans_in_regions(state["spans"], state["regions"])
    words = inside.select(F.col("region_id").alias("table_id"), "doc", "page", "ord", "text", *(F.col(f"bbox.{s}").alias(s) for s in G.SIDES))
    return {"words": words, "grids": L.words_to_ascii(words, ["table_id"])}


def structured(state: State) -> State:
    cells = L.structure_words(state["words"], ["table_id", "doc", "page"])
    cells = cells.withColumns({"ord": F.col("row") * 100_000 + F.col("col"), "bbox": G.box("x0", "y0", "x1", "y1")}).drop(*G.SIDES)
    return with_tables(cells)


def with_tables(cells: DataFrame) -> State:
    tables = cells.groupBy("table_id", "doc", "page").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), G.union_agg(F.col("bbox")).alias("bbox"))
    return {"cells": cells, "tables": tables}


def naive_tables(state: State) -> State:
    """The text-layer parser: words by region, rebuilt by the naive model, with risk markers."""
    regions = page_regions(state)["regions"]
    inside = R.spans_in_regions(state["spans"], regions)
    words = inside.select(F.col("region_id").alias("table_id"), "doc", "page", "ord", "text", "confidence", "rotated", *(F.col(f"bbox.{s}").alias(s) for s in G.SIDES), *(F.col(f"region.{s}").alias(f"r{s}") for s in G.SIDES))
    cells = L.reconstruct_tables(words, ["table_id", "doc", "page"])
    cells = cells.withColumn("bbox", G.box("x0", "y0", "x1", "y1")).drop(*G.SIDES)
    sizes = cells.groupBy("table_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    tables = regions.select(F.col("region_id").alias("table_id"), "doc", "page", "bbox", "ord", "figure_score").join(sizes, "table_id").join(L.grid_risk(cells, words), "table_id", "left")
    tables = tables.withColumn("risk", F.col("risk").withField("figure_score", F.col("figure_score").cast("float")))
    texts = M.reading_order(state["spans"].withColumn("ord", F.struct(F.col("bbox.y0").alias("y"), F.col("bbox.x0").alias("x"), "ord")), ["doc", "page"])
    return {"cells": cells, "tables": tables, "texts": texts, "regions": regions}


def signs_fixed(state: State) -> State:
    fixed = state["cells"].withColumn("_new", sign_fix(F.col("text")))
    changed = fixed.groupBy("table_id").agg(F.sum((F.col("_new") != F.col("text")).cast("int")).alias("changed"))
    return {"cells": fixed.withColumn("text", F.col("_new")).drop("_new"), "changed": changed}


def through_markdown(state: State) -> State:
    """Render and read back: what does not survive a pipe table shows. Boxes are carried over by place."""
    grid = T.dense_grid(state["tables"], state["cells"])
    again = M.markdown_cells(M.table_markdown(grid))
    old = state["cells"].groupBy("table_id", "row", "col").agg(F.first("is_header").alias("is_header"), F.first("bbox").alias("bbox"))
    anchors = state["tables"].select("table_id", "doc", "page", F.col("bbox").alias("whole"))
    cells = again.join(old, ["table_id", "row", "col"], "left").join(anchors, "table_id").select("table_id", "doc", "page", "row", "col", (F.col("row") * 100_000 + F.col("col")).alias("ord"), "text", F.coalesce("is_header", F.lit(False)).alias("is_header"), F.coalesce("bbox", "whole").alias("bbox"))
    return {"cells": cells}


def merged(state: State) -> State:
    """All regions of a page as one, each side the median of theirs; a page with a single region is an error."""
    out = L.merge_regions(state["regions"], ["doc", "page"])
    single = state["regions"].groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    if out.isEmpty() or not single.isEmpty():
        raise ValueError("merge needs at least two regions on every page that has any")
    return {"regions": out.withColumns({"region_id": F.concat_ws("#", "doc", "page", F.lit("merged")), "role": F.lit("Table")})}


#: Tools that a session has not been given keep their place in the registry with no function.
OPS: dict[str, Op] = {
    o.id: o
    for o in (
        Op("pdf-text", "Extract", "Document", "HtmlTable", 0, naive_tables),
        Op("regions", "Layout", "Document", "Region", 0, page_regions),
        Op("text-grid", "Extract", "Region", "TextGrid", 0, text_grid),
        Op("structure", "Transform", "TextGrid", "HtmlTable", 0, structured),
        Op("sign-fix", "Transform", "HtmlTable", "HtmlTable", 0, signs_fixed),
        Op("markdown", "Transform", "HtmlTable", "HtmlTable", 0, through_markdown),
        Op("merge", "Merge", "Region", "Region", 0, merged),
        Op("docling", "Extract", "Document", "HtmlTable", 2, None),
        Op("text-table", "Extract", "Document", "HtmlTable", 1, None),
        Op("yolo26n", "Layout", "Document", "Region", 1, None),
        Op("yolo26s", "Layout", "Document", "Region", 1, None),
        Op("yolo26m", "Layout", "Document", "Region", 1, None),
        Op("doclayout", "Layout", "Document", "Region", 1, None),
        Op("surya", "Layout", "Document", "Region", 2, None),
        Op("reducto", "Extract", "Document", "HtmlTable", 3, None),
        Op("llamaparse", "Extract", "Document", "HtmlTable", 3, None),
    )
}


def op(name: str, ops: dict[str, Op] = OPS) -> Op:
    if name not in ops:
        raise ValueError(f"unknown op {name!r}")
    return ops[name]


def extractor_for(fmt: str, tier: int) -> Op:
    if fmt != "pdf" or tier != 0:
        raise NotImplementedError(f"no extractor for {fmt} at tier {tier}")
    return OPS["pdf-text"]


#: The frame that holds the artifacts of a kind.
FRAMES = {"Region": "regions", "TextGrid": "grids", "HtmlTable": "cells"}


def run_chain(state: State, names: list[str], ops: dict[str, Op] = OPS) -> list[tuple[int, str, State]]:
    """Every op's output as (generation, op, frames). Each works on the state all before have left; kinds must fit."""
    if not names:
        raise ValueError("empty chain")
    out, kind = [], "Document"
    for generation, name in enumerate(names):
        o = op(name, ops)
        if o.takes != kind:
            raise ValueError(f"op {name!r} takes {o.takes}, not {kind}")
        if o.run is None:
            raise ValueError(f"op {name!r} has no tool in this session")
        if kind != "Document" and state[FRAMES[kind]].isEmpty():
            raise ValueError(f"op {name!r} has nothing to work on")
        made = o.run(state)
        state, kind = state | made, o.makes
        out.append((generation, name, made))
    return out


def route(flags: DataFrame) -> DataFrame:
    """flags (table_id, reasons text, html, tried array) with candidates: targeted fixes first, then parsers, less those tried."""
    has = lambda word: F.contains("reasons", F.lit(word))
    totals = has("reconcile") | has("sum")
    signed = F.contains("html", F.lit("(")) | F.contains("html", F.lit("CR")) | F.contains("html", F.lit("DR"))
    stray = has("non-numeric") | has("ragged") | has("empty")
    only_scan = ~totals & ~stray & (has("OCR") | has("rotated"))
    order = F.when(totals & signed, F.array(F.lit("sign-fix"), F.lit("markdown"), F.lit("docling"))).when(only_scan, F.array(F.lit("docling"), F.lit("markdown"))).otherwise(F.array(F.lit("markdown"), F.lit("docling")))
    return flags.withColumn("candidates", F.array_except(order, F.coalesce("tried", F.array().cast("array<string>"))))


def checks(state: State) -> DataFrame:
    grid = T.model(state["tables"], state["cells"])
    return D.arithmetic(state["tables"], grid).unionByName(D.structure(state["tables"], grid))


def errors(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("table_id").agg(F.sum((F.col("flagged") & (F.col("severity") == "Error")).cast("int")).alias("errors"), F.concat_ws(" ; ", F.collect_list("reason")).alias("reasons"))


def attempt(o: Op, part: State, whole: State) -> State | None:
    """Tables and cells that an op makes of the flagged ones in `part`, under their ids; None if it can't be tried.

    An op on tables transforms them. One on documents parses `whole` again, and each flagged table takes the parsed table
    that overlaps it best on its page; tables without such a one are left out.
    """
    if o.run is None or o.takes not in ("HtmlTable", "Document"):
        return None
    if o.takes == "HtmlTable":
        return {k: v for k, v in (part | o.run(part)).items() if k in ("tables", "cells")}
    if "spans" not in whole:
        return None
    again = o.run(whole)
    best = R.best_overlap(part["tables"].select("table_id", "doc", "page", "bbox"), again["tables"].select("doc", "page", F.col("table_id").alias("found"), "bbox"), ["doc", "page"], "table_id", "found", 0.0)
    best = best.where("match IS NOT NULL").select("table_id", F.col("match").alias("_found"))
    renamed = lambda df: df.withColumnRenamed("table_id", "_found").join(best, "_found").drop("_found")
    return {"tables": renamed(again["tables"].select("table_id", "n_rows", "n_cols")), "cells": renamed(again["cells"])}


def escalate(state: State, budget: int = 3, ops: dict[str, Op] = OPS) -> list[tuple[int, str, State]]:
    """Attempts on flagged tables: (step, op, frames). A table takes on an attempt's cells where that has fewer errors.

    In a step every table that still has errors is tried with the ops it is routed to, one after the other, until one
    improves it; tables go through this at once, those bound for the same op together. A table that no op improves is done.
    """
    out, state, tried = [], dict(state), None
    for k in ("tables", "cells"):
        state[k] = saved(state[k], k)
    for step in range(budget):
        now = errors(checks(state)).where("errors > 0")
        html = M.table_html(T.model(state["tables"], state["cells"]))
        flags = now.join(html, "table_id")
        flags = flags.join(tried, "table_id", "left") if tried is not None else flags.withColumn("tried", F.array().cast("array<string>"))
        left = saved(route(flags).select("table_id", F.col("errors").alias("before"), F.coalesce("tried", F.array().cast("array<string>")).alias("tried"), "candidates"), "routed")
        seen = []
        while wanted := sorted(r["next"] for r in left.where("size(candidates) > 0").select(F.col("candidates")[0].alias("next")).distinct().collect()):  # as many as there are ops
            improved = None
            for name in wanted:
                some = left.where(F.get("candidates", F.lit(0)) == name).select("table_id", "before")
                part = {k: state[k].join(some.select("table_id"), "table_id", "left_semi") for k in ("tables", "cells")}
                made = attempt(op(name, ops), part, state)
                if made is None:
                    continue
                sizes = made["tables"].select("table_id", "n_rows", "n_cols")
                made = {"cells": saved(made["cells"], "attempt"), "tables": saved(part["tables"].drop("n_rows", "n_cols").join(sizes, "table_id").select(*state["tables"].columns), "attempt")}
                out.append((step + 1, name, made))
                better = saved(errors(checks(made)).join(some, "table_id").where("errors < before").select("table_id"), "better")
                for k in ("tables", "cells"):
                    kept = state[k].join(better, "table_id", "left_anti")
                    state[k] = saved(kept.unionByName(made[k].join(better, "table_id", "left_semi").select(*kept.columns)), k)
                improved = better if improved is None else improved.unionByName(better)
            left = left.withColumns({"tried": F.array_union("tried", F.slice("candidates", 1, 1)), "candidates": F.when(F.size("candidates") > 0, F.slice("candidates", F.lit(2), F.greatest(F.size("candidates") - 1, F.lit(0)))).otherwise(F.col("candidates"))})
            if improved is not None:
                seen.append(left.join(improved, "table_id", "left_semi").select("table_id", "tried"))
                left = left.join(improved, "table_id", "left_anti")
            left = saved(left, "routed")
        if not seen:
            break
        tried = saved(functools.reduce(DataFrame.unionByName, [*seen, left.select("table_id", "tried")]), "tried")
    out.append((budget + 1, "best", {"cells": state["cells"], "tables": state["tables"]}))
    return out
