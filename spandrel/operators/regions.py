"""Spatial joins between spans, regions and blocks. Every one is keyed on (doc, page) first, so pages never mix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import geometry as G

PAGE = ["doc", "page"]
REUSE = 0.7
AGREEMENT_BAR = 0.9


def spans_in_regions(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Every (span, region) of a page whose region holds the span's centre. spans: bbox; regions: region_id, bbox."""
    right = regions.select(*PAGE, "region_id", F.col("bbox").alias("region"))
    return spans.join(right, PAGE).where(G.contains_center(F.col("region"), F.col("bbox")))


def orphans(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Spans in no region of a known role."""
    right = regions.where("role <> 'Other'").select(F.col("doc").alias("_d"), F.col("page").alias("_p"), F.col("bbox").alias("_r"))
    near = (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")) & G.contains_center(F.col("_r"), F.col("bbox"))
    return spans.join(right, near, "left_anti")


def _matches(regions: DataFrame, blocks: DataFrame, least: float):
    right = blocks.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), F.col("bbox").alias("_b"))
    return right, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")) & (G.iou(F.col("bbox"), F.col("_b")) >= F.lit(least).cast("float"))


def disagreeing(regions: DataFrame, blocks: DataFrame, least: float = REUSE) -> DataFrame:
    right, near = _matches(regions, blocks, least)
    return regions.join(right, near, "left_anti")


def agreement(regions: DataFrame, blocks: DataFrame, least: float = REUSE, bar: float = AGREEMENT_BAR) -> DataFrame:
    """Per page: the share of regions that some block matches, and whether it reaches the bar."""
    right, near = _matches(regions, blocks, least)
    hit = regions.join(right, near, "left_semi").groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_hit"))
    every = regions.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"))
    out = every.join(hit, PAGE, "left").withColumn("agreement", F.coalesce(F.coalesce("_hit", F.lit(0)) / F.nullif(F.col("n"), F.lit(0)), F.lit(1.0)))
    return out.withColumn("accepted", F.col("agreement") >= bar).drop("_hit")


def best_overlap(left: DataFrame, right: DataFrame, keys: list, left_id: str, right_id: str, above: float, order: str | None = None) -> DataFrame:
    """Each left row's right row of largest IoU above a bound; ties go to the later one by `order` (or id)."""
    cands = right.select(*keys, F.col(right_id).alias("match"), F.col(order or right_id).alias("_ord"), F.col("bbox").alias("_box"))
    pairs = left.select(*keys, left_id, "bbox").join(cands, keys).withColumn("iou", G.iou(F.col("bbox"), F.col("_box"))).where(F.col("iou") > F.lit(above).cast("float"))
    best = pairs.groupBy(left_id).agg(F.max(F.struct("iou", "_ord", "match")).alias("_m")).select(left_id, F.col("_m.match").alias("match"), F.col("_m.iou").alias("iou"))
    return left.join(best, left_id, "left")


def register_or_match(new: DataFrame, prior: DataFrame, least: float = REUSE) -> DataFrame:
    """new (region_id, doc, page, role, bbox, mint) with element_id: the prior region's whose box it keeps, or its own mint."""
    keyed = best_overlap(new, prior, [*PAGE, "role"], "region_id", "element_id", -1.0, "seq")
    return keyed.withColumn("element_id", F.when(F.col("iou") >= F.lit(least).cast("float"), F.col("match")).otherwise(F.col("mint"))).drop("match")


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0])
    h = np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1])
    common = np.where((w > 0) & (h > 0), w * h, 0)
    size = lambda x: np.maximum(x[..., 2] - x[..., 0], 0) * np.maximum(x[..., 3] - x[..., 1], 0)
    return common / np.maximum(size(a) + size(b) - common, 1e-12)


def cluster_parsers(tables: DataFrame, least: float = 0.3, keep_first: bool = False) -> DataFrame:
    """tables (doc, page, parser, ord, x0..y1) with region: each joins the first region it overlaps by more than `least`,
    whose box grows to the union (or stays, with keep_first). The order matters, so a page is one step."""
    schema = f"{', '.join(f'{n} {t}' for n, t in tables.dtypes)}, region int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["parser", "ord"], kind="stable")
        found = np.zeros((0, 4))
        place = []
        for b in pdf[["x0", "y0", "x1", "y1"]].to_numpy(float):
            near = np.nonzero(_iou(b, found) > least)[0] if len(found) else []
            if len(near):
                k = int(near[0])
                if not keep_first:
                    found[k] = [*np.minimum(found[k, :2], b[:2]), *np.maximum(found[k, 2:], b[2:])]
            else:
                k = len(found)
                found = np.vstack([found, b])
            place.append(k)
        return pdf.assign(region=np.array(place, "int32"))

    return tables.groupBy(*PAGE).applyInPandas(run, schema)


def one_to_one(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy matching by page: left rows in order each take the best right row not yet taken. Both: doc, page, ord, x0..y1."""
    sides = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    types = dict(left.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.side == k].sort_values("ord", kind="stable") for k in (0, 1))
        boxes, free, rows = b[["x0", "y0", "x1", "y1"]].to_numpy(float), np.ones(len(b), bool), []
        for ord_, box in zip(a.ord, a[["x0", "y0", "x1", "y1"]].to_numpy(float)):
            score = np.where(free, _iou(box, boxes), -1) if len(boxes) else np.zeros(0)
            k = int(score.argmax()) if len(score) else -1
            hit = k >= 0 and score[k] >= least
            if hit:
                free[k] = False
            rows.append((pdf.doc.iloc[0], pdf.page.iloc[0], ord_, b.ord.iloc[k] if hit else None))
        return pd.DataFrame(rows, columns=["doc", "page", "ord", "match"])

    keep = [*PAGE, "ord", "x0", "y0", "x1", "y1", "side"]
    return sides.select(*keep).groupBy(*PAGE).applyInPandas(run, f"doc {types['doc']}, page {types['page']}, ord {types['ord']}, match {types['ord']}")


def rare_token_box(words: DataFrame, tokens: DataFrame, rare: int = 2, least: int = 3) -> DataFrame:
    """table_id and the box around its page's words whose token is rare there (all its words if none is); at least `least`."""
    counted = words.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc", "page", "token")))
    hits = counted.join(tokens.select("table_id", *PAGE, "token").distinct(), [*PAGE, "token"])
    few = F.sum((F.col("_n") <= rare).cast("int")).over(Window.partitionBy("table_id"))
    kept = hits.withColumn("_few", few).where((F.col("_n") <= rare) | (F.col("_few") < least))
    return kept.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), G.union_agg(F.col("bbox")).alias("bbox")).where(F.col("n") >= least)


def zip_by_order(left: DataFrame, right: DataFrame, left_order: list, right_order: list, keys: list) -> DataFrame:
    """The i-th row of each side of a group, side by side; rows without a partner stay with nulls."""
    number = lambda df, order: df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "_i"], "full").drop("_i")


def region_panel(spans: DataFrame, regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per page: regions by role, orphan spans, overlapping tables, agreement with the blocks, figures."""
    from spandrel.operators.detectors import region_pairs

    roles = regions.groupBy(*PAGE).pivot("role", ["Table", "Text", "Figure", "Caption", "Other"]).count().fillna(0)
    out = roles.join(orphans(spans, regions).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("orphans")), PAGE, "left")
    out = out.join(region_pairs(regions).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("overlaps")), PAGE, "left")
    return out.join(agreement(regions, blocks), PAGE, "left").fillna(0, ["orphans", "overlaps"])
