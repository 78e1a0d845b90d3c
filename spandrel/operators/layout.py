"""Word geometry: column intervals, row clusters, page segmentation, and tables rebuilt from words.

Interval merging is a window over (group, left edge). Clusterings whose next step depends on an anchor are folds over a
group's sorted array. What is procedural by nature (recursive cuts, symbol columns) runs once per group in pandas.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import geometry as G


def intervals(words: DataFrame, keys: list, low: str, high: str, gap: float) -> DataFrame:
    """keys, band, low and high: spans closer than `gap` along one axis merged, numbered from 0 in order."""
    order = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = words.withColumn("_new", F.when(reach.isNull() | (F.col(low) > (reach + F.lit(gap).cast("float"))), 1).otherwise(0))
    banded = opened.withColumn("band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return banded.groupBy(*keys, "band").agg(F.min(low).alias("low"), F.max(high).alias("high"))


def column_intervals(words: DataFrame, keys: list, gap: float = 6.0) -> DataFrame:
    return intervals(words, keys, "x0", "x1", gap)


def column_bands(words: DataFrame, keys: list, gutter: float = 12.0) -> DataFrame:
    return intervals(words, keys, "x0", "x1", gutter)


def column_count(words: DataFrame, keys: list, gutter: float = 12.0) -> DataFrame:
    return column_bands(words, keys, gutter).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_columns"))


def column_mismatch(claimed: DataFrame, words: DataFrame, keys: list, gutter: float = 12.0) -> DataFrame:
    """keys, claimed and n_columns where the words show another, non-zero number of columns."""
    return claimed.join(column_count(words, keys, gutter), keys).where("n_columns <> 0 AND n_columns <> claimed")


def anchor_clusters(df: DataFrame, keys: list, value: str, tolerance: float) -> DataFrame:
    """keys, cluster and anchor: sorted values join a cluster while within `tolerance` of its first value."""
    start = F.array().cast("array<double>")
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.col(value).cast("double"))), start,
        lambda acc, x: F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) <= tolerance), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return df.groupBy(*keys).agg(fold.alias("_anchors")).select(*keys, F.posexplode("_anchors").alias("cluster", "anchor"))


def mean_clusters(df: DataFrame, keys: list, value: str, tolerance: float) -> DataFrame:
    """keys, cluster, mean and n: sorted values join the last cluster while within `tolerance` of its running mean."""
    start = F.array().cast("array<struct<s:double,n:double>>")
    one = lambda x: F.struct(x.alias("s"), F.lit(1.0).alias("n"))
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last(acc).s + x).alias("s"), (last(acc).n + 1).alias("n"))))
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.col(value).cast("double"))), start,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.abs(x - last(acc).s / last(acc).n) <= tolerance), grown(acc, x)).otherwise(F.concat(acc, F.array(one(x)))),
    )
    out = df.groupBy(*keys).agg(fold.alias("_c")).select(*keys, F.posexplode("_c").alias("cluster", "c"))
    return out.select(*keys, "cluster", (F.col("c.s") / F.col("c.n")).alias("mean"), F.col("c.n").cast("long").alias("n"))


def lag_clusters(df: DataFrame, keys: list, value: str, gap) -> DataFrame:
    """df with cluster: a new one wherever a value exceeds the one before by more than `gap` (a number or column)."""
    order = Window.partitionBy(*keys).orderBy(value)
    jump = F.col(value) - F.lag(value).over(order)
    return df.withColumn("_new", (jump > gap).cast("int")).withColumn("cluster", F.coalesce(F.sum("_new").over(order), F.lit(0))).drop("_new")


def upper_median(x):
    """Aggregate: the element at n // 2 of the sorted values."""
    s = F.array_sort(F.collect_list(x))
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


# --- procedures on one group's words, as arrays of x0, y0, x1, y1 and texts ---


def split_at_gaps(low: np.ndarray, high: np.ndarray, gap: float) -> list[np.ndarray]:
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])
    return np.split(order, np.nonzero(low[order][1:] > reach[:-1] + np.float32(gap))[0] + 1)


def cut_page(boxes: np.ndarray, x_gap: float = 12.0, y_gap: float = 8.0) -> list[np.ndarray]:
    """Row numbers of each leaf in reading order: the axis with more bands is cut first, down before across on a tie."""
    leaves, stack = [], [np.arange(len(boxes))] if len(boxes) else []
    while stack:
        rows = stack.pop()
        down = split_at_gaps(boxes[rows, 1], boxes[rows, 3], y_gap)
        across = split_at_gaps(boxes[rows, 0], boxes[rows, 2], x_gap)
        parts = down if len(down) > 1 and len(down) >= len(across) else across if len(across) > 1 else None
        if parts is None:
            leaves.append(rows)
        else:
            stack += [rows[p] for p in reversed(parts)]
    return leaves


def lines_of(boxes: np.ndarray) -> list[list[int]]:
    """Words by lines: one joins while its middle lies in the line's extent so far; left to right within a line."""
    lines: list = []
    low = high = 0.0
    for k in np.argsort(boxes[:, 1], kind="stable").tolist():
        middle = (boxes[k, 1] + boxes[k, 3]) / 2
        if lines and low <= middle <= high:
            lines[-1].append(k)
            low, high = min(low, boxes[k, 1]), max(high, boxes[k, 3])
        else:
            lines.append([k])
            low, high = boxes[k, 1], boxes[k, 3]
    return [sorted(line, key=lambda k: boxes[k, 0]) for line in lines]


def anchored_rows(boxes: np.ndarray, tolerance: float) -> list[list[int]]:
    """Words by rows: one joins while its top is within `tolerance` of the row's first word's."""
    rows: list = []
    for k in np.lexsort((boxes[:, 0], boxes[:, 1])).tolist():
        if rows and boxes[k, 1] - boxes[rows[-1][0], 1] <= np.float32(tolerance):
            rows[-1].append(k)
        else:
            rows.append([k])
    return rows


SYMBOLS = set("$€£¥()-—–")
OPENERS = set("$€£¥(")


def number_like(s: str) -> bool:
    """Whether the detectors' grammar reads s as a number."""
    s = s.strip()
    if not s or any("a" <= c.lower() <= "z" for c in s):
        return False
    kept = "".join(c for c in s if c in "0123456789.-")
    try:
        return kept not in ("", "-", ".") and float(kept) is not None
    except ValueError:
        return False


def structure(boxes: np.ndarray, texts: list[str], row_tol: float = 3.0, col_gap: float = 6.0) -> tuple[list[list[str]], list[list[tuple]], int]:
    """A grid of texts and boxes and its number of header rows, from words alone."""
    if not len(boxes):
        return [], [], 0
    rows = anchored_rows(boxes, row_tol)
    bands = [(boxes[b, 0].min(), boxes[b, 2].max()) for b in split_at_gaps(boxes[:, 0], boxes[:, 2], col_gap)]
    lows, highs = (np.array(x, np.float32) for x in zip(*bands))

    def column(k: int) -> int:
        middle = (boxes[k, 0] + boxes[k, 2]) / np.float32(2)
        inside = np.nonzero((middle >= lows - np.float32(col_gap)) & (middle <= highs + np.float32(col_gap)))[0]
        return int(inside[0]) if len(inside) else int(np.argmin(np.minimum(abs(middle - lows), abs(middle - highs))))

    def spread(k: int) -> list[int]:
        middles = (lows + highs) / np.float32(2)
        return np.nonzero((boxes[k, 0] - 2 <= middles) & (middles <= boxes[k, 2] + 2))[0].tolist() or [column(k)]

    def fill(row: list[int], header: bool) -> list[list[int]]:
        cells: list = [[] for _ in bands]
        for k in sorted(row, key=lambda k: boxes[k, 0]):
            for c in spread(k) if header else [column(k)]:
                cells[c].append(k)
        return cells

    joined = lambda cell: " ".join(texts[k] for k in cell)
    plain = [fill(row, False) for row in rows]
    header = next((i for i, cells in enumerate(plain) if sum(number_like(joined(c)) for c in cells) >= 2), len(plain))
    if header >= len(plain):
        header = int(len(plain) > 1)
    members = [fill(row, True) if i < header else plain[i] for i, row in enumerate(rows)]
    grid = [[joined(c) for c in cells] for cells in members]
    around = lambda cell: (boxes[cell, 0].min(), boxes[cell, 1].min(), boxes[cell, 2].max(), boxes[cell, 3].max()) if cell else None
    areas = [[around(c) for c in cells] for cells in members]
    for c in range(len(bands)):  # a column of signs alone goes to the numbers they belong to
        seen = [t for t in (row[c].strip() for row in grid[header:]) if t]
        if not seen or not all(set(t) <= SYMBOLS for t in seen):
            continue
        to = c + 1 if seen[0][0] in OPENERS else c - 1
        if not 0 <= to < len(bands):
            continue
        for row, area in zip(grid, areas):
            if row[c]:
                row[to] = row[c] + row[to] if to > c else row[to] + row[c]
                both = [x for x in (area[to], area[c]) if x]
                area[to] = tuple(f(v) for f, v in zip((min, min, max, max), zip(*both)))
                row[c], area[c] = "", None
    kept = [c for c in range(len(bands)) if any(row[c].strip() for row in grid)]
    tops = [(boxes[r, 1].min(), boxes[r, 3].max()) for r in rows]
    full = [[area[c] or (lows[c], tops[i][0], highs[c], tops[i][1]) for c in kept] for i, area in enumerate(areas)]
    return [[row[c].strip() for c in kept] for row in grid], full, header


def ascii_page(boxes: np.ndarray, texts: list[str]) -> str:
    """The words as monospaced lines: columns by offset over the upper median of a character's width."""
    if not len(boxes):
        return ""
    wide = sorted((b[2] - b[0]) / len(t) for b, t in zip(boxes, texts) if t)
    step, left, out = max(wide[len(wide) // 2] if wide else 5.0, 1.0), boxes[:, 0].min(), []
    for row in anchored_rows(boxes, 3.0):
        line = ""
        for k in sorted(row, key=lambda k: boxes[k, 0]):
            at = max(0, int(np.floor((boxes[k, 0] - left) / step + 0.5)))
            line = line.ljust(at) if len(line) < at else line + " " * (line != "" and not line.endswith(" "))
            line += texts[k]
        out.append(line.rstrip())
    return "\n".join(out)


def reconstruct(region: tuple, boxes: np.ndarray, texts: list[str], cell_gap: float = 12.0, col_tol: float = 14.0) -> list[tuple]:
    """Cells (row, col, text, box) of a region by the naive model: mean-clustered rows, blocks by gap, anchored columns."""
    order = np.argsort(boxes[:, 1], kind="stable") if len(boxes) else np.zeros(0, int)
    heights = np.sort(np.maximum(boxes[:, 3] - boxes[:, 1], 0)) if len(boxes) else np.zeros(0)
    tolerance = max(heights[len(heights) // 2] if len(heights) else 0, 4.0) * 0.7
    rows: list = []
    for k in order.tolist():
        middle = (boxes[k, 1] + boxes[k, 3]) / 2
        if rows and abs(np.mean([(boxes[j, 1] + boxes[j, 3]) / 2 for j in rows[-1]]) - middle) <= tolerance:
            rows[-1].append(k)
        else:
            rows.append([k])
    blocks = []
    for row in rows:
        row = np.array(row)
        parts = split_at_gaps(boxes[row, 0], boxes[row, 2], cell_gap)
        blocks.append([(float(boxes[row[p], 0].min()), " ".join(texts[k] for k in row[p])) for p in parts])
    anchors: list = []
    for x in sorted(x for row in blocks for x, _ in row):
        if not anchors or x - anchors[-1] > col_tol:
            anchors.append(x)
    if not anchors:
        return []
    edges = [region[0], *((a + b) / 2 for a, b in zip(anchors, anchors[1:])), region[2]]
    cells: dict = {}
    for r, row in enumerate(blocks):
        for x, text in row:
            c = int(np.argmin([abs(x - a) for a in anchors]))
            cells[r, c] = f"{cells[r, c]} {text}" if (r, c) in cells else text
    extent = [(boxes[row, 1].min(), boxes[row, 3].max()) for row in rows]
    return [(r, c, text, (edges[c], extent[r][0], edges[c + 1], extent[r][1])) for (r, c), text in cells.items()]


# --- the same on frames: words have keys, ord, text and x0, y0, x1, y1 ---

_NUMBERS = ["x0", "y0", "x1", "y1"]
_EXTRA = ["rx0", "ry0", "rx1", "ry1"]


def _per_group(words: DataFrame, keys: list, run, schema: str) -> DataFrame:
    """run(boxes, texts, first row) -> rows, for each group of words in order of ord.

    Groups are small and many, so they are cut out of sorted batches by their borders instead of one call each.
    """
    types = dict(words.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]

    def groups(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        boxes, texts, rows = pdf[_NUMBERS].to_numpy(np.float32), pdf["text"].fillna("").tolist(), []
        columns = {c: pdf[c].tolist() for c in [*keys, *_EXTRA] if c in pdf}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = tuple(columns[k][a] for k in keys)
            rows += [key + tuple(r) for r in run(boxes[a:b], texts[a:b], {c: v[a] for c, v in columns.items()})]
        return pd.DataFrame(rows, columns=names)

    def stream(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(held):
                continue
            new = (held[keys] != held[keys].shift()).any(axis=1).to_numpy()
            cuts = np.nonzero(new)[0]
            if len(cuts) > 1:  # the last group may go on in the next batch
                yield groups(held, cuts)
                held = held.iloc[cuts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            new = (held[keys] != held[keys].shift()).any(axis=1).to_numpy()
            yield groups(held, np.append(np.nonzero(new)[0], len(held)))

    return words.repartition(*keys).sortWithinPartitions(*keys, "ord").mapInPandas(stream, f"{head}, {schema}")


def xy_cut(words: DataFrame, keys: list, x_gap: float = 12.0, y_gap: float = 8.0) -> DataFrame:
    def run(boxes, texts, _):
        for i, rows in enumerate(cut_page(boxes, x_gap, y_gap)):
            b = boxes[rows]
            yield (i, *map(float, (b[:, 0].min(), b[:, 1].min(), b[:, 2].max(), b[:, 3].max())))

    return _per_group(words, keys, run, "block int, x0 float, y0 float, x1 float, y1 float")


def document_text(words: DataFrame, keys: list, x_gap: float = 12.0, y_gap: float = 8.0) -> DataFrame:
    """keys and text: blocks in reading order, a blank line between them."""

    def run(boxes, texts, _):
        parts, middle = [], (boxes[:, :2] + boxes[:, 2:]) / 2
        for rows in cut_page(boxes, x_gap, y_gap):
            low, high = boxes[rows, :2].min(0), boxes[rows, 2:].max(0)
            inside = np.nonzero(((middle >= low) & (middle <= high)).all(1))[0]
            parts.append(" ".join(texts[inside[k]] for line in lines_of(boxes[inside]) for k in line))
        yield ("\n\n".join(parts),)

    return _per_group(words, keys, run, "text string")


def structure_words(words: DataFrame, keys: list, row_tol: float = 3.0, col_gap: float = 6.0) -> DataFrame:
    """keys, row, col, text, is_header and the cell's box."""

    def run(boxes, texts, _):
        grid, areas, header = structure(boxes, texts, row_tol, col_gap)
        for r, row in enumerate(grid):
            for c, text in enumerate(row):
                yield (r, c, text, r < header, *map(float, areas[r][c]))

    return _per_group(words, keys, run, "row int, col int, text string, is_header boolean, x0 float, y0 float, x1 float, y1 float")


def words_to_ascii(words: DataFrame, keys: list) -> DataFrame:
    return _per_group(words, keys, lambda boxes, texts, _: [(ascii_page(boxes, texts),)], "text string")


def reconstruct_tables(words: DataFrame, keys: list) -> DataFrame:
    """keys, row, col, ord, text, is_header and box; words also carry their region's rx0, ry0, rx1, ry1."""

    def run(boxes, texts, first):
        region = tuple(float(first[k]) for k in ("rx0", "ry0", "rx1", "ry1"))
        for i, (r, c, text, area) in enumerate(reconstruct(region, boxes, texts)):
            yield (r, c, i, text, r == 0, *map(float, area))

    return _per_group(words, keys, run, "row int, col int, ord int, text string, is_header boolean, x0 float, y0 float, x1 float, y1 float")


def grid_risk(cells: DataFrame, spans: DataFrame, figure_score=None) -> DataFrame:
    """Per table_id the risk markers: spread of cells a row, rows short of cells, missing cells, OCR confidence, rotation."""
    per_row = cells.groupBy("table_id", "row").agg(F.countDistinct("col").alias("n"))
    wide = cells.groupBy("table_id").agg((F.max("col") + 1).alias("n_cols"))
    rows = per_row.join(wide, "table_id").groupBy("table_id").agg(
        (F.var_pop("n") / F.avg("n")).cast("float").alias("column_count_variance"), F.sum((F.col("n") < F.col("n_cols")).cast("int")).alias("merged_cell_rows"),
        F.sum(F.col("n_cols") - F.col("n")).alias("empty_cells"),
    )
    marks = spans.groupBy("table_id").agg(F.min("confidence").alias("min_ocr_confidence"), F.bool_or("rotated").alias("rotated_text"))
    out = rows.join(marks, "table_id", "left").withColumn("figure_score", (figure_score if figure_score is not None else F.lit(0.0)).cast("float"))
    return out.select("table_id", F.struct("min_ocr_confidence", "column_count_variance", "merged_cell_rows", "empty_cells", "rotated_text", "figure_score").alias("risk"))


def placed_risk(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id and risk of grids that a parser placed itself: spread and gaps of the filled cells a row, of all n_rows rows."""
    line = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_rows"), F.lit(1)) - 1)).alias("row")
    full = cells.where(F.trim("text") != "").groupBy("table_id", "row").agg(F.count(F.lit(1)).alias("n"))
    rows = tables.select("table_id", "n_cols", line).join(full, ["table_id", "row"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = rows.groupBy("table_id").agg(
        F.when(F.avg("n") > 0, F.var_pop("n") / F.avg("n")).otherwise(0.0).cast("float").alias("column_count_variance"), F.sum((F.col("n") < F.col("n_cols")).cast("int")).alias("merged_cell_rows"),
        F.sum(F.greatest(F.col("n_cols") - F.col("n"), F.lit(0))).alias("empty_cells"),
    )
    one, none = F.lit(1.0).cast("float"), F.lit(0.0).cast("float")
    return out.select("table_id", F.struct(one.alias("min_ocr_confidence"), "column_count_variance", "merged_cell_rows", "empty_cells", F.lit(False).alias("rotated_text"), none.alias("figure_score")).alias("risk"))


def merge_regions(regions: DataFrame, keys: list) -> DataFrame:
    """keys, n and the box of side medians, for groups of at least two regions (bbox)."""
    return regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), G.median_agg(F.col("bbox")).alias("bbox")).where("n >= 2")


def figure_score(regions: DataFrame, rects: DataFrame) -> DataFrame:
    """regions with the share of their area under dark filled rects centred in them. rects: doc, page, box, lightness."""
    dark = rects.where("lightness < 0.55").select("doc", "page", F.col("box").alias("rect"))
    hit = regions.join(dark, ["doc", "page"], "left").withColumn("_a", F.when(G.contains_center(F.col("bbox"), F.col("rect")), G.overlap(F.col("bbox"), F.col("rect"))))
    keys = [c for c in regions.columns]
    return hit.groupBy(*keys).agg((F.coalesce(F.sum("_a"), F.lit(0.0)) / F.greatest(F.first(G.area(F.col("bbox"))), F.lit(1e-6))).alias("figure_score"))
