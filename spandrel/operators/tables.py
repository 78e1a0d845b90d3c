"""Tables in long form: dense grids, column types, row kinds, reconciliation of totals.

A tables frame has table_id, n_rows and n_cols; a cells frame table_id, row, col, ord, text and is_header. Everything is
grouped by table_id, dealt once; the windows and groups of the later steps reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.numbers import is_placeholder, parse_num, trimmed
from spandrel.functions.text import is_total_label, is_year

REL_TOL, ABS_TOL = 0.01, 0.06


def dense_grid(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for every (row, col) of each table; missing cells are '', the last of doubled cells counts."""
    last = cells.groupBy("table_id", "row", "col").agg(F.max_by("text", "ord").alias("text"))
    span = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    frame = tables.select("table_id", "n_rows", "n_cols").withColumn("row", F.explode(span("n_rows"))).withColumn("col", F.explode(span("n_cols")))
    return frame.join(last, ["table_id", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def cell_at(cells: DataFrame) -> DataFrame:
    """The first of doubled cells at each place (dense_grid takes the last)."""
    return cells.groupBy("table_id", "row", "col").agg(F.min_by("text", "ord").alias("text"))


def header_rows(tables: DataFrame, cells: DataFrame, fallback: bool = True) -> DataFrame:
    """table_id and header_rows: leading rows that hold a header cell; 1 if none is marked and there are more rows."""
    marked = cells.where("is_header").groupBy("table_id").agg(F.array_sort(F.collect_set("row")).alias("marked"))
    run = F.coalesce(F.size(F.filter("marked", lambda x, i: x == i)), F.lit(0))
    run = F.when(F.size("marked") > 0, run).otherwise(0)
    out = tables.join(marked, "table_id", "left").withColumn("header_rows", F.least(run, F.col("n_rows")).cast("int"))
    if fallback:
        out = out.withColumn("header_rows", F.when((F.col("header_rows") == 0) & (F.col("n_rows") > 1), 1).otherwise(F.col("header_rows")))
    return out.select("table_id", "header_rows")


def _placed(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """The dense grid with header_rows: places and cells are dealt by table once and meet in one group, without a join."""
    span = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    places = tables.select("table_id", F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"), F.explode(span("n_rows")).alias("row")).withColumn("col", F.explode(span("n_cols")))
    ord_type = cells.schema["ord"].dataType
    places = places.select("table_id", "row", "col", "n_rows", "n_cols", F.lit(None).cast(ord_type).alias("ord"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("is_header"))
    none = F.lit(None).cast("int")
    filled = cells.select("table_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), none.alias("n_rows"), none.alias("n_cols"), "ord", "text", "is_header")
    grid = places.unionByName(filled).repartition("table_id").groupBy("table_id", "row", "col").agg(
        F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), F.coalesce(F.max_by("text", "ord"), F.lit("")).alias("text"), F.bool_or("is_header").alias("_head")
    )
    # leading rows that hold a header cell, also one beside the grid; 1 if none is marked and there are more rows
    marked = F.max("_head").over(Window.partitionBy("table_id", "row"))
    table = Window.partitionBy("table_id")
    inside = grid.withColumn("_marked", marked).where("n_rows IS NOT NULL")
    run = F.coalesce(F.min(F.when(~F.coalesce("_marked", F.lit(False)), F.col("row"))).over(table), F.col("n_rows"))
    inside = inside.withColumn("header_rows", run.cast("int"))
    inside = inside.withColumn("header_rows", F.when((F.col("header_rows") == 0) & (F.col("n_rows") > 1), 1).otherwise(F.col("header_rows")))
    return inside.select("table_id", "row", "col", "n_rows", "n_cols", "text", "header_rows")


def model(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """The dense grid with header_rows, col_type (Label, Numeric, Ratio, Empty) and row_kind (Header, Section, Data, Total)."""
    grid = _placed(tables, cells)
    t = trimmed(F.col("text"))
    grid = grid.withColumns({"t": t, "num": parse_num(F.col("text"))})
    body = F.col("row") >= F.col("header_rows")
    column = Window.partitionBy("table_id", "col")
    count = lambda test: F.sum(F.when(body & test, 1).otherwise(0)).over(column)
    full, ratio = F.col("t") != "", F.col("t").endswith("%")
    grid = grid.withColumns({"_full": count(full), "_ratio": count(full & ratio), "_num": count(full & ~ratio & F.col("num").isNotNull())})
    kind = F.when(F.col("_full") == 0, "Empty").when(F.col("_ratio") * 2 > F.col("_full"), "Ratio").when(F.col("_num") * 2 >= F.col("_full"), "Numeric").otherwise("Label")
    line = Window.partitionBy("table_id", "row")
    grid = grid.withColumn("col_type", kind).withColumns({
        "_filled": F.sum(F.when((F.col("col_type") == "Numeric") & full, 1).otherwise(0)).over(line),
        "label": F.max(F.when(F.col("col") == 0, F.col("text"))).over(line),
    })
    row_kind = F.when(~body, "Header").when(is_total_label(F.col("label")) & (F.col("_filled") > 0), "Total").when((F.col("_filled") == 0) & (trimmed(F.col("label")) != ""), "Section").otherwise("Data")
    return grid.withColumn("row_kind", row_kind).drop("_full", "_ratio", "_num", "_filled")


def column_types(grid: DataFrame) -> DataFrame:
    return grid.groupBy("table_id", "col").agg(F.first("col_type").alias("col_type"))


def row_kinds(grid: DataFrame) -> DataFrame:
    return grid.groupBy("table_id", "row").agg(F.first("row_kind").alias("row_kind"))


def reconcile(grid: DataFrame, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL) -> DataFrame:
    """table_id, row (of the total), label, col, total, sum and ok: each total against the data rows since the one before."""
    numeric = grid.where("col_type = 'Numeric' AND row_kind IN ('Data', 'Total')")
    before = Window.partitionBy("table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    is_total = F.col("row_kind") == "Total"
    blocks = numeric.withColumn("block", F.coalesce(F.sum(is_total.cast("int")).over(before), F.lit(0)))
    usable = is_total & ~F.col("t").endswith("%")
    sums = blocks.groupBy("table_id", "col", "block").agg(
        F.max(F.when(usable, F.col("num"))).alias("total"), F.max(F.when(is_total, F.col("row"))).alias("row"),
        F.max(F.when(is_total, F.col("label"))).alias("label"), F.sum(F.when(~is_total, F.col("num"))).alias("sum"),
    )
    off = F.abs(F.col("sum") - F.col("total"))
    sums = sums.where("total IS NOT NULL AND sum IS NOT NULL").withColumn("ok", (off <= abs_tol) | (off / F.greatest(F.abs("total"), F.lit(1.0)) <= rel_tol))
    return sums.select("table_id", "row", "label", "col", "total", "sum", "ok")


def total_rows(recon: DataFrame) -> DataFrame:
    """One row per total row: all_ok, any_ok, any_fail and broadly_fails (no column reconciles)."""
    out = recon.groupBy("table_id", "row").agg(F.bool_and("ok").alias("all_ok"), F.bool_or("ok").alias("any_ok"), F.count(F.lit(1)).alias("n_cols"))
    return out.withColumns({"any_fail": ~F.col("all_ok"), "broadly_fails": ~F.col("any_ok")})


def type_violations(grid: DataFrame) -> DataFrame:
    """Cells of numeric columns that are no numbers: neither empty, placeholders, percentages nor in section rows."""
    stray = (F.col("t") != "") & ~is_placeholder(F.col("t")) & F.col("num").isNull() & ~F.col("t").endswith("%")
    return grid.where("col_type = 'Numeric' AND row >= header_rows AND row_kind <> 'Section'").where(stray).select("table_id", "row", "col", F.col("t").alias("text"))


def header_missing(grid: DataFrame) -> DataFrame:
    """table_id and header_missing: at least half of the numeric columns have a number other than a year as their header."""
    data_like = F.col("num").isNotNull() & ~is_year(F.col("t"))
    at = grid.where("col_type = 'Numeric' AND header_rows > 0 AND row = header_rows - 1")
    found = at.groupBy("table_id").agg((F.sum(data_like.cast("int")) * 2 >= F.count(F.lit(1))).alias("header_missing"))
    return grid.select("table_id").distinct().join(found, "table_id", "left").withColumn("header_missing", F.coalesce("header_missing", F.lit(False)))


def completeness(grid: DataFrame) -> DataFrame:
    """Per table: n_numeric columns, n_data rows, empty_data cells and ragged (rows filled in part)."""
    rows = grid.where("col_type = 'Numeric' AND row_kind = 'Data'").groupBy("table_id", "row").agg(F.sum((F.col("t") != "").cast("int")).alias("filled"), F.count(F.lit(1)).alias("wide"))
    return rows.groupBy("table_id").agg(
        F.max("wide").alias("n_numeric"), F.count(F.lit(1)).alias("n_data"), F.sum(F.col("wide") - F.col("filled")).alias("empty_data"),
        F.bool_or((F.col("filled") > 0) & (F.col("filled") < F.col("wide"))).alias("ragged"),
    )


def diff_grids(got: DataFrame, want: DataFrame, norm) -> DataFrame:
    """Cells whose normal forms differ between two dense grids; a cell missing on one side counts as ''."""
    g, w = got.select("table_id", "row", "col", F.col("text").alias("got")), want.select("table_id", "row", "col", F.col("text").alias("want"))
    both = g.join(w, ["table_id", "row", "col"], "full").withColumns({"got": F.coalesce("got", F.lit("")), "want": F.coalesce("want", F.lit(""))})
    return both.where(norm(F.col("got")) != norm(F.col("want")))
