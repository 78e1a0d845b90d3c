"""Results handed on: Arrow, pandas, DuckDB, CSV, a one-page HTML report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.text import escape_html
from spandrel.operators.render import in_order


def to_arrow(df: DataFrame):
    return df.toArrow()


def to_duckdb(df: DataFrame, connection, table: str):
    """Create or replace a DuckDB table of one frame's rows (one table's worth)."""
    connection.register("_spandrel", df.toArrow())
    connection.sql(f'CREATE OR REPLACE TABLE "{table}" AS SELECT * FROM _spandrel')
    connection.unregister("_spandrel")
    return connection


def worst_first_csv(scores: DataFrame, path: str, by: str = "error") -> None:
    scores.orderBy(F.desc_nulls_last(by)).write.mode("overwrite").option("header", True).csv(path)


def report_html(tables: DataFrame, evidence: DataFrame, most_rows: int = 50) -> DataFrame:
    """doc and html: a document's tables with their impressions. tables: doc, table_id, row, col, text (dense grid)."""
    cell = F.concat(F.lit("<td>"), escape_html(F.col("text")), F.lit("</td>"))
    lines = tables.where(F.col("row") < most_rows).groupBy("doc", "table_id", "row").agg(F.concat(F.lit("<tr>"), in_order("col", cell, ""), F.lit("</tr>")).alias("line"))
    bodies = lines.groupBy("doc", "table_id").agg(in_order("row", "line", "").alias("body")).join(evidence.select("table_id", "impression"), "table_id", "left")
    part = F.concat(F.lit("<h2>"), escape_html(F.col("table_id").cast("string")), F.lit(": "), F.coalesce("impression", F.lit("?")), F.lit("</h2><table>"), F.col("body"), F.lit("</table>"))
    return bodies.groupBy("doc").agg(F.concat(F.lit("<!doctype html><meta charset=utf-8><title>Tables</title>"), in_order("table_id", part, "")).alias("html"))


def evidence_json(tables: DataFrame, evidence: DataFrame, grid: DataFrame) -> DataFrame:
    """table_id and json: what `explain` says of a table. evidence: table_id, impression, signals; grid: the table model."""
    kinds = grid.groupBy("table_id").agg(F.max("header_rows").alias("header_rows"), F.array_sort(F.collect_set(F.struct("col", F.lower("col_type").alias("t")))).alias("_k"))
    name = F.when(F.col("impression") == "NoIssues", "no_issues").otherwise(F.lower("impression"))
    out = tables.join(kinds, "table_id", "left").join(evidence.select("table_id", "impression", "signals"), "table_id")
    body = F.struct(
        F.col("table_id").cast("string").alias("id"), F.col("n_rows").alias("rows"), F.col("n_cols").alias("cols"), F.coalesce("header_rows", F.lit(0)).alias("header_rows"),
        F.coalesce(F.transform("_k", lambda k: k.t), F.array().cast("array<string>")).alias("col_types"), name.alias("impression"), "signals",
    )
    return out.select("table_id", F.to_json(body).alias("json"))


def judged_json(outcomes: DataFrame) -> DataFrame:
    """table_id and json: the flags that `judge` raised on each row it was given."""
    flag = F.when(F.col("flagged"), F.struct(F.col("check_id").alias("check"), "severity", "reason"))
    per = outcomes.groupBy("table_id").agg(F.bool_or("flagged").alias("flagged"), F.array_sort(F.collect_list(flag)).alias("signals"))
    return per.select("table_id", F.to_json(F.struct(F.col("table_id").cast("string").alias("id"), "flagged", "signals")).alias("json"))


def table_files(html: DataFrame, path: str) -> None:
    """Write each table's HTML (table_id, html) as a text file below path/table_id=<id>/."""
    html.select("table_id", F.col("html").alias("value")).write.mode("overwrite").partitionBy("table_id").text(path)


def prose_html(elements: DataFrame, keys: list) -> DataFrame:
    """keys and html: a document's prose by role, text of figures marked."""
    tag = F.when(F.col("role") == "Title", "h1").when(F.col("role") == "Heading", "h2").when(F.col("role") == "ListItem", "li").when(F.col("role") == "Caption", "figcaption").when(F.col("role") == "Figure", "aside").otherwise("p")
    line = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    return elements.groupBy(*keys).agg(in_order("ord", line, "\n").alias("html"))
