"""Text out of frames: Markdown, HTML, sections, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.numbers import trimmed
from spandrel.functions.text import escape_html, truncated


def in_order(order: Column | str, value: Column | str, glue: str) -> Column:
    """Aggregate: a group's values in order, joined."""
    order = F.col(order) if isinstance(order, str) else order
    value = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s.v), glue)


def reading_order(spans: DataFrame, keys: list) -> DataFrame:
    return spans.groupBy(*keys).agg(in_order("ord", "text", " ").alias("text"))


def table_markdown(grid: DataFrame) -> DataFrame:
    """table_id and markdown of a dense grid: pipes escaped, a rule after the first row."""
    cell = F.replace(F.col("text"), F.lit("|"), F.lit("\\|"))
    rows = grid.groupBy("table_id", "row").agg(F.concat(F.lit("| "), in_order("col", cell, " | "), F.lit(" |")).alias("line"), F.max("col").alias("last"))
    line = F.when(F.col("row") == 0, F.concat("line", F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("last") + 1))).otherwise(F.col("line"))
    return rows.groupBy("table_id").agg(in_order("row", line, "\n").alias("markdown"))


def markdown_cells(tables: DataFrame) -> DataFrame:
    """table_id, row, col and text from markdown: lines that begin with a pipe; rows of dashes and colons alone go."""
    lines = tables.select("table_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line")).withColumn("line", trimmed(F.col("line"))).where(F.col("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), trimmed)
    rows = lines.select("table_id", "line_no", cells.alias("cells")).where(~F.forall("cells", lambda c: c.rlike("^[-:]+$")))
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy("table_id").orderBy("line_no")) - 1)
    return numbered.select("table_id", "row", F.posexplode("cells").alias("col", "text"))


def table_html(grid: DataFrame, header_rows: str = "header_rows", newline: bool = False) -> DataFrame:
    """table_id and html of a dense grid whose rows carry their table's number of header rows."""
    tag = F.when(F.col("row") < F.col(header_rows), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    rows = grid.groupBy("table_id", "row").agg(F.concat(F.lit("<tr>"), in_order("col", cell, ""), F.lit("</tr>")).alias("line"))
    body = in_order("row", "line", "\n" if newline else "")
    return rows.groupBy("table_id").agg(F.concat(F.lit("<table>\n" if newline else "<table>"), body, F.lit("\n</table>\n" if newline else "</table>")).alias("html"))


def header_spans(grid: DataFrame) -> DataFrame:
    """table_id, row, col, text and colspan of header cells: runs of equal filled neighbours are one."""
    order = Window.partitionBy("table_id", "row").orderBy("col")
    new = (F.col("text") == "") | F.lag("text").over(order).isNull() | (F.lag("text").over(order) != F.col("text"))
    runs = grid.where("row < header_rows").withColumn("_run", F.sum(new.cast("int")).over(order))
    return runs.groupBy("table_id", "row", "_run").agg(F.min("col").alias("col"), F.first("text").alias("text"), F.count(F.lit(1)).alias("colspan")).drop("_run")


def sections(elements: DataFrame, keys: list) -> DataFrame:
    """elements with section (0 before any heading) and heading: parts of a document from one title or heading to the next."""
    order = Window.partitionBy(*keys).orderBy("ord")
    is_head = F.col("role").isin("Title", "Heading")
    out = elements.withColumn("section", F.sum(is_head.cast("int")).over(order))
    return out.withColumn("heading", F.first(F.when(is_head, F.col("text")), ignorenulls=True).over(Window.partitionBy(*keys, "section")))


def document_markdown(elements: DataFrame, keys: list) -> DataFrame:
    """keys and markdown: marks by role; text found in figures comes last, page by page."""
    mark = F.when(F.col("role") == "Title", F.concat(F.lit("# "), "text")).when(F.col("role") == "Heading", F.concat(F.lit("## "), "text")).when(F.col("role") == "ListItem", F.concat(F.lit("- "), "text"))
    mark = mark.when(F.col("role") == "Caption", F.concat(F.lit("*"), "text", F.lit("*"))).otherwise(F.col("text"))
    figure = F.col("role") == "Figure"
    order = Window.partitionBy(*keys, figure).orderBy("ord")
    page_mark = F.when(figure & (F.lag("page").over(order).isNull() | (F.lag("page").over(order) != F.col("page"))), F.concat(F.lit("### Page "), F.col("page").cast("string"), F.lit("\n\n"))).otherwise("")
    lines = elements.withColumn("_line", F.concat(page_mark, mark))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~figure, F.struct("ord", "_line")))), lambda s: s._line), "\n\n")
    found = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(figure, F.struct("ord", "_line")))), lambda s: s._line), "\n\n")
    out = lines.groupBy(*keys).agg(body.alias("_b"), found.alias("_f"))
    return out.select(*keys, F.when(F.col("_f") != "", F.concat("_b", F.lit("\n\n## Text in figures\n\n"), "_f")).otherwise(F.col("_b")).alias("markdown"))


def previews(artifacts: DataFrame, width: int = 60) -> DataFrame:
    """artifacts with a one-line preview by kind. Optional columns: n_rows, n_cols, label, text, n_elements."""
    have = lambda c: F.col(c) if c in artifacts.columns else F.lit(None)
    text = truncated(F.regexp_replace(F.coalesce(have("text").cast("string"), F.lit("")), r"\s+", " "), width)
    line = F.when(F.col("kind").isin("HtmlTable", "DbTable"), F.format_string("%d x %d", have("n_rows").cast("int"), have("n_cols").cast("int")))
    line = line.when(F.col("kind") == "Region", have("label").cast("string")).when(F.col("kind") == "Document", F.format_string("%d elements", have("n_elements").cast("int")))
    return artifacts.withColumn("preview", F.coalesce(line.otherwise(text), F.lit("")))


def summary(elements: DataFrame, keys: list) -> DataFrame:
    """keys and summary: counts, headings, and the start of the first paragraph."""
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isin("Title", "Heading"), F.struct("ord", "text")))), lambda s: s.text), "; ")
    first = F.min(F.when(F.col("role") == "Paragraph", F.struct("ord", "text")))
    out = elements.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), head.alias("h"), first.alias("p"))
    return out.select(*keys, F.concat_ws("\n", F.format_string("%d elements", "n"), F.nullif("h", F.lit("")), F.left(F.col("p.text"), F.lit(180))).alias("summary"))


def ddl(df: DataFrame, name: str) -> str:
    kinds = {"bigint": "BIGINT", "int": "BIGINT", "double": "DOUBLE", "float": "DOUBLE"}
    return f"CREATE TABLE {name}(" + ", ".join(f'"{c}" {kinds.get(t, "VARCHAR")}' for c, t in df.dtypes) + ")"
