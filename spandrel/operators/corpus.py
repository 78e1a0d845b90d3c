"""Work over a whole corpus of documents: sampling, ordering, summaries, and tables nobody has parsed yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.operators.layout import lag_clusters


def even_pages(docs: DataFrame, k: int, key: str = "doc", pages: str = "n_pages") -> DataFrame:
    """key and page: k pages spread evenly over each document, all of them where there are no more (or k is 0)."""
    n = F.col(pages)
    some = F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda i: (F.bround(i * (n - 1) / max(k - 1, 1)) + 1).cast("int"))
    every = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return docs.select(key, F.explode(F.array_distinct(F.when((n <= k) | F.lit(k <= 0), every).otherwise(some))).alias("page"))


def top_per_group(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def smallest_first(docs: DataFrame, size: str, *ties: str) -> DataFrame:
    return docs.orderBy(size, *ties)


def layout_order(elements: DataFrame, keys: list) -> DataFrame:
    """elements with ord: by tenths of the height (rounded half to even), then from the left."""
    return elements.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(F.bround(F.col("bbox.y0") / 10), "bbox.x0")) - 1)


def table_pages(pages: DataFrame, tables: DataFrame, n: int) -> DataFrame:
    """Each document's first n pages that hold a table."""
    return top_per_group(pages.join(tables.select("doc", "page").distinct(), ["doc", "page"], "left_semi"), ["doc"], ["page"], n)


def corpus_tables(tables: DataFrame, per_doc: int, total: int) -> DataFrame:
    """Tables of 3 to 12 rows and 2 to 8 columns, at most so many a document and in all (in order of document and table)."""
    fit = tables.where("n_rows BETWEEN 3 AND 12 AND n_cols BETWEEN 2 AND 8")
    return top_per_group(fit, ["doc"], ["table_id"], per_doc).orderBy("doc", "table_id").limit(total)


def stage_totals(timings: DataFrame) -> DataFrame:
    """doc, stage, ms and share over timings (doc, stage, ms), with subtotals by document and by stage and the grand total."""
    out = timings.groupingSets([["doc", "stage"], ["doc"], ["stage"], []], "doc", "stage").agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    whole = timings.agg(F.sum("ms").alias("_all"))  # one row
    return out.join(F.broadcast(whole), how="left", on=F.lit(True)).withColumn("share", F.col("ms") / F.nullif(F.col("_all"), F.lit(0))).drop("_all")


def page_status(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each page's status from its tables (doc, page, figure, impression): missing, figure, suspect, confirmed or ok."""
    per = evidence.groupBy("doc", "page").agg(F.bool_or("figure").alias("f"), F.bool_or(F.col("impression") == "Suspect").alias("s"), F.bool_or(F.col("impression") == "Confirmed").alias("c"))
    status = F.when(F.col("f").isNull(), "missing").when(F.col("f"), "figure").when(F.col("s"), "suspect").when(F.col("c"), "confirmed").otherwise("ok")
    return pages.select("doc", "page").distinct().join(per, ["doc", "page"], "left").select("doc", "page", status.alias("status"))


def cheapest_first(pages: DataFrame, cost: str) -> DataFrame:
    """pages with start and done: when each would run if the cheapest of a document go first."""
    order = Window.partitionBy("doc").orderBy(cost, "page")
    done = F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("done", done).withColumn("start", F.col("done") - F.col(cost))


def likely_tables(regions: DataFrame, words: DataFrame) -> DataFrame:
    """Text-aligned regions (n_cols, n_rows) with 2 columns, 3 rows and 8 % numbers; ruled ones that none of these covers by half."""
    inside = regions.where("source = 'text'").join(words.select("doc", "page", F.col("bbox").alias("w"), "text"), ["doc", "page"]).where(G.contains_center(F.col("bbox"), F.col("w")))
    share = inside.groupBy("region_id").agg(F.avg(F.col("text").rlike(r"^[($€£-]*[0-9][0-9,.]*[)%]*$").cast("double")).alias("numeric"))
    kept = regions.where("source = 'text' AND n_cols >= 2 AND n_rows >= 3").join(share.where("numeric >= 0.08"), "region_id", "left_semi")
    over = kept.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), F.col("bbox").alias("_b"))
    near = (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")) & (G.iou(F.col("bbox"), F.col("_b")) > F.lit(0.5).cast("float"))
    return kept.unionByName(regions.where("source = 'lines'").join(over, near, "left_anti"))


def snapped(regions: DataFrame, words: DataFrame, halo: float = 55.0) -> DataFrame:
    """regions with bbox widened to the words of its rows that are centred within `halo` of its sides."""
    x, y = G.center(F.col("w"))
    near = y.between(F.col("bbox.y0") - 2, F.col("bbox.y1") + 2) & x.between(F.col("bbox.x0") - halo, F.col("bbox.x1") + halo)
    hit = regions.select("region_id", "doc", "page", "bbox").join(words.select("doc", "page", F.col("bbox").alias("w")), ["doc", "page"]).where(near)
    wide = hit.groupBy("region_id").agg(G.union_agg(F.col("w")).alias("_w"))
    out = regions.join(wide, "region_id", "left")
    return out.withColumn("bbox", F.when(F.col("_w").isNull(), F.col("bbox")).otherwise(G.union(F.col("bbox"), F.col("_w")))).drop("_w")


def coverage_gaps(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """doc, page, cluster, n and box of table-like groups of words in no region: dense in numbers, in columns and rows."""
    from spandrel.operators.regions import orphans

    out = orphans(spans, regions).withColumns({"y0": F.col("bbox.y0"), "x0": F.col("bbox.x0")})
    page = Window.partitionBy("doc", "page")
    out = lag_clusters(out.withColumn("_n", F.count(F.lit(1)).over(page)).where("_n >= 25"), ["doc", "page"], "y0", 40)
    keys = ["doc", "page", "cluster"]
    per = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("text").rlike("[0-9]").cast("double")).alias("numeric"), G.union_agg(F.col("bbox")).alias("bbox")).where("n >= 20 AND numeric >= 0.2")
    starts = lag_clusters(out.withColumnRenamed("cluster", "_c").select("doc", "page", "_c", "x0"), ["doc", "page", "_c"], "x0", 8)
    columns = starts.groupBy("doc", "page", "_c", "cluster").agg(F.count(F.lit(1)).alias("k")).where("k >= 3").groupBy("doc", "page", F.col("_c").alias("c")).agg(F.count(F.lit(1)).alias("columns"))
    middles = out.select("doc", "page", F.col("cluster").alias("_c"), F.bround(G.center(F.col("bbox"))[1].cast("double")).alias("m")).distinct()
    rows = lag_clusters(middles, ["doc", "page", "_c"], "m", 6).groupBy("doc", "page", F.col("_c").alias("c")).agg((F.max("cluster") + 1).alias("rows"))
    found = per.withColumnRenamed("cluster", "c").join(columns.where("columns >= 3"), ["doc", "page", "c"]).join(rows.where("rows >= 3"), ["doc", "page", "c"])
    return found.select("doc", "page", F.col("c").alias("cluster"), "n", "columns", "rows", "bbox")


def number_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per table: numbers in a and in b (as digits), how many differ, and a neutral hint. Both: table_id, text."""
    token = F.explode(F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\(?[0-9][0-9,]*\)?"), F.lit(0)), lambda t: F.regexp_replace(t, "[^0-9]", "")), lambda t: t != ""))
    count = lambda df, n: df.select("table_id", token.alias("t")).groupBy("table_id", "t").agg(F.count(F.lit(1)).alias(n))
    both = count(a, "n").join(count(b, "m"), ["table_id", "t"], "full").fillna(0, ["n", "m"])
    out = both.groupBy("table_id").agg(F.sum("n").alias("n_a"), F.sum("m").alias("n_b"), F.sum(F.abs(F.col("n") - F.col("m"))).alias("differ"))
    hint = F.when(F.col("differ") == 0, "all numbers agree").when(F.col("n_a") * 2 < F.col("n_b"), "far fewer numbers here than there").otherwise(F.format_string("%d number(s) differ", "differ"))
    return out.withColumn("hint", hint)
