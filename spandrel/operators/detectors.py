"""Detectors that decide whether a parsed table is believable, and the verdict on their outcomes.

An outcomes frame has table_id, check_id, flagged, severity (Info, Warn, Error or null), confidence and reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.functions.text import claim_norm, contents_agree, diff_norm, residual_tokens
from spandrel.operators import tables as T

OUTCOME = ["table_id", "check_id", "flagged", "severity", "confidence", "reason"]


def _outcome(df: DataFrame, check: str, flagged, severity, confidence, reason) -> DataFrame:
    sure = F.when(~flagged, confidence).cast("double")
    return df.select("table_id", F.lit(check).alias("check_id"), flagged.alias("flagged"), F.when(flagged, severity).alias("severity"), sure.alias("confidence"), F.when(flagged, reason).alias("reason"))


def arithmetic(tables: DataFrame, grid: DataFrame) -> DataFrame:
    """Error if some total reconciles in none of its columns; .97 if totals reconcile, .60 if there are none."""
    recon = T.reconcile(grid)
    rows = T.total_rows(recon)
    bad = recon.join(rows.where("broadly_fails").select("table_id", "row"), ["table_id", "row"]).where("NOT ok")
    text = F.format_string("'%s' col %d: rows sum to %.2f, total says %.2f", F.trim("label"), "col", "sum", "total")
    why = bad.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", text.alias("x")))), lambda s: s.x), "; ").alias("why"))
    per = rows.groupBy("table_id").agg(F.bool_or("broadly_fails").alias("fails"))
    out = tables.select("table_id").join(per, "table_id", "left").join(why, "table_id", "left")
    flagged = F.coalesce("fails", F.lit(False))
    return _outcome(out, "intrinsic_arithmetic", flagged, F.lit("Error"), F.when(F.col("fails").isNull(), 0.60).otherwise(0.97), F.concat(F.lit("totals do not reconcile: "), F.col("why")))


def structure(tables: DataFrame, grid: DataFrame) -> DataFrame:
    """Stray text or empty cells are errors, rotation and middling OCR confidence warnings; tables may carry a risk struct."""
    stray = T.type_violations(grid).groupBy("table_id").agg(F.count(F.lit(1)).alias("n_stray"), F.min(F.struct("col", "row", "text")).alias("first"))
    out = tables.join(stray, "table_id", "left").join(T.completeness(grid), "table_id", "left")
    if "risk" not in tables.columns:
        out = out.withColumn("risk", F.struct(F.lit(0.0).alias("min_ocr_confidence"), F.lit(False).alias("rotated_text")))
    ocr, rotated = F.coalesce("risk.min_ocr_confidence", F.lit(0.0)), F.coalesce("risk.rotated_text", F.lit(False))
    low = (ocr > 0) & (ocr < 0.85)
    empty = F.coalesce("empty_data", F.lit(0)) > 0
    hard = F.col("n_stray").isNotNull() | empty | (low & (ocr < 0.6))
    reasons = F.array(
        F.when(F.col("n_stray").isNotNull(), F.format_string("%d non-numeric cell(s) in numeric column(s), first [%d,%d] '%s'", "n_stray", "first.row", "first.col", "first.text")),
        F.when(empty, F.format_string("%d empty cell(s) in data rows", "empty_data")), F.when(F.col("ragged"), F.lit("ragged numeric cells across data rows")),
        F.when(low, F.format_string("low OCR confidence %.2f", ocr.cast("double"))), F.when(rotated, F.lit("rotated text in region")),
    )
    why = F.array_join(F.filter(reasons, lambda x: x.isNotNull()), "; ")
    return _outcome(out, "structural_validity", hard | low | rotated, F.when(hard, "Error").otherwise("Warn"), F.lit(0.90), why)


def token_residual(sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per table_id: n_source tokens, dropped and spurious counts of the multiset difference. Both: table_id, text."""
    count = lambda df, n: df.select("table_id", F.explode(residual_tokens(F.col("text"))).alias("token")).groupBy("table_id", "token").agg(F.count(F.lit(1)).alias(n))
    both = count(sources, "n").join(count(parsed, "m"), ["table_id", "token"], "full").fillna(0, ["n", "m"])
    # examples: the first four of either kind, found by rank so that no group is gathered whole
    kind = F.when(F.col("n") > F.col("m"), 1).when(F.col("m") > F.col("n"), 2)
    both = both.withColumn("_k", kind).withColumn("_r", F.row_number().over(Window.partitionBy("table_id", "_k").orderBy("token")))
    some = lambda test: F.array_sort(F.collect_list(F.when(test & (F.col("_r") <= 4), F.col("token"))))
    return both.groupBy("table_id").agg(
        F.sum("n").alias("n_source"), F.sum(F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("dropped"), F.sum(F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("spurious"),
        some(F.col("n") > F.col("m")).alias("dropped_tokens"), some(F.col("m") > F.col("n")).alias("spurious_tokens"),
    )


def residual(tables: DataFrame, cells: DataFrame, spans: DataFrame, most: float = 0.15) -> DataFrame:
    """Source words in the table's region against its cells' words. tables: doc, page, bbox; cells: bbox; spans: doc, page, bbox, text."""
    real = cells.where(G.area(F.col("bbox")) > 0).groupBy("table_id").agg(G.union_agg(F.col("bbox")).alias("cells_box"))
    region = tables.join(real, "table_id", "left").withColumn("region", F.when(G.area(F.col("bbox")) > 1, F.col("bbox")).otherwise(F.col("cells_box")))
    words = spans.select("doc", "page", F.col("bbox").alias("span"), "text")
    inside = region.select("table_id", "doc", "page", "region").join(words, ["doc", "page"]).where(G.contains_center(F.col("region"), F.col("span")))
    found = token_residual(inside.select("table_id", "text"), cells.select("table_id", "text"))
    out = tables.select("table_id").join(found, "table_id", "left")
    known = (F.coalesce("n_source", F.lit(0)) > 0)
    share = F.when(known, ((F.col("dropped") + F.col("spurious")) / F.greatest("n_source", F.lit(1))).cast("float"))
    flagged = F.coalesce(share > F.lit(most).cast("float"), F.lit(False))
    why = F.format_string("reconstruction residual %.0f%%: %d source word(s) absent from the parse %s; %d parsed token(s) absent from the source %s", (share * 100).cast("double"), "dropped", F.to_json("dropped_tokens"), "spurious", F.to_json("spurious_tokens"))
    return _outcome(out, "reconstruction_error", flagged, F.when(share > F.lit(0.30).cast("float"), "Error").otherwise("Warn"), F.when(known, F.greatest(1 - share, F.lit(0.0))).otherwise(0.5), why)


def cross_tier(tables: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Each boxed cell of one parse against the best-overlapping cell of another. Both: table_id, row, col, ord, text, bbox."""
    boxed = lambda df: df.where((G.area(F.col("bbox")) > 0) & (F.trim("text") != ""))
    left = boxed(a).select("table_id", F.struct("row", "col", "ord").alias("cell"), "text", "bbox")
    right = boxed(b).select("table_id", F.col("ord").alias("other"), F.col("text").alias("text_b"), F.col("bbox").alias("bbox_b"))
    pairs = left.join(right, "table_id").withColumn("iou", G.iou(F.col("bbox"), F.col("bbox_b"))).where(F.col("iou") > F.lit(0.1).cast("float"))
    best = pairs.groupBy("table_id", "cell").agg(F.first("text").alias("text"), F.max_by("text_b", F.struct("iou", "other")).alias("text_b"))
    judged = best.withColumn("off", ~contents_agree(F.col("text"), F.col("text_b")))
    judged = judged.withColumn("_r", F.row_number().over(Window.partitionBy("table_id", "off").orderBy("text", "text_b")))
    shown = F.when(F.col("off") & (F.col("_r") <= 3), F.struct("text", "text_b"))
    stats = judged.groupBy("table_id").agg(F.count(F.lit(1)).alias("matched"), F.sum(F.col("off").cast("int")).alias("n_off"), F.array_sort(F.collect_list(shown)).alias("offs"))
    n = left.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_boxed"))
    out = tables.select("table_id").join(n, "table_id", "left").join(stats, "table_id", "left")
    known = (F.coalesce("n_boxed", F.lit(0)) >= 2) & (F.coalesce("matched", F.lit(0)) >= 2)
    flagged = known & (F.coalesce("n_off", F.lit(0)) > 0)
    shown = F.array_join(F.transform("offs", lambda s: F.concat(F.lit("'"), s.text, F.lit("' / '"), s.text_b, F.lit("'"))), "; ")
    why = F.concat(F.format_string("%d of %d overlapping cell(s) disagree between the parses: ", "n_off", "matched"), shown)
    return _outcome(out, "cross_tier_agreement", flagged, F.lit("Error"), F.when(known, 0.92).otherwise(0.4), why)


def answer_support(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """claims (claim_id, doc, page, bbox, asserted) with supported, from the words centred in each claim's box."""
    words = spans.select("doc", "page", F.col("bbox").alias("span"), "ord", "text")
    near = claims.join(words, ["doc", "page"]).where(G.contains_center(F.col("bbox"), F.col("span")))
    crop = near.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s.text), " ").alias("crop"))
    out = claims.join(crop, "claim_id", "left")
    asked = claim_norm(F.col("asserted"))
    return out.withColumn("supported", F.coalesce((asked != "") & F.contains(claim_norm(F.col("crop")), asked), F.lit(False)))


def sampled_support(tables: DataFrame, cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Every filled body cell is a claim on its own box; the first unsupported one is reported. cells: doc, page, bbox."""
    claims = cells.where("NOT is_header").where(F.trim("text") != "").select(F.struct("table_id", "ord").alias("claim_id"), "table_id", "doc", "page", "bbox", "row", "col", F.col("text").alias("asserted"))
    judged = answer_support(claims, spans)
    found = judged.groupBy("table_id").agg(F.min(F.when(~F.col("supported"), F.struct(F.col("claim_id.ord").alias("ord"), "row", "col", "asserted"))).alias("bad"), F.count(F.lit(1)).alias("n"))
    out = tables.select("table_id").join(found, "table_id", "left")
    return _outcome(out, "answer_support", F.col("bad").isNotNull(), F.lit("Error"), F.lit(0.9), F.format_string("cell [%d,%d] '%s' is not in its cited crop", "bad.row", "bad.col", "bad.asserted"))


def adjudicate(outcomes: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (element_id, table_id) to element_id, n, flagged, verdict, winner and confidence."""
    flags = outcomes.groupBy("table_id").agg(F.bool_or("flagged").alias("flagged"), F.min(F.when(F.col("flagged"), 0.0).otherwise(F.col("confidence"))).alias("confidence"))
    per = candidates.join(flags, "table_id", "left").groupBy("element_id").agg(
        F.count("table_id").alias("n"), F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("flagged"), F.min("table_id").alias("one"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence")
    )
    verdict = F.when(F.col("n") == 0, "Equivalent").when(F.col("flagged"), "Ambiguous").when(F.col("n") == 1, "Winner").otherwise("Equivalent")
    return per.withColumn("verdict", verdict).withColumn("winner", F.when(F.col("verdict") == "Winner", F.col("one"))).drop("one")


def assess(tables: DataFrame, grid: DataFrame) -> DataFrame:
    """table_id, impression (Confirmed, NoIssues, Suspect) and its signals in order. tables may carry a risk struct."""
    recon = T.reconcile(grid)
    rows = T.total_rows(recon)
    totals = rows.groupBy("table_id").agg(F.sum(F.col("any_ok").cast("int")).alias("confirming"), F.sum(F.col("broadly_fails").cast("int")).alias("failing"))
    stray = T.type_violations(grid).groupBy("table_id").agg(F.count(F.lit(1)).alias("n_stray"))
    wide = grid.where("col_type = 'Numeric'").groupBy("table_id").agg(F.countDistinct("col").alias("numeric"))
    out = tables.join(totals, "table_id", "left").join(T.header_missing(grid), "table_id", "left").join(stray, "table_id", "left").join(T.completeness(grid), "table_id", "left").join(wide, "table_id", "left")
    if "risk" not in tables.columns:
        out = out.withColumn("risk", F.struct(F.lit(0.0).alias("min_ocr_confidence"), F.lit(False).alias("rotated_text"), F.lit(0.0).alias("figure_score")))
    failing, confirming = F.coalesce("failing", F.lit(0)), F.coalesce("confirming", F.lit(0))
    numeric, strays, empty = F.coalesce("numeric", F.lit(0)) > 0, F.coalesce("n_stray", F.lit(0)), F.coalesce("empty_data", F.lit(0))
    ocr = F.coalesce("risk.min_ocr_confidence", F.lit(0.0))
    signal = lambda test, good, text: F.when(test, F.struct(F.lit(good).alias("positive"), text.alias("detail")))
    signals = F.array(
        signal((failing == 0) & (confirming > 0), True, F.format_string("%d total row(s) reconcile", confirming)),
        signal(failing > 0, False, F.format_string("%d total row(s) reconcile in no column", failing)),
        signal(F.col("header_missing"), False, F.lit("the header row is made of data-like numbers")),
        signal(numeric & (strays == 0), True, F.lit("numeric columns hold numbers only")),
        signal(numeric & (strays > 0), False, F.format_string("%d non-numeric cell(s) in numeric columns", strays)),
        signal(numeric & (F.col("n_data") > 0) & (empty == 0), True, F.lit("data rows are complete")),
        signal(numeric & (F.col("n_data") > 0) & (empty > 0), False, F.format_string("%d empty cell(s) in data rows", empty)),
        signal(F.coalesce("risk.figure_score", F.lit(0.0)) > F.lit(0.15).cast("float"), False, F.lit("likely a figure, not a table")),
        signal(F.coalesce("risk.rotated_text", F.lit(False)), False, F.lit("rotated text in region")),
        signal((ocr > 0) & (ocr < 0.85), False, F.format_string("low OCR confidence %.2f", ocr.cast("double"))),
    )
    out = out.withColumn("signals", F.filter(signals, lambda s: s.isNotNull()))
    bad = F.exists("signals", lambda s: ~s.positive)
    return out.withColumn("impression", F.when(bad, "Suspect").when((confirming > 0) & (failing == 0), "Confirmed").otherwise("NoIssues")).select("table_id", "impression", "signals")


def answers_faithful(got: DataFrame, want: DataFrame) -> DataFrame:
    """table_id and faithful: the sorted numbers (rounded to 3 places) of both are equal. Both: table_id, num."""
    numbers = lambda df, n: df.where("num IS NOT NULL").groupBy("table_id").agg(F.array_sort(F.collect_list(F.round("num", 3))).alias(n))
    return numbers(got, "got").join(numbers(want, "want"), "table_id", "full").withColumn("faithful", F.coalesce("got", F.array().cast("array<double>")) == F.coalesce("want", F.array().cast("array<double>"))).select("table_id", "faithful")


def one_document(truth: DataFrame, parsed: DataFrame) -> list[str]:
    """The keys that bring truth and parsed tables of a page together; truth that names no document fits one only."""
    if "doc" in truth.columns:
        return ["doc", "page"]
    if "doc" in parsed.columns and len(parsed.select("doc").distinct().limit(2).collect()) > 1:
        raise ValueError("truth without a document column, but tables of several documents")
    return ["page"]


def match_truth(truth: DataFrame, parsed: DataFrame, least: float = 0.3) -> DataFrame:
    """truth (doc, page, name, bbox, ord) with the table_id of best overlap above `least` on its page; ties go to the later table."""
    keys = one_document(truth, parsed)
    box = parsed.select(*keys, "table_id", F.col("bbox").alias("box"), F.col("ord").alias("seq"))
    pairs = truth.join(box, keys).withColumn("iou", G.iou(F.col("bbox"), F.col("box"))).where(F.col("iou") > F.lit(least).cast("float"))
    named = ["doc", "name"] if "doc" in keys else ["name"]
    best = pairs.groupBy(*named).agg(F.max_by("table_id", F.struct("iou", "seq")).alias("table_id"), F.max("iou").alias("iou"))
    return truth.join(best, named, "left")


def missed(evals: DataFrame) -> DataFrame:
    """The wrong tables that nothing flagged, by name."""
    return evals.where(F.col("wrong") & (F.size("flagged_by") == 0)).select("name")


def catch_metrics(evals: DataFrame, detectors: tuple = ("intrinsic_arithmetic", "structural_validity", "answer_support"), examples: int = 20) -> DataFrame:
    """One row of rates over evals (name, matched, wrong, flagged_by array), with the first names missed (`missed` lists all)."""
    flagged, right = F.size("flagged_by") > 0, F.col("matched") & ~F.col("wrong")
    some = lambda test: F.sum(test.cast("int"))
    caught = some(F.col("wrong") & flagged)
    each = [some(F.col("wrong") & F.array_contains("flagged_by", d)).alias(f"caught_{d}") for d in detectors]
    first = missed(evals).orderBy("name").limit(examples).agg(F.array_sort(F.collect_list("name")).alias("missed"))
    return evals.agg(
        F.count(F.lit(1)).alias("n_tables"), some(F.col("wrong")).alias("n_wrong"), (caught / F.nullif(some(F.col("wrong")), F.lit(0))).alias("catch_rate"),
        (some(right & flagged) / F.nullif(some(right), F.lit(0))).alias("false_alarm_rate"),
        *each,
    ).join(F.broadcast(first), how="left", on=F.lit(True))  # fmt: skip  # one row each


def grid_diff(got: DataFrame, want: DataFrame) -> DataFrame:
    return T.diff_grids(got, want, diff_norm)


def region_pairs(regions: DataFrame, most: float = 0.1) -> DataFrame:
    """Overlapping tables of a page: (doc, page, i, j, iou) with i < j. regions: doc, page, ord, role, bbox."""
    t = regions.where("role = 'Table'")
    a, b = t.select("doc", "page", F.col("ord").alias("i"), F.col("bbox").alias("a")), t.select("doc", "page", F.col("ord").alias("j"), F.col("bbox").alias("b"))
    return a.join(b, ["doc", "page"]).where("i < j").withColumn("iou", G.iou(F.col("a"), F.col("b"))).where(F.col("iou") > F.lit(most).cast("float")).select("doc", "page", "i", "j", "iou")


def latest(df: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")
