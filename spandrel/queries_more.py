"""Further queries with their SQL: detectors and verdicts, renderings, predicates, readers, spatial joins, corpus steps.

As in queries.py the operators are fed frames that SQL derives from the shared tables; each query covers whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.functions import numbers as N
from spandrel.functions import text as X
from spandrel.operators import corpus as C
from spandrel.operators import detectors as D
from spandrel.operators import layout as L
from spandrel.operators import regions as R
from spandrel.operators import registry as V
from spandrel.operators import render as M
from spandrel.operators import tables as T
from spandrel.operators import triage as P
from spandrel.operators import typed as Y
from spandrel.operators import validator as W
from spandrel.plans import ops as O
from spandrel.queries import BOXED, IN_REGION, KEY, ORDERS, _numbered, _words, boxed, duck_iou, load, order_table, query, split_boxes
from spandrel.sources import readers as S
from spandrel.sources import text_tables as B
from spandrel.storage import saved

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


# --- detectors on the order lines: three columns, one planted fault by order ---


def faulty_table(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders of four lines and more as tables (Item, Count, Price); the first line's count is text where the order divides
    by 5, missing where it leaves 1; OCR is poor where it leaves 2, text rotated where it leaves 3."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), F.col("l_extendedprice").cast("long").alias("p"))
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(line)).alias("x")).where("size(x) >= 4")
    k = F.col("table_id") % 5
    first = F.when(k == 0, "n/m oops").when(k == 1, "")
    count = lambda v, i: F.when((i == 0) & first.isNotNull(), first).otherwise(v.q.cast("string"))
    rows = F.transform("x", lambda v, i: F.array(F.concat(F.lit("Part "), v.l_partkey.cast("string")), count(v, i), v.p.cast("string")))
    grid = lines.select("table_id", F.concat(F.array(F.array(F.lit("Item"), F.lit("Count"), F.lit("Price"))), rows).alias("grid"))
    risk = F.struct(F.when(k == 2, 0.7).otherwise(1.0).cast("float").alias("min_ocr_confidence"), (k == 3).alias("rotated_text"), F.lit(0.0).cast("float").alias("figure_score"))
    tables = grid.select("table_id", F.size("grid").alias("n_rows"), F.lit(3).alias("n_cols"), risk.alias("risk"))
    cells = grid.select("table_id", F.posexplode("grid").alias("row", "r")).select("table_id", "row", F.posexplode("r").alias("col", "text"))
    return tables, cells.withColumns({"ord": F.col("row") * 3 + F.col("col"), "is_header": F.col("row") == 0})


FAULTY = "f AS (SELECT l_orderkey AS table_id, l_orderkey % 5 AS k, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 4)"


@query(f"""WITH {FAULTY} SELECT table_id, k < 4 AS flagged, CASE WHEN k < 2 THEN 'Error' WHEN k < 4 THEN 'Warn' END AS severity, CASE WHEN k = 4 THEN 0.9::DOUBLE END AS confidence,
 CASE k WHEN 0 THEN '1 non-numeric cell(s) in numeric column(s), first [1,1] ''n/m oops''' WHEN 1 THEN '1 empty cell(s) in data rows; ragged numeric cells across data rows' WHEN 2 THEN 'low OCR confidence 0.70' WHEN 3 THEN 'rotated text in region' END AS reason FROM f""")
def structure_check(spark, sf_dir):
    tables, cells = faulty_table(spark, sf_dir)
    return D.structure(tables, saved(T.model(tables, cells), "model")).select("table_id", "flagged", "severity", "confidence", "reason")


@query(f"WITH {FAULTY} SELECT table_id, 1::INT AS row, 1::INT AS col, 'n/m oops' AS text FROM f WHERE k = 0")
def type_violations(spark, sf_dir):
    return T.type_violations(T.model(*faulty_table(spark, sf_dir)))


@query(f"WITH {FAULTY} SELECT table_id, 2::BIGINT AS n_numeric, n::BIGINT AS n_data, (k = 1)::BIGINT AS empty_data, k = 1 AS ragged FROM f")
def completeness(spark, sf_dir):
    return T.completeness(T.model(*faulty_table(spark, sf_dir))).select("table_id", "n_numeric", "n_data", "empty_data", "ragged")


@query(f"""WITH {FAULTY} SELECT table_id, CASE WHEN k < 4 THEN 'Suspect' ELSE 'NoIssues' END AS impression, (CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END)::INT AS positive, (k < 4)::INT AS negative FROM f""")
def assess_signals(spark, sf_dir):
    tables, cells = faulty_table(spark, sf_dir)
    good = lambda want: F.size(F.filter("signals", lambda s: s.positive == F.lit(want)))
    return D.assess(tables, saved(T.model(tables, cells), "model")).select("table_id", "impression", good(True).alias("positive"), good(False).alias("negative"))


@query(f"""WITH {FAULTY} SELECT table_id, col::INT AS col, CASE WHEN col = 0 THEN 'label' ELSE 'int' END AS dtype, (k = 1 AND col = 1 OR k = 0 AND col = 1)::BIGINT AS nulls, (k = 0 AND col = 1)::BIGINT AS violations FROM f, range(3) c(col)""")
def typed_report(spark, sf_dir):
    return Y.report(Y.materialize(saved(T.model(*faulty_table(spark, sf_dir)), "model"))).select("table_id", "col", "dtype", "nulls", "violations")


@query("""SELECT o_orderkey AS table_id, o_orderkey % 3 = 0 AS header_missing FROM orders""")
def header_missing(spark, sf_dir):
    """Headers that are years, but for every third order, where they are other numbers."""
    k = F.col("o_orderkey") % 3
    head = F.when(k == 0, F.array(F.lit("Item"), F.lit("17"), F.lit("2,500"))).otherwise(F.array(F.lit("Item"), F.lit("2031"), F.lit("2030")))
    body = F.array(F.col("o_orderstatus"), F.col("o_custkey").cast("string"), F.lit("5"))
    grid = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), F.array(head, body, body).alias("grid"), F.lit(1).alias("header_rows"))
    return T.header_missing(T.model(*S.grid_cells(grid)))


LINES = f"li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, l_quantity::INT AS q FROM lineitem)"


def placed_lines(spark, sf_dir) -> DataFrame:
    """Every order's lines below each other on the order's own page: table_id, doc, page, i, text, bbox."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = load(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(order) - 1)
    box = G.box(F.lit(0), F.col("i") * 20, F.lit(90), F.col("i") * 20 + 10)
    return li.select(F.col("l_orderkey").alias("table_id"), F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), "i", F.col("i").alias("ord"), F.col("i").alias("row"), F.lit(0).alias("col"), "l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), box.alias("bbox"), F.lit(False).alias("is_header"))


@query(f"""WITH {LINES}, k AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_partkey % 50 = 0) AS off FROM li GROUP BY 1)
SELECT l_orderkey AS table_id, n >= 2 AND off > 0 AS flagged, CASE WHEN n >= 2 AND off > 0 THEN NULL WHEN n >= 2 THEN 0.92 ELSE 0.4 END::DOUBLE AS confidence, CASE WHEN n >= 2 AND off > 0 THEN 'Error' END AS severity FROM k""")
def cross_tier_check(spark, sf_dir):
    """The second parse counts one more wherever the part's number divides by 50."""
    lines = placed_lines(spark, sf_dir)
    a, b = lines.withColumn("text", F.col("q").cast("string")), lines.withColumn("text", (F.col("q") + (F.col("l_partkey") % 50 == 0).cast("int")).cast("string"))
    return D.cross_tier(lines.select("table_id").distinct(), a, b).select("table_id", "flagged", "confidence", "severity")


@query(f"""WITH {LINES}, k AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber = 3) AS d FROM li GROUP BY 1), s AS (SELECT *, (d / n)::FLOAT AS share FROM k)
SELECT l_orderkey AS table_id, share > 0.15::FLOAT AS flagged, CASE WHEN share > 0.30::FLOAT THEN 'Error' WHEN share > 0.15::FLOAT THEN 'Warn' END AS severity, CASE WHEN share <= 0.15::FLOAT THEN round((1 - share)::DOUBLE, 5) END AS confidence FROM s""")
def residual_check(spark, sf_dir):
    """The parse has lost every third line of an order."""
    lines = placed_lines(spark, sf_dir).withColumn("text", F.concat(F.lit("w"), F.col("l_partkey").cast("string")))
    tables = lines.groupBy("table_id", "doc", "page").agg(G.union_agg(F.col("bbox")).alias("bbox"))
    out = D.residual(tables, lines.where("l_linenumber <> 3"), lines)
    return out.select("table_id", "flagged", "severity", F.round("confidence", 5).alias("confidence"))


@query(f"""WITH {LINES}, k AS (SELECT l_orderkey, arg_min(i, i) FILTER (l_linenumber = 2) AS bad FROM li GROUP BY 1)
SELECT l_orderkey AS table_id, bad IS NOT NULL AS flagged, CASE WHEN bad IS NULL THEN 0.9::DOUBLE END AS confidence, CASE WHEN bad IS NOT NULL THEN 'cell [' || bad || ',0] ''made up'' is not in its cited crop' END AS reason FROM k""")
def sampled_support(spark, sf_dir):
    lines = placed_lines(spark, sf_dir).withColumn("text", F.concat(F.lit("w"), F.col("l_partkey").cast("string")))
    cells = lines.withColumn("text", F.when(F.col("l_linenumber") == 2, "made up").otherwise(F.col("text")))
    return D.sampled_support(lines.select("table_id").distinct(), cells, lines).select("table_id", "flagged", "confidence", "reason")


@query("""WITH o AS (SELECT o_custkey AS element_id, o_orderkey, o_orderstatus = 'F' AS flagged, CASE WHEN o_orderstatus <> 'F' THEN (o_orderkey % 10) / 10 END AS confidence FROM orders)
SELECT element_id, count(*)::BIGINT AS n, CASE WHEN bool_or(flagged) THEN 'Ambiguous' WHEN count(*) = 1 THEN 'Winner' ELSE 'Equivalent' END AS verdict,
 CASE WHEN NOT bool_or(flagged) AND count(*) = 1 THEN min(o_orderkey) ELSE -1 END AS winner, CASE WHEN bool_or(flagged) THEN 0 ELSE min(confidence) END::DOUBLE AS confidence FROM o GROUP BY 1""")
def adjudicate(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    bad = F.col("o_orderstatus") == "F"
    outcomes = orders.select(F.col("o_orderkey").alias("table_id"), bad.alias("flagged"), F.when(~bad, (F.col("o_orderkey") % 10) / 10).alias("confidence"))
    return D.adjudicate(outcomes, orders.select(F.col("o_custkey").alias("element_id"), F.col("o_orderkey").alias("table_id"))).select("element_id", "n", "verdict", F.coalesce("winner", F.lit(-1)).alias("winner"), "confidence")


@query(f"""WITH {BOXED}, p AS (SELECT *, row_number() OVER (ORDER BY {KEYS}) AS seq FROM b), t AS (SELECT {KEYS}, doc, page, (x0 + 3)::FLOAT AS x0, y0, (x1 + 3)::FLOAT AS x1, y1 FROM b WHERE l_linenumber % 3 = 0),
m AS (SELECT t.*, p.seq, {duck_iou('t', 'p')} AS iou FROM t JOIN p ON t.doc = p.doc AND t.page = p.page AND p.l_linenumber % 3 <> 1), k AS (SELECT {KEYS}, arg_max(seq, (iou, seq)) AS seq FROM m WHERE iou > 0.3::FLOAT GROUP BY ALL)
SELECT DISTINCT t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, coalesce(k.seq, 0) AS matched FROM t LEFT JOIN k USING ({KEYS})""")
def match_truth(spark, sf_dir):
    b, three = boxed(load(spark, sf_dir, "lineitem")), F.lit(3).cast("float")
    parsed = _numbered(b, "seq").where("l_linenumber % 3 <> 1").select("doc", "page", F.col("seq").alias("table_id"), F.col("seq").alias("ord"), "bbox")
    truth = b.where("l_linenumber % 3 = 0").select("doc", "page", F.struct(*KEY).alias("name"), G.box(F.col("bbox.x0") + three, F.col("bbox.y0"), F.col("bbox.x1") + three, F.col("bbox.y1")).alias("bbox"))
    return D.match_truth(truth, parsed).select("name.*", F.coalesce("table_id", F.lit(0)).alias("matched")).distinct()


@query(f"""WITH {LINES}, k AS (SELECT l_orderkey, count(*) AS n FROM li GROUP BY 1), t AS (SELECT *, l_orderkey % 4 = 0 AND n > 0 AS wrong FROM k)
SELECT l_orderkey AS doc, true AS matched, wrong, CASE WHEN wrong THEN 1 ELSE 0 END::BIGINT AS divergences FROM t""")
def evaluate(spark, sf_dir):
    """Every order's page has one truth table of the same name; every fourth one says something else in its first row."""
    from spandrel.plans import commands

    lines = placed_lines(spark, sf_dir).withColumn("text", F.col("q").cast("string"))
    tables = lines.groupBy("table_id", "doc", "page").agg((F.max("row") + 1).alias("n_rows"), F.lit(1).alias("n_cols"), G.union_agg(F.col("bbox")).alias("bbox")).withColumn("ord", F.lit(0))
    truth = tables.select("doc", "page", "bbox", "ord", F.lit("only").alias("name"), F.concat_ws("#", "doc", F.lit("only")).alias("truth_id"))
    other = F.when((F.col("doc") % 4 == 0) & (F.col("row") == 0), "other").otherwise(F.col("text"))
    cells = lines.select(F.concat_ws("#", "doc", F.lit("only")).alias("table_id"), "row", "col", "ord", other.alias("text"), "is_header")
    evals, _ = commands.evaluate({"tables": tables, "cells": lines, "spans": lines}, truth, cells)
    return evals.select("doc", "matched", "wrong", "divergences")


@query("SELECT doc_id::VARCHAR AS name FROM labels WHERE quality = 0 AND toxic <> 1")
def missed_tables(spark, sf_dir):
    flagged = F.when(F.col("toxic") == 1, F.array(F.lit("answer_support"))).otherwise(F.array().cast("array<string>"))
    return D.missed(load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name"), (F.col("quality") == 0).alias("wrong"), flagged.alias("flagged_by")))


@query("SELECT l_orderkey AS table_id, l_orderkey % 4 <> 0 AS faithful FROM lineitem GROUP BY ALL")
def answers_faithful(spark, sf_dir):
    got = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_extendedprice").cast("double").alias("num"))
    return D.answers_faithful(got, got.withColumn("num", F.col("num") + (F.col("table_id") % 4 == 0).cast("int")))


@query("""WITH f AS (SELECT o_orderkey AS table_id, CASE o_orderkey % 6 WHEN 0 THEN 'totals do not reconcile' WHEN 1 THEN 'rows sum to 5' WHEN 2 THEN 'non-numeric cell' WHEN 3 THEN 'low OCR confidence' WHEN 4 THEN 'rotated text' ELSE 'ragged' END AS r, o_custkey % 3 AS h, o_orderkey % 4 = 0 AS t FROM orders),
c AS (SELECT table_id, t, CASE WHEN (r LIKE '%reconcile%' OR r LIKE '%sum%') AND h < 2 THEN ['sign-fix', 'markdown', 'docling'] WHEN r LIKE '%OCR%' OR r LIKE '%rotated%' THEN ['docling', 'markdown'] ELSE ['markdown', 'docling'] END AS c FROM f)
SELECT table_id, array_to_string(list_filter(c, lambda x: NOT t OR x <> 'markdown'), ',') AS candidates FROM c""")
def route(spark, sf_dir):
    k, h = F.col("o_orderkey") % 6, F.col("o_custkey") % 3
    reasons = F.when(k == 0, "totals do not reconcile").when(k == 1, "rows sum to 5").when(k == 2, "non-numeric cell").when(k == 3, "low OCR confidence").when(k == 4, "rotated text").otherwise("ragged")
    flags = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), reasons.alias("reasons"), F.when(h == 0, "<td>(5)</td>").when(h == 1, "<td>5 CR</td>").otherwise("<td>5</td>").alias("html"), F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("markdown"))).alias("tried"))
    return O.route(flags).select("table_id", F.array_join("candidates", ",").alias("candidates"))


@query("""SELECT round(t / 10, 1) AS threshold, round(avg((e > t / 10)::INT) FILTER (c), 6) AS true_positive_rate, round(avg((e > t / 10)::INT) FILTER (NOT c), 6) AS false_positive_rate
FROM (SELECT (doc_id % 100) / 100 AS e, toxic = 1 AS c FROM labels), range(1, 4) r(t) GROUP BY t""")
def threshold_sweep(spark, sf_dir):
    scores = load(spark, sf_dir, "labels").select(((F.col("doc_id") % 100) / 100).alias("error"), (F.col("toxic") == 1).alias("corrupted"))
    out = W.sweep(scores, [0.1, 0.2, 0.3])
    return out.select("threshold", *(F.round(c, 6).alias(c) for c in ("true_positive_rate", "false_positive_rate")))


@query("""WITH d AS (SELECT doc_id, text, substr(text, 1, length(text) - length(text) // 2) AS half FROM documents),
a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\(?[0-9][0-9,]*\\)?')) AS t FROM d), b AS (SELECT doc_id, unnest(regexp_extract_all(half, '\\(?[0-9][0-9,]*\\)?')) AS t FROM d),
x AS (SELECT doc_id, regexp_replace(t, '[^0-9]', '', 'g') AS t, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT doc_id, regexp_replace(t, '[^0-9]', '', 'g') AS t, count(*) AS m FROM b GROUP BY 1, 2),
k AS (SELECT doc_id, sum(coalesce(n, 0)) AS a, sum(coalesce(m, 0)) AS b, sum(abs(coalesce(n, 0) - coalesce(m, 0)))::BIGINT AS d FROM x FULL JOIN y USING (doc_id, t) GROUP BY 1)
SELECT doc_id AS table_id, CASE WHEN d = 0 THEN 'all numbers agree' WHEN a * 2 < b THEN 'far fewer numbers here than there' ELSE d || ' number(s) differ' END AS hint FROM k""")
def failure_hint(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("table_id"), "text")
    return C.number_difference(docs, docs.select("table_id", F.expr("substr(text, 1, length(text) - length(text) div 2)").alias("text"))).select("table_id", "hint")


# --- renderings ---

ROWS = f"{ORDERS}, x AS (SELECT l_orderkey AS t, 0 AS row, 'Item' AS name, 'Amount' AS amount FROM li GROUP BY ALL UNION ALL SELECT l_orderkey, i + i // 3 + 1, 'Part ' || l_partkey, q::VARCHAR FROM li UNION ALL SELECT l_orderkey, row, 'Total', t::VARCHAR FROM tot)"


@query(f"WITH {ROWS} SELECT t AS table_id, row::INT AS row, col::INT AS col, CASE col WHEN 0 THEN name ELSE amount END AS text FROM x, range(2) c(col)")
def markdown_round_trip(spark, sf_dir):
    return M.markdown_cells(M.table_markdown(T.dense_grid(*order_table(spark, sf_dir))))


@query(f"""WITH {ROWS} SELECT t AS table_id, '<table>' || string_agg(CASE row WHEN 0 THEN '<tr><th>' || name || '</th><th>' || amount || '</th></tr>' ELSE '<tr><td>' || name || '</td><td>' || amount || '</td></tr>' END, '' ORDER BY row) || '</table>' AS html FROM x GROUP BY 1""")
def table_html(spark, sf_dir):
    return M.table_html(T.model(*order_table(spark, sf_dir)))


@query("""WITH o AS (SELECT o_custkey AS t, o_orderkey % 2 AS row, o_orderstatus AS x, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS col FROM orders),
g AS (SELECT *, sum((p IS NULL OR p <> x)::INT) OVER (PARTITION BY t, row ORDER BY col) AS run FROM (SELECT *, lag(x) OVER (PARTITION BY t, row ORDER BY col) AS p FROM o))
SELECT t AS table_id, row::BIGINT AS row, min(col)::INT AS col, any_value(x) AS text, count(*)::BIGINT AS colspan FROM g GROUP BY t, row, run""")
def header_spans(spark, sf_dir):
    col = F.row_number().over(Window.partitionBy("o_custkey", F.col("o_orderkey") % 2).orderBy("o_orderkey")) - 1
    grid = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), (F.col("o_orderkey") % 2).cast("long").alias("row"), col.alias("col"), F.col("o_orderstatus").alias("text"), F.lit(2).alias("header_rows"))
    return M.header_spans(grid)


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def reading_order(spark, sf_dir):
    return M.reading_order(load(spark, sf_dir, "conversations").withColumnRenamed("turn", "ord"), ["conv_id"])


@query("""WITH e AS (SELECT conv_id, turn, text, CASE turn % 5 WHEN 0 THEN 'Heading' ELSE 'Paragraph' END AS role FROM conversations), k AS (SELECT conv_id, count(*) || ' elements' AS n, string_agg(text, '; ' ORDER BY turn) FILTER (role = 'Heading') AS h, substr(arg_min(text, turn) FILTER (role = 'Paragraph'), 1, 180) AS p FROM e GROUP BY 1)
SELECT conv_id, concat_ws(chr(10), n, nullif(h, ''), p) AS summary FROM k""")
def document_summary(spark, sf_dir):
    return M.summary(load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text", F.when(F.col("turn") % 5 == 0, "Heading").otherwise("Paragraph").alias("role")), ["conv_id"])


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '3 x 2' WHEN 1 THEN 'Table' WHEN 2 THEN '7 elements' ELSE CASE WHEN length(regexp_replace(text, '\\s+', ' ', 'g')) > 60 THEN substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 59) || '…' ELSE regexp_replace(text, '\\s+', ' ', 'g') END END AS preview FROM documents WHERE text IS NOT NULL""")
def previews(spark, sf_dir):
    k = F.col("doc_id") % 4
    docs = load(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select("doc_id", "text", F.when(k == 0, "HtmlTable").when(k == 1, "Region").when(k == 2, "Document").otherwise("Text").alias("kind"), F.lit(3).alias("n_rows"), F.lit(2).alias("n_cols"), F.lit("Table").alias("label"), F.lit(7).alias("n_elements"))
    return M.previews(rows).select("doc_id", "preview")


@query("""SELECT p_partkey, url_encode(p_name || ' / é~' || p_size) AS encoded, p_name || ' / é~' || p_size AS decoded FROM part""")
def url_forms(spark, sf_dir):
    name = F.concat("p_name", F.lit(" / é~"), F.col("p_size").cast("string"))
    part = load(spark, sf_dir, "part").select("p_partkey", X.url_encoded(name).alias("encoded"))
    return part.withColumn("decoded", X.percent_decoded(F.replace("encoded", F.lit("%20"), F.lit("+"))))


@query("""SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN format('{:.1f} s', ms / 1000) ELSE (ms // 60000) || 'm ' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || 's' END AS elapsed FROM (SELECT o_orderkey, (o_orderkey * 37) % 200000 // 100 * 100 AS ms FROM orders)""")
def elapsed_text(spark, sf_dir):
    ms = F.floor((F.col("o_orderkey") * 37) % 200000 / 100) * 100
    return load(spark, sf_dir, "orders").select("o_orderkey", X.elapsed(ms).alias("elapsed"))


# --- predicates, labels, coordinates ---


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN ' — ' WHEN 1 THEN 'N/A' WHEN 2 THEN '2031' WHEN 3 THEN '1899' WHEN 4 THEN '$ (' WHEN 5 THEN '(5)' WHEN 6 THEN '5 cr' WHEN 7 THEN o_orderstatus ELSE o_custkey::VARCHAR END AS s FROM orders)
SELECT o_orderkey, lower(trim(s)) IN ('-', '—', '–', '--', 'n/a', 'na', 'nm', 'n/m') AS placeholder, regexp_full_match(trim(s), '[0-9]{4}') AND coalesce(try_cast(trim(s) AS INT) BETWEEN 1900 AND 2100, false) AS year, regexp_full_match(trim(s), '[$€£¥()—–-]+') AS symbols,
 regexp_matches(s, '[0-9]') AS digit, CASE WHEN regexp_matches(s, '[0-9]') THEN CASE WHEN s IN ('(5)', '5 cr') THEN -1 ELSE 1 END ELSE 0 END::INT AS sign FROM c""")
def cell_predicates(spark, sf_dir):
    k, s = F.col("o_orderkey") % 9, F.col("s")
    cell = F.when(k == 0, " — ").when(k == 1, "N/A").when(k == 2, "2031").when(k == 3, "1899").when(k == 4, "$ (").when(k == 5, "(5)").when(k == 6, "5 cr").when(k == 7, F.col("o_orderstatus")).otherwise(F.col("o_custkey").cast("string"))
    c = load(spark, sf_dir, "orders").select("o_orderkey", cell.alias("s"))
    return c.select("o_orderkey", N.is_placeholder(s).alias("placeholder"), X.is_year(s).alias("year"), X.is_symbol_only(s).alias("symbols"), X.has_digit(s).alias("digit"), F.coalesce(X.number_sign(s), F.lit(0)).alias("sign"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Table' WHEN 1 THEN 'Text' WHEN 2 THEN 'Figure' WHEN 3 THEN 'Caption' ELSE 'Other' END AS role, CASE c_custkey % 6 WHEN 0 THEN 'Table' WHEN 1 THEN 'Section-header' WHEN 2 THEN 'Picture' WHEN 3 THEN 'Caption' WHEN 4 THEN 'Page-footer' ELSE 'Side Note' END AS canonical FROM customer""")
def labels_named(spark, sf_dir):
    k = F.col("c_custkey") % 6
    label = F.when(k == 0, "TABLE").when(k == 1, "section_header").when(k == 2, " picture").when(k == 3, "caption").when(k == 4, "abandon").otherwise("side_note")
    return load(spark, sf_dir, "customer").select("c_custkey", X.role_of(label).alias("role"), X.canonical_label(label).alias("canonical"))


@query(f"""WITH {BOXED} SELECT {KEYS}, (x0 / 2)::FLOAT AS pt, (y1 * 2)::FLOAT AS px, (x0 + 7)::FLOAT AS moved, (1000 - y0)::FLOAT AS flipped, round((x1 / 1000 * 100)::DOUBLE, 3) AS percent FROM b""")
def box_moves(spark, sf_dir):
    b, one = F.col("bbox"), lambda v: F.lit(v).cast("float")
    flipped = G.to_top_left(b.x0, b.y0, b.x1, b.y1, F.lit("BOTTOMLEFT"), one(1000))
    return boxed(load(spark, sf_dir, "lineitem")).select(
        *KEY, G.pixels_to_points(b, one(2))["x0"].alias("pt"), G.points_to_pixels(b, one(2))["y1"].alias("px"), G.crop_to_page(b, one(7), one(9))["x0"].alias("moved"),
        flipped["y0"].alias("flipped"), F.round(G.percent_box(b, one(1000), one(1000))["x1"].cast("double"), 3).alias("percent"),
    )


@query("""SELECT o_orderkey, o_orderkey % 10 < 8 OR o_custkey % 4 = 3 OR o_orderkey % 7 = 0 OR o_custkey % 11 = 0 OR o_orderkey % 13 = 0 AS risky FROM orders""")
def looks_risky(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    risk = F.struct(F.when(o % 10 < 8, 0.8).otherwise(0.9).alias("min_ocr_confidence"), F.when(c % 4 == 3, 0.6).otherwise(0.5).alias("column_count_variance"), (o % 7 == 0).cast("int").alias("merged_cell_rows"), (c % 11 == 0).cast("int").alias("empty_cells"), (o % 13 == 0).alias("rotated_text"))
    return load(spark, sf_dir, "orders").select("o_orderkey", risk.alias("r")).select("o_orderkey", G.looks_risky(F.col("r")).alias("risky"))


# --- spatial joins and layout ---


@query(f"""WITH {BOXED} SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey FROM b r WHERE r.l_linenumber % 2 = 1 AND NOT EXISTS (SELECT 1 FROM b s WHERE s.doc = r.doc AND s.page = r.page AND s.l_linenumber % 2 = 0 AND {duck_iou('r', 's')} >= 0.7::FLOAT)""")
def disagreeing_regions(spark, sf_dir):
    blocks, regions = split_boxes(spark, sf_dir)
    return R.disagreeing(regions, blocks).select(*KEY)


@query(f"""WITH {BOXED}, w AS (SELECT doc, page, l_partkey % 40 AS token, x0, y0, x1, y1, count(*) OVER (PARTITION BY doc, page, l_partkey % 40) AS n FROM b), t AS (SELECT DISTINCT doc, page, l_suppkey % 3 AS s, l_partkey % 40 AS token FROM b WHERE l_linenumber <= 2),
h AS (SELECT t.doc, t.page, t.s, w.* EXCLUDE (doc, page, token), count(*) FILTER (w.n <= 2) OVER (PARTITION BY t.doc, t.page, t.s) AS few FROM t JOIN w ON w.doc = t.doc AND w.page = t.page AND w.token = t.token)
SELECT doc, page, s::BIGINT AS s, count(*)::BIGINT AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM h WHERE n <= 2 OR few < 3 GROUP BY ALL HAVING count(*) >= 3""")
def rare_token_box(spark, sf_dir):
    b = boxed(load(spark, sf_dir, "lineitem")).withColumn("token", F.col("l_partkey") % 40)
    tables = b.where("l_linenumber <= 2").withColumn("table_id", F.struct("doc", "page", (F.col("l_suppkey") % 3).cast("long").alias("s")))
    out = R.rare_token_box(b.select("doc", "page", "token", "bbox"), tables.select("table_id", "doc", "page", "token"))
    return out.select("table_id.doc", "table_id.page", "table_id.s", "n", *(F.col(f"bbox.{s}").alias(s) for s in G.SIDES))


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS i, turn % 2 AS side FROM conversations), a AS (SELECT * FROM c WHERE side = 0), b AS (SELECT * FROM c WHERE side = 1)
SELECT conv_id, coalesce(a.turn, -1) AS even, coalesce(b.turn, -1) AS odd FROM a FULL JOIN b USING (conv_id, i)""")
def zip_by_order(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    side = lambda k, n: c.where(F.col("turn") % 2 == k).withColumnRenamed("turn", n)
    return R.zip_by_order(side(0, "even"), side(1, "odd"), ["even"], ["odd"], ["conv_id"]).fillna(-1)


@query(f"""WITH {BOXED}, o AS (SELECT doc, page, x0, x1, max(x1) OVER (PARTITION BY doc, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), k AS (SELECT doc, page, count(*) FILTER (reach IS NULL OR x0 > reach + 12) AS n FROM o GROUP BY 1, 2)
SELECT doc, page, 3 AS claimed, n::BIGINT AS n_columns FROM k WHERE n <> 3""")
def column_mismatch(spark, sf_dir):
    words = _words(spark, sf_dir)
    return L.column_mismatch(words.select("doc", "page", F.lit(3).alias("claimed")).distinct(), words, ["doc", "page"])


@query(f"""WITH {BOXED}, r AS (SELECT * FROM b WHERE l_linenumber % 2 = 1), s AS (SELECT * FROM b WHERE l_linenumber % 2 = 0 AND l_partkey % 3 <> 0),
o AS (SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, sum((greatest(least(r.x1, s.x1) - greatest(r.x0, s.x0), 0) * greatest(least(r.y1, s.y1) - greatest(r.y0, s.y0), 0))::DOUBLE) AS a FROM r JOIN s ON s.doc = r.doc AND s.page = r.page AND {IN_REGION} GROUP BY ALL)
SELECT {KEYS}, round(coalesce(a, 0) / greatest(((x1 - x0) * (y1 - y0))::DOUBLE, 1e-6) + 1e-7, 4) AS figure_score FROM r LEFT JOIN (SELECT * FROM o) o USING ({KEYS})""")
def figure_score(spark, sf_dir):
    b = boxed(load(spark, sf_dir, "lineitem"))
    rects = b.where("l_linenumber % 2 = 0").select("doc", "page", F.col("bbox").alias("box"), F.when(F.col("l_partkey") % 3 == 0, 0.9).otherwise(0.2).alias("lightness"))
    # a region is a place of its own here, whatever its row
    regions = b.where("l_linenumber % 2 = 1").select(*KEY, "doc", "page", "bbox", F.monotonically_increasing_id().alias("at"))
    return L.figure_score(regions, rects).select(*KEY, F.round(F.col("figure_score") + 1e-7, 4).alias("figure_score"))


@query("""WITH c AS (SELECT DISTINCT o_orderkey // 200 AS t, o_orderkey % 50 AS r, o_custkey % 4 AS c FROM orders), n AS (SELECT t, r, count(*) AS n FROM c GROUP BY 1, 2), w AS (SELECT t, max(c) + 1 AS w FROM c GROUP BY 1)
SELECT t AS table_id, round((var_pop(n) / avg(n))::DOUBLE, 4) AS variance, count(*) FILTER (n < w)::BIGINT AS merged_cell_rows, sum(w - n)::BIGINT AS empty_cells FROM n JOIN w USING (t) GROUP BY 1""")
def grid_risk(spark, sf_dir):
    from spandrel.queries import gappy

    _, cells = gappy(spark, sf_dir)
    spans = cells.select("table_id", F.lit(1.0).alias("confidence"), F.lit(False).alias("rotated"))
    out = L.grid_risk(cells, spans)
    return out.select("table_id", F.round(F.col("risk.column_count_variance").cast("double"), 4).alias("variance"), F.col("risk.merged_cell_rows").cast("long").alias("merged_cell_rows"), "risk.empty_cells")


@query("""WITH c AS (SELECT DISTINCT o_orderkey // 200 AS t, o_orderkey % 50 AS r, o_custkey % 4 AS c FROM orders WHERE o_orderstatus <> 'F'), t AS (SELECT DISTINCT o_orderkey // 200 AS t FROM orders), n AS (SELECT t.t, r.r, count(c.c) AS n FROM t, range(50) r(r) LEFT JOIN c ON c.t = t.t AND c.r = r.r GROUP BY 1, 2)
SELECT t AS table_id, round(CASE WHEN avg(n) > 0 THEN var_pop(n) / avg(n) ELSE 0 END::DOUBLE, 4) AS variance, count(*) FILTER (n < 4)::BIGINT AS merged_cell_rows, sum(4 - n)::BIGINT AS empty_cells FROM n GROUP BY 1""")
def placed_risk(spark, sf_dir):
    from spandrel.queries import gappy

    tables, cells = gappy(spark, sf_dir)
    one = cells.withColumn("text", F.when(F.col("text") == "F", " ").otherwise(F.col("text"))).where("trim(text) <> ''").dropDuplicates(["table_id", "row", "col"])
    out = L.placed_risk(tables, one)
    return out.select("table_id", F.round(F.col("risk.column_count_variance").cast("double"), 4).alias("variance"), "risk.merged_cell_rows", "risk.empty_cells")


# --- readers on JSON that is rendered from the tables ---


def as_json(df: DataFrame, doc: str, body, schema: str) -> DataFrame:
    """Rows of doc and the columns of schema, by way of a JSON text."""
    return df.select(F.col(doc).alias("doc"), F.from_json(F.to_json(body), schema).alias("x")).select("doc", "x.*")


def line_arrays(spark, sf_dir, each) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x")).select("l_orderkey", F.transform("x", each).alias("x"))


def numbers(*v):
    return F.array(*(x.cast("double") for x in v))


@query(f"""WITH {LINES} SELECT l_orderkey AS doc, 1 AS page, i::INT AS ord, 'p' || l_partkey AS text, i::FLOAT AS x0, q::FLOAT AS y1, CASE WHEN l_partkey % 2 = 0 THEN 0.5 ELSE 1 END::FLOAT AS confidence, false AS rotated FROM li""")
def text_layer_spans(spark, sf_dir):
    span = lambda v, i: F.struct(F.concat(F.lit("p"), v.l_partkey.cast("string")).alias("text"), numbers(i, i, i + 1, v.l_quantity).alias("bbox"), F.when(v.l_partkey % 2 == 0, 0.5).alias("confidence"))
    page = F.struct(F.lit(1).alias("page"), F.lit(612).alias("width"), F.col("x").alias("spans"))
    docs = as_json(line_arrays(spark, sf_dir, span), "l_orderkey", F.struct(F.array(page).alias("pages")), S.QDOC)
    return S.spans_of(docs.select("doc", F.explode("pages").alias("p"))).select("doc", "page", "ord", "text", "bbox.x0", "bbox.y1", "confidence", "rotated")


@query(f"""WITH {LINES} SELECT l_orderkey AS doc, i::INT AS ord, CASE WHEN l_partkey % 3 = 0 THEN 'Table' ELSE 'picture' END AS label, CASE WHEN l_partkey % 3 = 0 THEN 'Table' ELSE 'Figure' END AS role, (i / 2)::FLOAT AS x0, (q / 2)::FLOAT AS y1, 1::FLOAT AS confidence FROM li""")
def layout_regions(spark, sf_dir):
    region = lambda v, i: F.struct(F.when(v.l_partkey % 3 != 0, "picture").alias("label"), numbers(i, i, i + 1, v.l_quantity).alias("bbox"))
    docs = as_json(line_arrays(spark, sf_dir, region), "l_orderkey", F.struct(F.col("x").alias("regions"), F.lit(2.0).alias("scale")), S.LAYOUT)
    return S.layout_regions(docs).select("doc", "ord", "label", "role", "bbox.x0", "bbox.y1", "confidence")


@query(f"""WITH {LINES} SELECT l_orderkey || '#c0' AS table_id, i::INT AS row, 'p' || l_partkey AS text, CASE WHEN l_partkey % 2 = 0 THEN i ELSE 0 END::FLOAT AS x0, false AS is_header FROM li""")
def cloud_cells(spark, sf_dir):
    cell = lambda v, i: F.struct(i.alias("row"), F.lit(0).alias("col"), F.concat(F.lit("p"), v.l_partkey.cast("string")).alias("text"), F.when(v.l_partkey % 2 == 0, numbers(i, i, i, i)).alias("bbox"))
    zero = F.lit(0)
    table = F.struct(F.lit(1).alias("page"), numbers(zero, zero, zero + 9, zero + 9).alias("bbox"), F.size("x").alias("n_rows"), F.lit(1).alias("n_cols"), F.col("x").alias("cells"))
    docs = as_json(line_arrays(spark, sf_dir, cell), "l_orderkey", F.struct(F.array(table).alias("tables")), S.CLOUD).withColumn("doc", F.col("doc").cast("string"))
    return S.cloud_tables(docs)[1].select("table_id", "row", "text", "bbox.x0", "is_header")


@query(f"""WITH {LINES} SELECT l_orderkey AS doc, 1 AS page, i::INT AS ord, 'p' || l_partkey AS text, (i + q)::FLOAT AS x1 FROM li WHERE l_partkey % 4 <> 0""")
def text_items(spark, sf_dir):
    item = lambda v, i: F.struct(F.when(v.l_partkey % 4 == 0, "  ").otherwise(F.concat(F.lit("p"), v.l_partkey.cast("string"))).alias("text"), i.alias("x"), i.alias("y"), v.l_quantity.cast("double").alias("width"), F.lit(1).alias("height"))
    page = F.struct(F.lit(1).alias("page"), F.col("x").alias("textItems"))
    docs = as_json(line_arrays(spark, sf_dir, item), "l_orderkey", F.struct(F.array(page).alias("pages")), S.LITEPARSE_DOC)
    return S.liteparse_spans(docs).select("doc", "page", "ord", "text", "bbox.x1")


@query(f"""WITH {LINES} SELECT l_orderkey || '#d' AS table_id, i::INT AS row, c::INT AS col, CASE c WHEN 0 THEN 'p' || l_partkey ELSE q::VARCHAR END AS text, i = 0 AS is_header FROM li, range(2) r(c)""")
def truth_cells(spark, sf_dir):
    row = lambda v, i: F.array(F.concat(F.lit("p"), v.l_partkey.cast("string")), v.l_quantity.cast("int").cast("string"))
    table = F.struct(F.lit("d").alias("name"), F.lit(1).alias("page"), F.col("x").alias("cells"))
    docs = as_json(line_arrays(spark, sf_dir, row), "l_orderkey", F.struct(F.array(table).alias("tables")), S.TRUTH).withColumn("doc", F.col("doc").cast("string"))
    return S.truth_tables(docs, "doc")[1].select("table_id", "row", "col", "text", "is_header")


@query("""SELECT p_partkey, row::INT AS row, col::INT AS col, CASE row WHEN 0 THEN CASE col WHEN 0 THEN 'name' ELSE 'size' END ELSE CASE col WHEN 0 THEN p_name ELSE p_size::VARCHAR END END AS text, row = 0 AS is_header FROM part, range(2) r(row), range(2) c(col)""")
def markdown_scan(spark, sf_dir):
    text = F.concat(F.lit("prose\n| name | size |\n|---|:-:|\n| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\nmore"))
    return B.scan(load(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "t", "p_partkey", "markdown").drop("table_no")


@query("""SELECT p_partkey, row::INT AS row, col::INT AS col, CASE WHEN row = 0 THEN CASE col WHEN 0 THEN 'both' ELSE '' END ELSE CASE col WHEN 0 THEN p_name ELSE p_size::VARCHAR END END AS text, row = 0 AS is_header FROM part, range(2) r(row), range(2) c(col)""")
def html_scan(spark, sf_dir):
    html = F.concat(F.lit("<p>x</p><table><tr><th colspan=2>both</th></tr><tr><td>"), "p_name", F.lit("</td><td> "), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    return B.scan(load(spark, sf_dir, "part").select("p_partkey", html.alias("t")), "t", "p_partkey", "html").drop("table_no")


# --- registry, triage, corpus ---


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'HtmlTable' ELSE 'Region' END AS kind FROM orders) SELECT a.o_orderkey AS child, a.o_orderkey + 1 AS parent, coalesce(b.kind, '?') AS parent_kind FROM o a LEFT JOIN o b ON b.o_orderkey = a.o_orderkey + 1""")
def lineage_kinds(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    arts = orders.select(F.col("o_orderkey").alias("artifact_id"), F.when(F.col("o_orderkey") % 2 == 0, "HtmlTable").otherwise("Region").alias("kind"))
    return V.lineage_kinds(orders.select(F.col("o_orderkey").alias("child"), (F.col("o_orderkey") + 1).alias("parent")), arts).select("child", "parent", "parent_kind")


@query("""WITH p AS (SELECT page_id % 7 AS doc, CASE WHEN length(html) % 400 >= 150 THEN 'text' WHEN page_id % 20 < 5 THEN 'blank' WHEN length(html) % 400 < 25 THEN 'image_content' ELSE 'text' END AS k FROM pages)
SELECT doc, count(*) FILTER (k = 'text')::BIGINT AS text, count(*) FILTER (k = 'image_content')::BIGINT AS image_content, count(*) FILTER (k = 'blank')::BIGINT AS blank FROM p GROUP BY 1""")
def triage_counts(spark, sf_dir):
    klass = P.page_class(F.length("html") % 400, (F.col("page_id") % 20).cast("double"))
    return P.counts(load(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("doc"), klass.alias("klass")), ["doc"])


@query("""SELECT page_id AS page, 'OcrDeferred' AS status, 612::FLOAT AS x1 FROM pages WHERE length(html) % 400 < 25 AND page_id % 20 >= 5""")
def ocr_markers(spark, sf_dir):
    klass = P.page_class(F.length("html") % 400, (F.col("page_id") % 20).cast("double"))
    pages = load(spark, sf_dir, "pages").select(F.lit("d").alias("doc"), F.col("page_id").alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), klass.alias("klass"))
    return P.ocr_markers(pages).select("page", "status", "bbox.x1")


@query("""WITH t AS (SELECT o_custkey AS doc, o_orderkey AS page FROM orders WHERE o_orderstatus = 'O') SELECT doc, page FROM t QUALIFY row_number() OVER (PARTITION BY doc ORDER BY page) <= 2""")
def table_pages(spark, sf_dir):
    pages = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), "o_orderstatus")
    return C.table_pages(pages.select("doc", "page"), pages.where("o_orderstatus = 'O'"), 2)


@query("""WITH t AS (SELECT o_custkey AS doc, o_orderkey AS table_id, o_orderkey % 15 AS n_rows, o_custkey % 10 AS n_cols FROM orders), p AS (SELECT * FROM t WHERE n_rows BETWEEN 3 AND 12 AND n_cols BETWEEN 2 AND 8 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY table_id) <= 2)
SELECT doc, table_id FROM p ORDER BY doc, table_id LIMIT 300""")
def corpus_tables(spark, sf_dir):
    t = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("table_id"), (F.col("o_orderkey") % 15).alias("n_rows"), (F.col("o_custkey") % 10).alias("n_cols"))
    return C.corpus_tables(t, 2, 300).select("doc", "table_id")


@query(f"""WITH {LINES}, k AS (SELECT l_orderkey, l_partkey, l_linenumber % 2 AS side, count(*) AS n FROM li GROUP BY ALL), m AS (SELECT l_orderkey, l_partkey, coalesce(max(n) FILTER (side = 1), 0) AS o, coalesce(max(n) FILTER (side = 0), 0) AS h FROM k GROUP BY ALL)
SELECT l_orderkey::VARCHAR AS table_id, sum(least(o, h))::BIGINT AS n_matched, sum(o)::BIGINT AS n_obs, sum(h)::BIGINT AS n_hyp FROM m GROUP BY 1 HAVING sum(o) > 0 AND sum(h) > 0""")
def token_alignment(spark, sf_dir):
    """Odd lines as seen words, even ones as a parse: the same part's word matches by occurrence (no two spell a third)."""
    lines = placed_lines(spark, sf_dir).withColumn("text", F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("x"))).withColumn("table_id", F.col("table_id").cast("string"))
    obs = lines.where("l_linenumber % 2 = 1").select("table_id", "text", *(F.col(f"bbox.{s}").alias(s) for s in G.SIDES))
    pairs = W.matched_pairs(obs, lines.where("l_linenumber % 2 = 0").select("table_id", "row", "col", "text"))
    per = pairs.groupBy("table_id").agg(F.count_if(F.col("kind") == "matched").alias("n_matched"), F.count("obs_text").alias("n_obs"), F.count("hyp_text").alias("n_hyp"))
    return per.where("n_obs > 0 AND n_hyp > 0")
