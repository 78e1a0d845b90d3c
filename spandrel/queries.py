"""One query per operator over the shared tables, with its SQL for DuckDB where SQL can say it.

The shared tables hold no page geometry, so the operators are fed frames that SQL derives from them: accounting strings
rendered from prices, boxes from keys, registry logs from order lines. Each query covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.functions import numbers as N
from spandrel.functions import text as X
from spandrel.operators import detectors as D
from spandrel.operators import layout as L
from spandrel.operators import regions as R
from spandrel.operators import registry as V
from spandrel.operators import render as M
from spandrel.operators import tables as T
from spandrel.operators import typed as Y
from spandrel.storage import saved

QUERIES: dict = {}
ORACLES: dict = {}
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def boxed(df: DataFrame) -> DataFrame:
    """Boxes from lineitem's keys: a few dozen a page at any scale, as the number of pages grows with the table."""
    return df.withColumns({
        "doc": F.pmod(F.floor(F.col("l_orderkey") / 8), F.lit(50)), "page": F.floor(F.col("l_orderkey") / 50),
        "bbox": G.box(F.col("l_partkey") % 500, F.col("l_suppkey") % 700, F.col("l_partkey") % 500 + F.col("l_quantity") * 2, F.col("l_suppkey") % 700 + F.col("l_linenumber") * 5),
    })


BOXED = """b AS (SELECT *, l_orderkey // 8 % 50 AS doc, l_orderkey // 50 AS page, (l_partkey % 500)::FLOAT AS x0, (l_suppkey % 700)::FLOAT AS y0,
  (l_partkey % 500 + l_quantity * 2)::FLOAT AS x1, (l_suppkey % 700 + l_linenumber * 5)::FLOAT AS y1 FROM lineitem)"""


def duck_iou(a: str, b: str) -> str:
    w = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    h = f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    size = lambda t: f"(greatest({t}.x1 - {t}.x0, 0::FLOAT) * greatest({t}.y1 - {t}.y0, 0::FLOAT))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN ({w} * {h}) / ({size(a)} + {size(b)} - {w} * {h}) ELSE 0::FLOAT END)"


def money(df: DataFrame) -> DataFrame:
    """Prices as accountants write them, by line number."""
    amount = F.format_number("l_extendedprice", 2)
    kinds = F.when(F.col("l_linenumber") % 7 == 0, F.concat(F.lit("$"), amount)).when(F.col("l_linenumber") % 7 == 1, F.concat(F.lit("("), amount, F.lit(")")))
    kinds = kinds.when(F.col("l_linenumber") % 7 == 2, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%"))).when(F.col("l_linenumber") % 7 == 3, "—")
    kinds = kinds.when(F.col("l_linenumber") % 7 == 4, F.concat(amount, F.lit(" CR"))).when(F.col("l_linenumber") % 7 == 5, F.concat(amount, F.lit("-"))).otherwise(F.concat(amount, F.lit("DR")))
    return df.withColumn("cell", kinds)


MONEY = """m AS (SELECT *, format('{:,.2f}', l_extendedprice) AS a FROM lineitem),
c AS (SELECT *, CASE l_linenumber % 7 WHEN 0 THEN '$' || a WHEN 1 THEN '(' || a || ')' WHEN 2 THEN l_quantity::INT::VARCHAR || '%' WHEN 3 THEN '—' WHEN 4 THEN a || ' CR' WHEN 5 THEN a || '-' ELSE a || 'DR' END AS cell FROM m)"""
DUCK_NUM = """CASE WHEN regexp_matches({c}, '[A-Za-z]') THEN NULL WHEN regexp_full_match(regexp_replace({c}, '[^0-9.\\-]', '', 'g'), '-?([0-9]+[.]?[0-9]*|[.][0-9]+)')
  THEN CASE WHEN contains({c}, '(') AND contains({c}, ')') THEN -abs(regexp_replace({c}, '[^0-9.\\-]', '', 'g')::DOUBLE) ELSE regexp_replace({c}, '[^0-9.\\-]', '', 'g')::DOUBLE END END"""


@query(f"WITH {MONEY} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cell, {DUCK_NUM.format(c='cell')} AS value FROM c")
def parse_num(spark, sf_dir):
    return money(load(spark, sf_dir, "lineitem")).select(*KEY, "cell", N.parse_num(F.col("cell")).alias("value"))


@query(f"""WITH {MONEY} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN cell LIKE '(%)' THEN '-' || cell[2:-2] WHEN cell LIKE '% CR' THEN '-' || cell[:-4]
 WHEN cell LIKE '%DR' THEN cell[:-3] WHEN cell LIKE '%-' THEN '-' || cell[:-2] ELSE cell END AS fixed FROM c""")
def sign_fix(spark, sf_dir):
    return money(load(spark, sf_dir, "lineitem")).select(*KEY, N.sign_fix(F.col("cell")).alias("fixed"))


@query(f"""WITH {MONEY}, n AS (SELECT *, regexp_replace(regexp_replace(cell, '[$,%() ]', '', 'g'), '[$,%() ]', '', 'g') AS s FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN regexp_full_match(s, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN CASE WHEN cell LIKE '(%)' THEN -abs(s::DOUBLE) ELSE s::DOUBLE END END AS cell_value,
 CASE WHEN regexp_full_match(s, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN CASE WHEN cell LIKE '(%)' THEN -(s::DOUBLE) ELSE s::DOUBLE END END AS plain_value FROM n""")
def parse_cell(spark, sf_dir):
    return money(load(spark, sf_dir, "lineitem")).select(*KEY, N.parse_cell(F.col("cell")).alias("cell_value"), N.parse_plain(F.col("cell")).alias("plain_value"))


@query(f"""WITH {MONEY} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE l_linenumber % 7 WHEN 3 THEN NULL WHEN 2 THEN l_quantity::INT::DOUBLE ELSE CASE WHEN l_linenumber % 7 IN (1, 4, 5) THEN -1 ELSE 1 END * replace(a, ',', '')::DOUBLE END AS value,
 l_linenumber % 7 IN (1, 4, 5) AS negative, l_linenumber % 7 = 2 AS percent, l_linenumber % 7 = 0 AS currency FROM c WHERE l_linenumber % 7 <> 3""")
def parse_number(spark, sf_dir):
    parsed = money(load(spark, sf_dir, "lineitem")).withColumn("n", N.parse_number(F.col("cell"))).where("n IS NOT NULL")
    return parsed.select(*KEY, "n.value", "n.negative", "n.percent", "n.currency")


@query("""WITH p AS (SELECT p_partkey, p_name || ' . . . .  ' || p_size || '......' AS s FROM part)
SELECT p_partkey, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '\\.+$', '')), lambda w: w <> ''), ' ') AS cleaned FROM p""")
def clean_cell(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("s", F.concat("p_name", F.lit(" . . . .  "), F.col("p_size").cast("string"), F.lit("......")))
    return p.select("p_partkey", X.clean_cell(F.col("s")).alias("cleaned"))


@query("""WITH p AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Total ' || c_mktsegment WHEN 1 THEN 'Sumitomo' WHEN 2 THEN 'Net income' WHEN 3 THEN 'Interest expense, net' WHEN 4 THEN 'Gross profit (loss)' WHEN 5 THEN 'Sub-total' WHEN 6 THEN 'sum: ' || c_name ELSE c_mktsegment END AS label FROM customer),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM p)
SELECT c_custkey, label, contains(lower(label), 'excluding certain items') OR contains(lower(label), 'grand total') OR contains(lower(label), 'gross profit') OR contains(lower(label), 'subtotal')
 OR list_has_any(ws, ['total', 'sum']) OR coalesce(ws[1] = 'net', false) AS is_total FROM w""")
def total_label(spark, sf_dir):
    k = F.col("c_custkey") % 8
    label = F.when(k == 0, F.concat(F.lit("Total "), "c_mktsegment")).when(k == 1, "Sumitomo").when(k == 2, "Net income").when(k == 3, "Interest expense, net").when(k == 4, "Gross profit (loss)").when(k == 5, "Sub-total")
    label = label.when(k == 6, F.concat(F.lit("sum: "), "c_name")).otherwise(F.col("c_mktsegment"))
    return load(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), X.is_total_label(label).alias("is_total"))


def order_table(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each order as a table: a header, its lines as data rows, every fourth row their total (off where the order divides by 7)."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    row = lambda at, name, amount: F.struct(at.cast("int").alias("row"), name.alias("name"), amount.cast("string").alias("amount"))

    def part(p):
        some = F.slice("x", p * 3 + 1, F.lit(3))
        data = F.transform(some, lambda v, i: row(p * 4 + i + 1, F.concat(F.lit("Part "), v.l_partkey.cast("string")), v.q))
        total = F.aggregate(some, F.lit(0), lambda a, v: a + v.q) + F.when(F.col("table_id") % 7 == 0, 5).otherwise(0)
        return F.concat(data, F.when(F.size(some) == 3, F.array(row(p * 4 + 4, F.lit("Total"), total))).otherwise(F.slice(data, 1, 0)))

    head = F.array(row(F.lit(0), F.lit("Item"), F.lit("Amount")))
    rows = lines.select("table_id", F.concat(head, F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size("x") / 3).cast("int") - 1), part))).alias("rows"))
    tables = rows.select("table_id", F.size("rows").alias("n_rows"), F.lit(2).alias("n_cols"))
    cells = rows.select("table_id", F.explode("rows").alias("r")).select("table_id", "r.row", F.posexplode(F.array("r.name", "r.amount")).alias("col", "text"))
    return tables, cells.withColumns({"ord": F.col("row") * 2 + F.col("col"), "is_header": F.col("row") == 0})


ORDERS = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, l_quantity::INT AS q FROM lineitem),
tt AS (SELECT l_orderkey, i // 3 AS part, sum(q)::BIGINT AS s, count(*) AS n FROM li GROUP BY 1, 2),
tot AS (SELECT l_orderkey, part, s, CASE WHEN l_orderkey % 7 = 0 THEN s + 5 ELSE s END AS t, part * 4 + 4 AS row FROM tt WHERE n = 3)"""


@query(f"""WITH {ORDERS} SELECT l_orderkey AS table_id, row::INT AS row, t::DOUBLE AS total, s::DOUBLE AS sum, abs(s - t) <= 0.06 OR abs(s - t) / greatest(abs(t), 1) <= 0.01 AS ok FROM tot""")
def reconcile(spark, sf_dir):
    return T.reconcile(T.model(*order_table(spark, sf_dir))).select("table_id", "row", "total", "sum", "ok")


@query(f"""WITH {ORDERS}, k AS (SELECT l_orderkey, bool_and(abs(s - t) > 0.06 AND abs(s - t) / greatest(abs(t), 1) > 0.01) AS f, bool_or(abs(s - t) > 0.06 AND abs(s - t) / greatest(abs(t), 1) > 0.01) AS f1 FROM tot GROUP BY 1)
SELECT DISTINCT li.l_orderkey AS table_id, coalesce(f1, false) AS flagged, CASE WHEN coalesce(f1, false) THEN NULL WHEN k.l_orderkey IS NULL THEN 0.60 ELSE 0.97 END::DOUBLE AS confidence, CASE WHEN f1 THEN 'Error' END AS severity FROM li LEFT JOIN k USING (l_orderkey)""")
def arithmetic_check(spark, sf_dir):
    tables, cells = order_table(spark, sf_dir)
    return D.arithmetic(tables, T.model(tables, cells)).select("table_id", "flagged", "confidence", "severity")


@query(f"""WITH {ORDERS}, x AS (SELECT l_orderkey, 0 AS row, 'Header' AS row_kind FROM (SELECT DISTINCT l_orderkey FROM li) UNION ALL SELECT l_orderkey, i + i // 3 + 1, 'Data' FROM li UNION ALL SELECT l_orderkey, row, 'Total' FROM tot)
SELECT l_orderkey AS table_id, row::INT AS row, row_kind FROM x""")
def row_kinds(spark, sf_dir):
    return T.row_kinds(T.model(*order_table(spark, sf_dir)))


@query(f"WITH {ORDERS}, o AS (SELECT DISTINCT l_orderkey FROM li) SELECT l_orderkey AS table_id, col::INT AS col, CASE col WHEN 0 THEN 'Label' ELSE 'Numeric' END AS col_type FROM o, (VALUES (0), (1)) c(col)")
def col_types(spark, sf_dir):
    return T.column_types(T.model(*order_table(spark, sf_dir)))


@query(f"""WITH {ORDERS}, k AS (SELECT l_orderkey, bool_or(abs(s - t) > 0.06 AND abs(s - t) / greatest(abs(t), 1) > 0.01) AS bad FROM tot GROUP BY 1)
SELECT DISTINCT li.l_orderkey AS table_id, CASE WHEN bad THEN 'Suspect' WHEN k.l_orderkey IS NOT NULL THEN 'Confirmed' ELSE 'NoIssues' END AS impression FROM li LEFT JOIN k USING (l_orderkey)""")
def assess(spark, sf_dir):
    tables, cells = order_table(spark, sf_dir)
    # six signals read the model: it is worked out once and read back by column
    return D.assess(tables, saved(T.model(tables, cells), "model")).select("table_id", "impression")


def gappy(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = load(spark, sf_dir, "orders")
    cells = orders.select(F.floor(F.col("o_orderkey") / 200).alias("table_id"), (F.col("o_orderkey") % 50).cast("int").alias("row"), (F.col("o_custkey") % 4).cast("int").alias("col"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("text"), F.lit(False).alias("is_header"))
    tables = cells.select("table_id").distinct().withColumns({"n_rows": F.lit(50), "n_cols": F.lit(4)})
    return tables, cells


@query("""WITH c AS (SELECT o_orderkey // 200 AS t, o_orderkey % 50 AS r, o_custkey % 4 AS c, arg_max(o_orderstatus, o_orderkey) AS x FROM orders GROUP BY 1, 2, 3)
SELECT t.t AS table_id, r.r::INT AS row, k.c::INT AS col, coalesce(c.x, '') AS text FROM (SELECT DISTINCT o_orderkey // 200 AS t FROM orders) t, range(50) r(r), range(4) k(c) LEFT JOIN c ON c.t = t.t AND c.r = r.r AND c.c = k.c""")
def dense_grid(spark, sf_dir):
    return T.dense_grid(*gappy(spark, sf_dir)).select("table_id", "row", "col", "text")


@query(f"""WITH {BOXED} SELECT p.doc, p.page, p.l_orderkey AS a_order, p.l_linenumber AS a_line, p.l_partkey AS a_part, p.l_suppkey AS a_supp, q.l_orderkey AS b_order, q.l_linenumber AS b_line, q.l_partkey AS b_part, q.l_suppkey AS b_supp,
 round({duck_iou('p', 'q')}::DOUBLE, 5) AS iou FROM b p JOIN b q ON p.doc = q.doc AND p.page = q.page AND (p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey) < (q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey) WHERE {duck_iou('p', 'q')} > 0.1::FLOAT""")
def overlap_pairs(spark, sf_dir):
    key = F.struct(*KEY)
    regions = boxed(load(spark, sf_dir, "lineitem")).select("doc", "page", key.alias("ord"), F.lit("Table").alias("role"), "bbox")
    out = D.region_pairs(regions)
    side = lambda s, n: [F.col(f"{s}.{k}").alias(f"{n}_{k[2:].replace('key', '').replace('linenumber', 'line')}") for k in KEY]
    return out.select("doc", "page", *side("i", "a"), *side("j", "b"), F.round(F.col("iou").cast("double"), 5).alias("iou"))


def split_boxes(spark, sf_dir):
    b = boxed(load(spark, sf_dir, "lineitem"))
    return b.where("l_linenumber % 2 = 0"), b.where("l_linenumber % 2 = 1").withColumn("region_id", F.struct(*KEY)).withColumn("role", F.when(F.col("l_partkey") % 5 == 0, "Other").otherwise("Table"))


IN_REGION = "(s.x0 + s.x1) / 2::FLOAT BETWEEN r.x0 AND r.x1 AND (s.y0 + s.y1) / 2::FLOAT BETWEEN r.y0 AND r.y1"


@query(f"""WITH {BOXED} SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_suppkey, count(*)::BIGINT AS n_regions FROM b s JOIN b r ON s.doc = r.doc AND s.page = r.page AND s.l_linenumber % 2 = 0 AND r.l_linenumber % 2 = 1 AND {IN_REGION} GROUP BY ALL""")
def span_in_region(spark, sf_dir):
    spans, regions = split_boxes(spark, sf_dir)
    return R.spans_in_regions(spans, regions).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_regions"))


@query(f"""WITH {BOXED} SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_suppkey FROM b s WHERE s.l_linenumber % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b r WHERE s.doc = r.doc AND s.page = r.page AND r.l_linenumber % 2 = 1 AND r.l_partkey % 5 <> 0 AND {IN_REGION})""")
def orphan_spans(spark, sf_dir):
    return R.orphans(*split_boxes(spark, sf_dir)).select(*KEY)


@query(f"""WITH {BOXED}, k AS (SELECT r.doc, r.page, count(DISTINCT (r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey)) AS n FROM b r JOIN b s ON s.doc = r.doc AND s.page = r.page AND s.l_linenumber % 2 = 0 AND r.l_linenumber % 2 = 1 AND {duck_iou('r', 's')} >= 0.7::FLOAT GROUP BY 1, 2)
SELECT r.doc, r.page, count(*)::BIGINT AS n, round(coalesce(any_value(k.n), 0) / count(*), 6) AS agreement FROM b r LEFT JOIN k ON k.doc = r.doc AND k.page = r.page WHERE r.l_linenumber % 2 = 1 GROUP BY 1, 2""")
def boundary_agreement(spark, sf_dir):
    blocks, regions = split_boxes(spark, sf_dir)
    return R.agreement(regions, blocks).select("doc", "page", "n", F.round("agreement", 6).alias("agreement"))


@query(f"""WITH {BOXED}, p AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq FROM b),
n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, doc, page, (x0 + 1)::FLOAT AS x0, y0, (x1 + 1)::FLOAT AS x1, y1 FROM b WHERE l_linenumber % 3 = 0),
m AS (SELECT n.l_orderkey, n.l_linenumber, n.l_partkey, n.l_suppkey, p.seq, {duck_iou('n', 'p')} AS iou FROM n JOIN p ON n.doc = p.doc AND n.page = p.page AND p.l_linenumber % 3 <> 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(iou) >= 0.7::FLOAT AS reused, CASE WHEN max(iou) >= 0.7::FLOAT THEN 'e' || arg_max(seq, (iou, seq)) ELSE 'new' END AS element_id FROM m GROUP BY 1, 2, 3, 4
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, false, 'new' FROM n ANTI JOIN m USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def register_or_match(spark, sf_dir):
    b = boxed(load(spark, sf_dir, "lineitem")).withColumn("role", F.lit("Table"))
    prior = _numbered(b, "seq").where("l_linenumber % 3 <> 1").withColumn("element_id", F.concat(F.lit("e"), F.col("seq").cast("string")))
    one = F.lit(1).cast("float")
    new = b.where("l_linenumber % 3 = 0").withColumns({"region_id": F.struct(*KEY), "mint": F.lit("new"), "bbox": G.box(F.col("bbox.x0") + one, F.col("bbox.y0"), F.col("bbox.x1") + one, F.col("bbox.y1"))})
    out = R.register_or_match(new, prior)
    return out.select(*KEY, (F.col("element_id") != "new").alias("reused"), "element_id")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """df with its rank (from 1) by KEY over the whole frame: range-sorted parts, counted, then offset."""
    parts = df.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("_at", F.monotonically_increasing_id())
    parts = parts.withColumns({"_pid": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND((1 << 33) - 1)}).persist()
    first = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(first), F.lit(0))).drop("_n")
    return parts.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_first") + F.col("_i") + 1).drop("_at", "_pid", "_i", "_first")


@query(f"""WITH {BOXED} SELECT doc, page, count(*)::BIGINT AS n, round(quantile_cont(x0, 0.5)::DOUBLE, 4) AS x0, round(quantile_cont(y0, 0.5)::DOUBLE, 4) AS y0, round(quantile_cont(x1, 0.5)::DOUBLE, 4) AS x1, round(quantile_cont(y1, 0.5)::DOUBLE, 4) AS y1 FROM b GROUP BY 1, 2 HAVING count(*) >= 2""")
def merge_median(spark, sf_dir):
    out = L.merge_regions(boxed(load(spark, sf_dir, "lineitem")), ["doc", "page"])
    return out.select("doc", "page", "n", *(F.round(F.col(f"bbox.{s}").cast("double"), 4).alias(s) for s in G.SIDES))


def _interval_oracle(gap: int) -> str:
    return f"""WITH {BOXED}, o AS (SELECT doc, page, x0, x1, max(x1) OVER (PARTITION BY doc, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) - 1 AS band FROM o)
SELECT doc, page, band::BIGINT AS band, min(x0) AS low, max(x1) AS high FROM g GROUP BY 1, 2, 3"""


def _words(spark, sf_dir):
    return boxed(load(spark, sf_dir, "lineitem")).select("doc", "page", *(F.col(f"bbox.{s}").alias(s) for s in G.SIDES))


@query(_interval_oracle(6))
def column_intervals(spark, sf_dir):
    return L.column_intervals(_words(spark, sf_dir), ["doc", "page"])


@query(_interval_oracle(12))
def column_bands(spark, sf_dir):
    return L.column_bands(_words(spark, sf_dir), ["doc", "page"])


@query(f"""WITH RECURSIVE {BOXED}, s AS (SELECT doc, page, y0::DOUBLE AS y, row_number() OVER (PARTITION BY doc, page ORDER BY y0) AS i FROM (SELECT DISTINCT doc, page, y0 FROM b)),
r AS (SELECT doc, page, i, y AS anchor, 0 AS cluster FROM s WHERE i = 1 UNION ALL SELECT s.doc, s.page, s.i, CASE WHEN s.y - r.anchor <= 3 THEN r.anchor ELSE s.y END, CASE WHEN s.y - r.anchor <= 3 THEN r.cluster ELSE r.cluster + 1 END FROM r JOIN s ON s.doc = r.doc AND s.page = r.page AND s.i = r.i + 1)
SELECT DISTINCT doc, page, cluster::INT AS cluster, anchor FROM r""")
def row_clusters(spark, sf_dir):
    return L.anchor_clusters(_words(spark, sf_dir), ["doc", "page"], "y0", 3.0)


def registry_log(spark, sf_dir) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    obs = _numbered(li, "seq").select((F.col("l_orderkey") / 5).cast("long").alias("element_id"), F.col("l_linenumber").cast("int").alias("generation"), "seq", (F.col("l_returnflag") == "A").alias("is_manual"), F.concat(F.lit("a"), F.col("seq").cast("string")).alias("artifact_id"), "l_partkey")
    return obs


LOG = "o AS (SELECT (l_orderkey // 5)::BIGINT AS element_id, l_linenumber::INT AS generation, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq, l_returnflag = 'A' AS is_manual, l_partkey FROM lineitem)"


@query(f"WITH {LOG} SELECT element_id, generation, seq FROM o QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY generation DESC, seq) = 1")
def current_view(spark, sf_dir):
    return V.current_view(registry_log(spark, sf_dir)).select("element_id", "generation", "seq")


@query(f"""WITH {LOG} SELECT element_id, generation, seq, is_manual FROM o QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY CASE WHEN l_partkey % 97 = 0 THEN seq END NULLS LAST, is_manual DESC, generation DESC, seq DESC) = 1""")
def resolve(spark, sf_dir):
    log = registry_log(spark, sf_dir)
    verdicts = log.where("l_partkey % 97 = 0").select(F.col("artifact_id").alias("winner"), F.lit("Winner").alias("verdict"))
    return V.resolve(log, verdicts).select("element_id", "generation", "seq", "is_manual")


@query("""WITH p AS (SELECT l_orderkey, l_partkey, list_sort(list(DISTINCT l_suppkey)) AS ps FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_partkey, unnest(ps) AS parent, CASE WHEN len(ps) > 1 THEN 'Merge' ELSE 'Derive' END AS relation FROM p""")
def lineage_edges(spark, sf_dir):
    made = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("parents"))
    out = V.lineage_edges(made.withColumns({"artifact_id": F.struct("l_orderkey", "l_partkey"), "generation": F.lit(0)}))
    return out.select("child.l_orderkey", "child.l_partkey", "parent", "relation")


@query("""WITH d AS (SELECT doc_id, text, substr(text, 1, length(text) - length(text) // 5) || ' stray 1,234' AS parsed FROM documents),
s AS (SELECT doc_id, lower(regexp_replace(t, '[^\\p{L}\\p{N}.\\-%]', '', 'g')) AS tok FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS t FROM d)),
p AS (SELECT doc_id, lower(regexp_replace(t, '[^\\p{L}\\p{N}.\\-%]', '', 'g')) AS tok FROM (SELECT doc_id, unnest(regexp_split_to_array(parsed, '\\s+')) AS t FROM d)),
sc AS (SELECT doc_id, tok, count(*) AS n FROM s WHERE tok <> '' GROUP BY 1, 2), pc AS (SELECT doc_id, tok, count(*) AS m FROM p WHERE tok <> '' GROUP BY 1, 2)
SELECT doc_id AS table_id, sum(coalesce(n, 0))::BIGINT AS n_source, sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0))::BIGINT AS dropped, sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0))::BIGINT AS spurious FROM sc FULL JOIN pc USING (doc_id, tok) GROUP BY 1""")
def token_residual(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("table_id"), "text")
    parsed = docs.select("table_id", F.expr("substr(text, 1, length(text) - length(text) div 5) || ' stray 1,234'").alias("text"))
    return D.token_residual(docs, parsed).select("table_id", "n_source", "dropped", "spurious")


@query("""WITH p AS (SELECT a.p_partkey, a.p_name AS a, CASE a.p_partkey % 5 WHEN 0 THEN upper(a.p_name) || ' (a)' WHEN 1 THEN b.p_name WHEN 2 THEN '$' || a.p_size || ',000' WHEN 3 THEN '--' ELSE a.p_name END AS b0,
 CASE a.p_partkey % 5 WHEN 2 THEN a.p_size || '000' ELSE a.p_name END AS a0 FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1),
n AS (SELECT p_partkey, a0, coalesce(b0, '') AS b0, lower(regexp_replace(a0, '[^\\p{L}\\p{N}]', '', 'g')) AS x, lower(regexp_replace(coalesce(b0, ''), '[^\\p{L}\\p{N}]', '', 'g')) AS y FROM p)
SELECT p_partkey, CASE WHEN regexp_matches(a0, '[0-9]') AND NOT regexp_matches(a0, '\\p{L}') AND regexp_matches(b0, '[0-9]') AND NOT regexp_matches(b0, '\\p{L}') THEN regexp_replace(a0, '[^0-9]', '', 'g') = regexp_replace(b0, '[^0-9]', '', 'g')
 ELSE x = '' OR y = '' OR contains(x, y) OR contains(y, x) END AS agree FROM n""")
def contents_agree(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    b = F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" (a)"))).when(k == 1, F.col("other")).when(k == 2, F.concat(F.lit("$"), size, F.lit(",000"))).when(k == 3, "--").otherwise(F.col("p_name"))
    a = F.when(k == 2, F.concat(size, F.lit("000"))).otherwise(F.col("p_name"))
    return part.join(nxt, "p_partkey", "left").select("p_partkey", X.contents_agree(a, F.coalesce(b, F.lit(""))).alias("agree"))


@query("""WITH t AS (SELECT conv_id, turn, text, role FROM conversations), c AS (SELECT a.conv_id, a.turn, string_agg(b.text, ' ' ORDER BY b.turn) AS crop FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY 1, 2),
k AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || ' 9,999' END AS asserted FROM t)
SELECT k.conv_id, k.turn, coalesce(lower(regexp_replace(asserted, '[\\s,$]', '', 'g')) <> '' AND contains(lower(regexp_replace(crop, '[\\s,$]', '', 'g')), lower(regexp_replace(asserted, '[\\s,$]', '', 'g'))), false) AS supported FROM k JOIN c USING (conv_id, turn)""")
def answer_support(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.lit(1).alias("page"), F.col("turn").alias("ord"), "text")
    spans = turns.withColumn("bbox", G.box(0, F.col("ord") * 10, 100, F.col("ord") * 10 + 8))
    asserted = F.when(F.col("ord") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" 9,999")))
    claims = spans.select(F.struct("doc", "ord").alias("claim_id"), "doc", "page", G.box(F.lit(0), F.col("ord") * 10 - 10, F.lit(100), F.col("ord") * 10 + 18).alias("bbox"), asserted.alias("asserted"))
    return D.answer_support(claims, spans).select(F.col("claim_id.doc").alias("conv_id"), F.col("claim_id.ord").alias("turn"), "supported")


@query("""WITH l AS (SELECT doc_id, quality = 0 AS wrong, toxic = 1 AS flagged FROM labels)
SELECT count(*)::BIGINT AS n_tables, count(*) FILTER (wrong)::BIGINT AS n_wrong, round(count(*) FILTER (wrong AND flagged) / nullif(count(*) FILTER (wrong), 0), 6) AS catch_rate, round(count(*) FILTER (NOT wrong AND flagged) / nullif(count(*) FILTER (NOT wrong), 0), 6) AS false_alarm_rate, count(*) FILTER (wrong AND flagged)::BIGINT AS caught FROM l""")
def catch_metrics(spark, sf_dir):
    flagged = F.when(F.col("toxic") == 1, F.array(F.lit("answer_support"))).otherwise(F.array().cast("array<string>"))
    evals = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name"), F.lit(True).alias("matched"), (F.col("quality") == 0).alias("wrong"), flagged.alias("flagged_by"))
    out = D.catch_metrics(evals)
    return out.select("n_tables", "n_wrong", F.round("catch_rate", 6).alias("catch_rate"), F.round("false_alarm_rate", 6).alias("false_alarm_rate"), F.col("caught_answer_support").alias("caught"))


@query("""SELECT page_id, CASE WHEN length(html) % 400 >= 150 THEN 'text' WHEN page_id % 20 < 5 THEN 'blank' WHEN length(html) % 400 < 25 THEN 'image_content' ELSE 'text' END AS klass FROM pages""")
def triage_class(spark, sf_dir):
    from spandrel.operators.triage import page_class

    return load(spark, sf_dir, "pages").select("page_id", page_class(F.length("html") % 400, (F.col("page_id") % 20).cast("double")).alias("klass"))


ELEMENTS = "e AS (SELECT conv_id, turn AS ord, text, CASE turn % 5 WHEN 0 THEN 'Heading' WHEN 3 THEN 'ListItem' ELSE 'Paragraph' END AS role FROM conversations)"


def elements(spark, sf_dir) -> DataFrame:
    k = F.col("turn") % 5
    return load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text", F.when(k == 0, "Heading").when(k == 3, "ListItem").otherwise("Paragraph").alias("role"), F.lit(1).alias("page"))


@query(f"""WITH {ELEMENTS}, s AS (SELECT *, sum((role = 'Heading')::INT) OVER (PARTITION BY conv_id ORDER BY ord) AS section FROM e)
SELECT conv_id, ord, section::BIGINT AS section, first_value(CASE WHEN role = 'Heading' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, section ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS heading FROM s""")
def sections(spark, sf_dir):
    return M.sections(elements(spark, sf_dir), ["conv_id"]).select("conv_id", "ord", "section", "heading")


@query(f"WITH {ELEMENTS} SELECT conv_id, string_agg(CASE role WHEN 'Heading' THEN '## ' || text WHEN 'ListItem' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY ord) AS markdown FROM e GROUP BY 1")
def document_markdown(spark, sf_dir):
    return M.document_markdown(elements(spark, sf_dir), ["conv_id"])


@query("SELECT lang, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND lang IS NOT NULL GROUP BY ALL")
def enrichment_cache(spark, sf_dir):
    """What no good label covers yet is still to be enriched."""
    docs = load(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.col("doc_id").alias("source")).where("kind IS NOT NULL").distinct()
    labels = load(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("source"))
    return V.enrichment_work(docs, docs.join(labels, "source", "left_semi")).select(F.col("kind").alias("lang"), F.col("source").alias("doc_id"))


@query("SELECT doc_id, 'art_' || substr(sha256(text), 1, 12) || '_' || (doc_id % 3) AS artifact_id FROM documents")
def content_hash(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.content_id(F.col("text"), F.col("doc_id") % 3).alias("artifact_id"))


def sheet(spark, sf_dir) -> DataFrame:
    """Orders as sheets of mixed cells: a date section row before each block of lines, a price and a quantity column."""
    tables, cells = order_table(spark, sf_dir)
    return saved(T.model(tables, cells), "model")  # types, names and values each read it


@query(f"""WITH {ORDERS}, x AS (SELECT l_orderkey AS table_id, i + i // 3 AS row, 'Part ' || l_partkey AS name, q::DOUBLE AS value FROM li UNION ALL SELECT l_orderkey, row - 1, 'Total', t::DOUBLE FROM tot)
SELECT table_id, row::BIGINT AS row, 'Amount' AS variable, name AS item, value FROM x""")
def melt_table(spark, sf_dir):
    grid = sheet(spark, sf_dir)
    out = Y.melt(Y.materialize(grid), Y.column_names(grid))
    return out.select("table_id", F.col("row").cast("long").alias("row"), "variable", F.col("ids")["Item"].alias("item"), "value")


@query(f"WITH {ORDERS}, o AS (SELECT DISTINCT l_orderkey FROM li) SELECT l_orderkey AS table_id, col::INT AS col, CASE col WHEN 0 THEN 'Item' ELSE 'Amount' END AS name, CASE col WHEN 0 THEN 'Text' ELSE 'Int' END AS dtype FROM o, (VALUES (0), (1)) c(col)")
def materialize_types(spark, sf_dir):
    return Y.plain_types(sheet(spark, sf_dir))


@query("""WITH o AS (SELECT o_custkey AS table_id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
s AS (SELECT *, CASE WHEN i % 3 = 2 THEN o_orderpriority END AS head FROM o), n AS (SELECT table_id, count(*) FILTER (i % 3 = 2) AS heads, max(CASE WHEN i % 3 = 2 THEN i END) AS furthest FROM o GROUP BY 1)
SELECT table_id, i::INT AS row, 'k' || o_orderkey AS label, CASE WHEN heads > 0 AND furthest > heads THEN coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY i ROWS UNBOUNDED PRECEDING), '') END AS section
FROM s JOIN n USING (table_id) QUALIFY head IS NULL""")
def section_promote(spark, sf_dir):
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), i.alias("row"), "o_orderkey", "o_orderpriority")
    head = F.col("row") % 3 == 2
    rows = o.select("table_id", "row", F.posexplode(F.array(F.when(head, F.col("o_orderpriority")).otherwise(F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))), F.when(head, "").otherwise(F.col("o_orderkey").cast("string")))).alias("col", "text"))
    grid = rows.withColumn("header_rows", F.lit(1))
    return Y.promote_sections(grid).where("col = 0").select("table_id", "row", F.col("text").alias("label"), "section")


@query("""WITH d AS (SELECT doc_id, source, CASE WHEN n_chars < 800 THEN 0 WHEN n_chars < 2000 THEN 1 WHEN n_chars < 6000 THEN 2 ELSE 3 END AS tier FROM documents), t(tier, seconds) AS (VALUES (0, 0.05), (1, 0.1), (2, 2.5), (3, 1.25)),
x AS (SELECT d.doc_id, d.tier AS resolved, t.tier, t.seconds FROM d JOIN t ON t.tier <= d.tier)
SELECT doc_id, tier::INT AS tier, tier = resolved AS resolved, round(sum(seconds) OVER (PARTITION BY doc_id ORDER BY tier)::DOUBLE, 6) AS seconds FROM x""")
def trajectory_cost(spark, sf_dir):
    from spandrel.plans.trajectory import cascade

    n = F.col("n_chars")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.when(n < 800, 0).when(n < 2000, 1).when(n < 6000, 2).otherwise(3).alias("tier"))
    return cascade(docs, "doc_id", "tier", [0.05, 0.1, 2.5, 1.25]).select("doc_id", "tier", "resolved", F.round("seconds", 6).alias("seconds"))


@query("""SELECT p_partkey, p_name AS got, CASE p_partkey % 3 WHEN 0 THEN '$ ' || upper(p_name) ELSE p_name || ' x' END AS want FROM part WHERE p_partkey % 3 <> 0""")
def grid_diff(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    base = part.select(F.col("p_partkey").alias("table_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("p_name").alias("text"))
    want = F.when(F.col("table_id") % 3 == 0, F.concat(F.lit("$"), F.upper("text"))).otherwise(F.concat("text", F.lit(" x")))
    return D.grid_diff(base, base.withColumn("text", want)).select(F.col("table_id").alias("p_partkey"), "got", "want")


@query()
def structure_words(spark, sf_dir):
    words = _words(spark, sf_dir).withColumns({"text": F.concat(F.lit("w"), F.col("x0").cast("int").cast("string")), "ord": F.xxhash64("x0", "y0", "x1", "y1")})
    return L.structure_words(words, ["doc", "page"])


@query()
def xy_cut(spark, sf_dir):
    words = _words(spark, sf_dir).withColumns({"text": F.lit("w"), "ord": F.xxhash64("x0", "y0", "x1", "y1")})
    return L.xy_cut(words, ["doc", "page"])


@query("""WITH d AS (SELECT doc_id, n_chars % 40 AS n FROM documents), k AS (SELECT doc_id, n, unnest(CASE WHEN n <= 5 THEN range(1, n + 1) ELSE list_distinct(list_transform(range(0, 5), lambda i: (round_even(i * (n - 1) / 4, 0) + 1)::BIGINT)) END) AS page FROM d)
SELECT doc_id, page::INT AS page FROM k""")
def even_pages(spark, sf_dir):
    from spandrel.operators import corpus

    docs = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 40).alias("n_pages"))
    return corpus.even_pages(docs, 5, "doc_id")


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def top_per_group(spark, sf_dir):
    from spandrel.operators import corpus

    return corpus.top_per_group(load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 3)


@query("""SELECT source AS doc, lang AS stage, sum(n_chars)::BIGINT AS ms, count(*)::BIGINT AS n, grouping(source, lang)::BIGINT AS level, round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 6) AS share
FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())""")
def stage_totals(spark, sf_dir):
    from spandrel.operators import corpus

    timings = load(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("lang").alias("stage"), F.col("n_chars").alias("ms"))
    return corpus.stage_totals(timings).withColumn("share", F.round("share", 6))


@query("""WITH l AS (SELECT doc_id % 50 AS doc, doc_id % 7 AS page, toxic = 1 AS figure, CASE quality WHEN 1 THEN 'Confirmed' ELSE 'Suspect' END AS impression FROM labels), p AS (SELECT DISTINCT doc_id % 50 AS doc, doc_id % 11 AS page FROM documents)
SELECT p.doc, p.page, CASE WHEN count(l.doc) = 0 THEN 'missing' WHEN bool_or(figure) THEN 'figure' WHEN bool_or(impression = 'Suspect') THEN 'suspect' WHEN bool_or(impression = 'Confirmed') THEN 'confirmed' ELSE 'ok' END AS status
FROM p LEFT JOIN l ON l.doc = p.doc AND l.page = p.page GROUP BY 1, 2""")
def page_status(spark, sf_dir):
    from spandrel.operators import corpus

    labels = load(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("doc"), (F.col("doc_id") % 7).alias("page"), (F.col("toxic") == 1).alias("figure"), F.when(F.col("quality") == 1, "Confirmed").otherwise("Suspect").alias("impression"))
    pages = load(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("doc"), (F.col("doc_id") % 11).alias("page"))
    return corpus.page_status(pages, labels)


@query("""SELECT doc, page, cost, (sum(cost) OVER w)::BIGINT AS done, (sum(cost) OVER w - cost)::BIGINT AS start FROM (SELECT doc_id // 100 AS doc, doc_id AS page, n_chars AS cost FROM documents) WINDOW w AS (PARTITION BY doc ORDER BY cost, page ROWS UNBOUNDED PRECEDING)""")
def cheapest_first(spark, sf_dir):
    from spandrel.operators import corpus

    pages = load(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("doc"), F.col("doc_id").alias("page"), F.col("n_chars").alias("cost"))
    return corpus.cheapest_first(pages, "cost")


@query("""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\(?[0-9][0-9,]*\\)?')) AS t FROM documents), b AS (SELECT doc_id, unnest(regexp_extract_all(substr(text, 1, length(text) - length(text) // 2), '\\(?[0-9][0-9,]*\\)?')) AS t FROM documents),
x AS (SELECT doc_id, regexp_replace(t, '[^0-9]', '', 'g') AS t, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT doc_id, regexp_replace(t, '[^0-9]', '', 'g') AS t, count(*) AS m FROM b GROUP BY 1, 2)
SELECT doc_id AS table_id, sum(coalesce(n, 0))::BIGINT AS n_a, sum(coalesce(m, 0))::BIGINT AS n_b, sum(abs(coalesce(n, 0) - coalesce(m, 0)))::BIGINT AS differ FROM x FULL JOIN y USING (doc_id, t) GROUP BY 1""")
def number_difference(spark, sf_dir):
    from spandrel.operators import corpus

    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("table_id"), "text")
    half = docs.select("table_id", F.expr("substr(text, 1, length(text) - length(text) div 2)").alias("text"))
    return corpus.number_difference(docs, half).drop("hint")
