"""Mixing sources to target weights.

Every row gets a hash-random key; rows are range-sorted by (source, key) and a distributed prefix sum of their sizes
places each row in its source's sequence. A source's budget is whole epochs of the sequence plus an exact cut through a
further one, so the last row may be taken in part.

Defined results: a null or wordless text has size 0 and takes 0; a null source is a source of its own, last in order;
repeated rows are separate rows; rows that share an id, or have none, are ordered by their size and a checksum of their
text, so reruns agree whatever the order of the input (rows alike in source, id and text may swap places); an empty table
gives an empty result; columns named like the outputs are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import lean, read, release, save, small_table, sorted_parts

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
MOST_SOURCES = 100_000
OUTPUTS = ("size", "source_size", "target", "taken")
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, check: Column) -> Column:
    """By id alone; rows without one are told apart by the checksum, or they would all have the same key."""
    return F.substring(F.md5(F.concat(F.lit(SEED), F.lit(":"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("#"), check.cast("string")), F.lit("")))), 1, 16)


def targets(sizes: dict, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> dict:
    """Share the sum of all sizes by weight; a share stops at `most` times its source's size and the rest is reshared."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, out, open_ = sum(sizes.values()), {}, list(names)
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        rest -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def _running(batches):
    """Adds _before: the sizes of the rows of the same source that came earlier in this sorted partition."""
    source, total = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(batch.schema.get_field_index("source")).to_pylist()
        size = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.zeros(len(size), np.int64)
        starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(starts, starts[1:]):
            if names[a] != source:
                source, total = names[a], 0
            sums = np.cumsum(size[a:b])
            before[a:b] = total + sums - size[a:b]
            total += int(sums[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, "_before"])


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", size: str | None = None, check: str | None = None) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes, repeats counted).

    size and check: ready columns with the text's word count and a checksum, used instead of the text. One row per source,
    MOST_SOURCES at most, is gathered on the driver to set the targets; all else stays distributed.
    """
    spark = docs.sparkSession
    checksum = F.col(check) if check else F.xxhash64(text) if size is None else F.lit(0)
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), (F.col(size) if size else word_count(F.col(text))).alias("size"), F.col(source).alias("source"),
        random_key(F.col(doc_id), checksum).alias("key"), F.col(doc_id).alias("id"), checksum.alias("check"),
    )
    # totals, the sort's sample and the sort itself all read the sizes: texts are counted once
    ready = sized if size else save(sized, "sized")
    totals = {r["source"]: r["n"] for r in ready.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    aims = targets(totals)
    parts = sorted_parts(ready, F.col("source").asc_nulls_last(), "key", "id", "size", "check").drop("_i", "key", "id", "check")
    parts = save(parts.mapInArrow(lean(_running), T.StructType([*parts.schema, T.StructField("_before", T.LongType())])), "mix")
    if ready is not sized:
        release(ready)

    runs = parts.groupBy("_pid", "source").agg(F.sum("size").alias("n"))  # as many rows as partitions and sources together
    first = runs.selectExpr("_pid AS _p", "source AS _source", "coalesce(sum(n) OVER (PARTITION BY source ORDER BY _pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _first")
    rows = [(s, totals[s], aims[s], *divmod(round(aims[s]), max(totals[s], 1))) for s in totals]
    plan = small_table(spark, "_name string, source_size long, target double, _epochs long, _rest long", rows)
    first = first.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_name")))
    out = parts.join(F.broadcast(first), (F.col("_pid") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_first") - F.col("_before")))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in OUTPUTS]
    return out.select(*kept, "size", "source_size", "target", (F.col("size") * F.col("_epochs") + part).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    narrow = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("n"), F.xxhash64("text").alias("check")), "sizes")
    return mix(narrow, size="n", check="check").select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT source, n, CASE i % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, source) AS j, sum(3 * n) OVER (ORDER BY 3 * n / w, source) - 3 * n AS cap,
             sum(w) OVER () - sum(w) OVER (ORDER BY 3 * n / w, source) + w AS wl, sum(n) OVER () AS total FROM w),
f AS (SELECT ((total - cap)::BIGINT)::DOUBLE / wl::BIGINT AS share FROM o WHERE ((total - cap)::BIGINT)::DOUBLE / wl::BIGINT * w <= 3 * n ORDER BY j LIMIT 1),
t AS (SELECT source, n, coalesce(least((SELECT share FROM f) * w, (3 * n)::DOUBLE), (3 * n)::DOUBLE) AS target FROM w),
p AS (SELECT d.doc_id, d.size, t.n AS source_size, t.target, round_even(t.target, 0)::BIGINT AS aim,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (aim // greatest(source_size, 1)) + greatest(0, least(size, aim % greatest(source_size, 1) - before)))::BIGINT AS taken FROM p
"""
