"""Shared helpers of the corpus operators: tables in the shared folder, distributed ranks and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: An Arrow batch ends at so many rows or bytes, whichever comes first; a longer row is a batch of its own.
BATCH_ROWS = 4000
BATCH_BYTES = 4 << 20


#: Caches of scratch arrays that a task leaves behind.
SCRATCH: list = []


def lean(run):
    """run(batches) that hands its memory back when a task ends: Python workers live on and would keep their peak."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())  # what is freed goes back at once
        yield from run(batches)
        for cached in SCRATCH:
            cached.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return wrapped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches. The setting stays: Spark reads it when a plan runs, which is after we return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh temporary one only on one machine where none is set (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spandrel-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there, and lost executors cost no recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    SAVED.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


#: Folders of saved tables that are still there.
SAVED: set = set()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    SAVED.discard(path)


def release(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more: what was made of them has to be saved itself."""
    for table in tables:
        _delete(table.sparkSession, table.saved_at)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this process has saved. Results not written or collected yet can't be read afterwards."""
    for path in list(SAVED):
        _delete(spark, path)


def small_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A frame of a few rows from the driver, by Arrow: rows as Python objects would start Python workers to be read."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(fields)}))


def sorted_parts(df: DataFrame, *order) -> DataFrame:
    """df range-partitioned and sorted by `order`, with columns _pid (rank of the partition) and _i (row within it)."""
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return at.withColumns({"_pid": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")


def ranked(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with column `out`: the row's place (from 0) in the order of `order`, found without one task seeing all rows.

    Rows are range-partitioned and sorted once and saved; each partition's row count (one row per partition) gives the
    offsets. `order` should end in a unique column: equal keys may otherwise fill one partition.
    """
    parts = save(sorted_parts(df, *order), "ranked")
    counts = sorted((r["_pid"], r["n"]) for r in parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    first, offsets = 0, []
    for pid, n in counts:
        offsets.append((pid, first))
        first += n
    table = small_table(df.sparkSession, "_pid long, _first long", offsets)
    # one row per partition of the sort: its size is that of the partition list, not of the data
    return parts.join(F.broadcast(table), "_pid").withColumn(out, F.col("_first") + F.col("_i")).drop("_pid", "_i", "_first")


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of docs, and all others inside one struct, where their names clash with nothing."""
    others = [c for c in docs.columns if c not in names]
    rest = "_rest"
    while rest in docs.columns:
        rest += "_"
    return docs.select(*names, F.struct(F.lit(None).cast("boolean").alias("_"), *(F.col(f"`{c}`") for c in others)).alias(rest))


def unpacked(found: DataFrame, columns: list[str], **made) -> DataFrame:
    """The columns that packed was given, in their order, and those of `made` (new, or in place of one of the same name)."""
    rest = max((c for c in found.columns if c.rstrip("_") == "_rest"), key=len)
    inside = found.schema[rest].dataType.names[1:]
    own = {c: F.col(rest)[c] if c in inside else F.col(f"`{c}`") for c in columns}
    return found.select(*(c.alias(name) for name, c in (own | made).items()))


def told_apart(docs: DataFrame, out: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with column `out`, a number for each different (id, text), in the order of ids; null where the id is.

    It is the id itself unless an id has several texts: then the place of (id, hash of the text) among all of them.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_p"), F.xxhash64(F.lit(1), F.reverse(text)).alias("_q")).where("_id IS NOT NULL")
    rows, different = ids.agg(F.count("_id"), F.count_distinct("_id")).first()
    if rows > different:
        texts = save(ids.distinct(), "texts")
        rows, different = texts.agg(F.count("_id"), F.count_distinct("_id")).first()
    if rows == different:
        return docs.withColumn(out, F.col(doc_id).cast("long"))
    places = ranked(texts, [F.col("_id"), F.col("_p"), F.col("_q")], out)
    keyed = docs.withColumns({"_id": F.col(doc_id).cast("long"), "_p": F.xxhash64(text), "_q": F.xxhash64(F.lit(1), F.reverse(text))})
    return save(keyed.join(places, ["_id", "_p", "_q"], "left").drop("_id", "_p", "_q"), "apart")


#: Ids with more edges than this, and than one in 2**HUB_BITS of all edges, are dealt over several tasks.
HUB = 256
HUB_BITS = 13


#: Ids in the middle (with neighbours above and below) up to this many travel by broadcast, 16 bytes each.
MIDDLE = 1 << 18


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (id, component): component is the smallest id reachable. Ids without an edge are absent.

    Alternating large and small stars (Kiveris et al., 2014) over edges u > v. Large star: v gives way to its least
    neighbour. Small star: the neighbours below u are tied to the least of them. Each round begins with the degrees of all
    ids; once no id has two neighbours below it, or neighbours on both sides, the edges are stars and the search ends.
    No task meets all edges of a hub: a hub on the v side gets its least neighbour by broadcast, and one on the u side is
    starred in parts, which leaves it one edge a part for the next round. There are under 2**(HUB_BITS + 1) hubs, whatever
    the number of edges. Every round is written to the shared folder; three numbers and the hubs reach the driver.
    """
    spark = edges.sparkSession
    e = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        most = max(HUB, e.count() >> HUB_BITS)
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        ends = F.array(F.struct(F.col("u").alias("x"), one.alias("below"), none.alias("above"), F.col("v").alias("m")), F.struct(F.col("v").alias("x"), none.alias("below"), one.alias("above"), F.lit(None).cast("long").alias("m")))
        degrees = e.select(F.explode(ends).alias("s")).groupBy("s.x").agg(F.sum("s.below").alias("below"), F.sum("s.above").alias("above"), F.min("s.m").alias("m"))
        busy = save(degrees.where((F.col("below") > 1) | (F.col("above") > most) | (F.col("below") > 0) & (F.col("above") > 0)), "degrees")
        unsettled, middle = busy.agg(F.count_if(F.expr("below > 1 OR below > 0 AND above > 0")), F.count_if(F.expr("below > 0 AND above > 0"))).first()
        if not unsettled:
            release(busy)
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        hubs = busy.where((F.col("below") > most) | (F.col("above") > most)).collect()
        low = busy.where("below > 0 AND above > 0").select(F.col("x").alias("k"), "m")
        over = [(r["x"], r["m"]) for r in hubs if r["above"] > most]
        if middle <= MIDDLE or not over:
            large = e.join(F.broadcast(low) if middle <= MIDDLE else low, F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v"))
        else:
            spread = e.join(F.broadcast(small_table(spark, "x long, hm long", over)), F.col("v") == F.col("x"), "left")
            # rows of a hub carry a second key that nothing on the other side has, so they go anywhere and match nothing
            spread = spread.withColumn("_s", F.when(F.col("x").isNotNull(), 1 + F.pmod(F.xxhash64("u"), F.lit(1 << 20))).otherwise(F.lit(0).cast("long")))
            low = low.withColumn("_z", F.pmod("k", F.lit(1)))  # always 0, but a literal would be folded out of the join's keys
            large = spread.join(low, (F.col("v") == F.col("k")) & (F.col("_s") == F.col("_z")), "left").select("u", F.coalesce("hm", "m", "v").alias("v"))
        parts = [(r["x"], -(-r["below"] // most)) for r in hubs if r["below"] > most]
        keys = ["u"]
        if parts:
            large = large.join(F.broadcast(small_table(spark, "x long, parts long", parts)), F.col("u") == F.col("x"), "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).alias("_p"))
            keys = ["u", "_p"]
        least = large.withColumn("m", F.min("v").over(Window.partitionBy(*keys)))
        old, e = e, save(least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "edges")
        release(old, busy)
