"""The append-only registry: observations, lineage and verdicts, and the one query that says what holds now.

An observation has element_id, generation, doc, page, bbox, content_hash, status, artifact_id, kind, is_manual and seq (its
place in the log; files carry no order of their own, so ties need it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OBSERVATION = (
    "element_id string, generation int, doc string, page int, bbox struct<x0:float,y0:float,x1:float,y1:float>, content_hash string, "
    "status string, artifact_id string, kind string, is_manual boolean, parents array<string>, payload string, seq long"
)
LINEAGE = "parent string, child string, generation int, relation string"
VERDICT = "element_id string, candidates array<string>, flagged boolean, verdict string, winner string, confidence double, rationale string, seq long"


def current_view(observations: DataFrame) -> DataFrame:
    """The newest generation of each element; the first logged of equals."""
    order = Window.partitionBy("element_id").orderBy(F.desc("generation"), "seq")
    return observations.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def resolve(observations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each element's observation: a verdict's winner (first logged), else the newest manual one, else the newest (last logged)."""
    winners = verdicts.where("verdict = 'Winner' AND winner IS NOT NULL").select(F.col("winner").alias("artifact_id")).distinct().withColumn("_won", F.lit(True))
    rows = observations.join(winners, "artifact_id", "left")
    won = F.coalesce("_won", F.lit(False))
    order = Window.partitionBy("element_id").orderBy(
        F.when(won, F.col("seq")).asc_nulls_last(), F.desc("is_manual"), F.desc("generation"), F.desc("seq")
    )
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_won")


def lineage_edges(artifacts: DataFrame) -> DataFrame:
    """An edge per parent: Derive from one, Merge from several."""
    relation = F.when(F.size("parents") > 1, "Merge").otherwise("Derive")
    return artifacts.select(F.explode("parents").alias("parent"), F.col("artifact_id").alias("child"), "generation", relation.alias("relation"))


def lineage_kinds(lineage: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Edges with their parents' kinds, '?' where a parent is not on record."""
    kinds = artifacts.select(F.col("artifact_id").alias("parent"), F.col("kind").alias("parent_kind")).distinct()
    return lineage.join(kinds, "parent", "left").withColumn("parent_kind", F.coalesce("parent_kind", F.lit("?")))


def ancestors(lineage: DataFrame, depth: int = 16) -> DataFrame:
    """child, ancestor and steps, up to `depth` derivations back."""
    step = lineage.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    out, up = step, lineage.select(F.col("child").alias("ancestor"), F.col("parent").alias("_up"))
    for n in range(2, depth + 1):
        step = step.join(up, "ancestor").select("child", F.col("_up").alias("ancestor"), F.lit(n).alias("steps")).distinct()
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out.groupBy("child", "ancestor").agg(F.min("steps").alias("steps"))


def registered_regions(observations: DataFrame, regions: DataFrame) -> DataFrame:
    """The current region slots that register_or_match compares with. regions: artifact_id, role."""
    return current_view(observations).where("kind = 'Region'").join(regions, "artifact_id").select("element_id", "doc", "page", "role", "bbox", "seq")


def enrichment_work(sources: DataFrame, enrichments: DataFrame) -> DataFrame:
    """(kind, source) pairs that have no enrichment yet."""
    return sources.join(enrichments.select("kind", "source"), ["kind", "source"], "left_anti")


#: Kinds of payload that the log can hold.
KINDS = ("Text", "Region", "TextGrid", "HtmlTable", "ImageRef", "Document", "DbTable", "Enrichment", "Summary")


def enveloped(rows: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """rows with kind and payload, the fields as JSON; an unknown kind is an error, not a row left out."""
    if kind not in KINDS:
        raise ValueError(f"no artifact kind {kind!r}")
    return rows.withColumns({"kind": F.lit(kind), "payload": F.to_json(F.struct(*fields))})


def opened(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    """The artifacts of one kind with their payload's fields as columns; a malformed payload is an error."""
    parsed = rows.where(F.col("kind") == kind).withColumn("_x", F.from_json("payload", schema, {"mode": "FAILFAST"}))
    return parsed.select(*rows.columns, "_x.*")


class Registry:
    """Three append-only Parquet tables in a folder; JSON lines for exchange."""

    TABLES = {"observations": OBSERVATION, "lineage": LINEAGE, "verdicts": VERDICT}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            # files may lie at any depth: a stream keeps its batches in folders of their own
            return self.spark.read.schema(self.TABLES[name]).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], self.TABLES[name])

    @property
    def observations(self) -> DataFrame:
        return self._read("observations")

    @property
    def lineage(self) -> DataFrame:
        return self._read("lineage")

    @property
    def verdicts(self) -> DataFrame:
        return self._read("verdicts")

    def append(self, artifacts: DataFrame, verdicts: DataFrame | None = None) -> None:
        """Log artifacts (all observation columns but seq; ord sets their order) and verdicts. Numbers go on from the log's end."""
        start = self.observations.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        # numbers need only rise: range-sorted parts give them without one task seeing all rows
        rows = artifacts.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("seq", F.monotonically_increasing_id() + start + 1)
        fields = [f.split()[0] for f in self.spark.createDataFrame([], OBSERVATION).columns]
        # lineage first: a log entry then never lacks the edges it claims
        lineage_edges(artifacts).write.mode("append").parquet(f"{self.path}/lineage")
        rows.select(*fields).write.mode("append").parquet(f"{self.path}/observations")
        if verdicts is not None:
            begin = self.verdicts.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
            numbered = verdicts.repartitionByRange("element_id").sortWithinPartitions("element_id").withColumn("seq", F.monotonically_increasing_id() + begin + 1)
            numbered.select(*self.spark.createDataFrame([], VERDICT).columns).write.mode("append").parquet(f"{self.path}/verdicts")

    def current(self) -> DataFrame:
        return resolve(self.observations, self.verdicts)

    def manifest(self) -> DataFrame:
        """The winners by document, each list in order of element id; also the view current_artifacts."""
        now = self.current()
        now.createOrReplaceTempView("current_artifacts")
        entry = F.struct("element_id", "artifact_id", "kind", "generation", "page")
        return now.groupBy("doc").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("artifacts"))

    def to_json_lines(self, path: str) -> None:
        for name in self.TABLES:
            self._read(name).write.mode("append").json(f"{path}/{name}")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; a missing one is empty, a malformed row is an error."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
