"""The registry fed by a stream: observations arrive as files, in any order; the current state stays one query."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from spandrel.operators.registry import OBSERVATION


def observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(OBSERVATION).option("recursiveFileLookup", True).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append arriving observations to the registry's log, each batch at most once however often it is retried.

    A batch has a folder named by its checkpoint and number, beside what Registry.append or other streams have logged.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/observations/stream-{name}-{number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
