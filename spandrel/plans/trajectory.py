"""The lazy cascade: cheap tiers first, each region leaving at the tier that resolves it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cascade(df: DataFrame, key: str, resolved_at: str, seconds: list[float]) -> DataFrame:
    """A row for every tier a region goes through: tier, resolved, and seconds spent so far."""
    costs = F.array(*map(F.lit, seconds))
    tiers = df.select(key, F.col(resolved_at).alias("_last"), F.explode(F.sequence(F.lit(0), F.col(resolved_at))).alias("tier"))
    spent = F.sum(F.get(costs, F.col("tier"))).over(Window.partitionBy(key).orderBy("tier"))
    return tiers.select(key, "tier", (F.col("tier") == F.col("_last")).alias("resolved"), spent.alias("seconds"))
