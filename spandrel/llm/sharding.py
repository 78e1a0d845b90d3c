"""Sharding by longest-processing-time scheduling (law `bytes`: the shards' sizes come near equal).

Rows of equal text form a group and stay together. Groups are taken by falling size and each goes to the least-loaded
shard of a heap. Groups of one size are interchangeable, so the schedule is worked out on the histogram of group sizes:
with T bytes in all there are at most sqrt(2T) distinct sizes, which bounds what the driver sees. A schedule is a list
of (first rank, shard) runs over the groups in sorted order; ranks are found by a distributed range sort.

Defined results: a null text has size 1, checksum 0 and a group of its own, apart from ''; fewer groups than shards leave
shards empty; repeated rows share a group; null ids sort first in their shard; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import ranked, read, save

SHARDS = 16


def schedule(histogram: list, shards: int = SHARDS) -> tuple:
    """histogram: (size, number of groups). Returns the runs' first ranks and shards, and the final loads."""
    heap = [(0, s) for s in range(shards)]
    firsts, owners, rank = [], [], 0

    def give(shard: int, n: int) -> None:
        nonlocal rank
        if not owners or owners[-1] != shard:
            firsts.append(rank)
            owners.append(shard)
        rank += n

    for size, n in sorted(histogram, reverse=True):
        while n:
            load, s = heap[0]
            most = max(heap)[0]
            if n > shards and most - load <= size:  # loads are level to one item: each whole round gives every shard one more
                each = n // shards
                for other in sorted(x for _, x in heap):
                    give(other, each)
                heap = [(l + each * size, x) for l, x in heap]  # equal steps keep the heap's order
                n -= each * shards
                continue
            second = min(heap[1:3], default=(load, s))  # the next least load
            some = min(n, max(1, -(-(second[0] - load) // size)))
            give(s, some)
            heapq.heapreplace(heap, (load + some * size, s))
            n -= some
    return firsts, owners, {s: l for l, s in heap}


def shard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs."""
    value = F.col(text)
    narrow = save(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(value), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(value), F.lit("")).alias("_group"),
        ),
        "narrow",
    )
    groups = save(narrow.groupBy("_group").agg(F.sum("size").alias("_bytes")), "groups")
    histogram = [(r["_bytes"], r["n"]) for r in groups.groupBy("_bytes").agg(F.count(F.lit(1)).alias("n")).collect()]
    firsts, owners, _ = schedule(histogram, shards)
    runs = docs.sparkSession.sparkContext.broadcast((np.array(firsts, np.int64), np.array(owners, np.int32)))  # at most sqrt(2T) sizes

    @F.pandas_udf("int")
    def owner(rank: pd.Series) -> pd.Series:
        first, own = runs.value
        return pd.Series(own[np.searchsorted(first, rank.to_numpy(), side="right") - 1])

    placed = ranked(groups, [F.col("_bytes").desc(), F.col("_group")], "_rank").select("_group", owner("_rank").alias("shard"))
    rows = ranked(narrow.join(placed, "_group").drop("_group"), [F.col("shard"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "_rank")
    rows = save(rows, "placed")
    start = rows.groupBy("shard").agg(F.min("_rank").alias("_start"))  # one row per shard
    return rows.join(F.broadcast(start), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") - F.col("_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
