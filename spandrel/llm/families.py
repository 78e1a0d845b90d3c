"""Candidate families verified exactly: which members of a family hang together by true links.

A family is a component of candidate edges; its id is that of its first member, the anchor. Families too large for a task
are dealt into chunks, each with the anchor in it, so a member is read once however large its family is. Within a chunk all
members of different parts are compared. Members that hang together with the anchor are settled; only those of a large
family that don't (the open ones) meet the other chunks, in blocks: with each other and with the settled ones, which need
no comparing among themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import lean, save

#: Members, and their weight (characters or n-grams) together, that a task takes at a time.
MEMBERS = 512
WEIGHT = 1 << 20


#: A pair counted alone costs as much as so many products of a matrix; below so many products all shingles go by matrix.
FEW = 256
SMALL = 1 << 20


def add_pairs(common: np.ndarray, owner: np.ndarray, column: np.ndarray, rest: np.ndarray, most: int = 1 << 21) -> None:
    """Adds to common (rest x members) the columns that two members share, pair by pair; entries are sorted by column."""
    row = np.full(common.shape[1], -1)
    row[rest] = np.arange(len(rest))
    n = np.bincount(column)
    start = np.cumsum(n) - n
    left = np.nonzero(row[owner] >= 0)[0]
    times = n[column[left]]
    before = np.concatenate([[0], np.cumsum(times)])
    k = 0
    while k < len(left):
        stop = max(k + 1, int(np.searchsorted(before, before[k] + most, side="right")) - 1)
        each, of = times[k:stop], left[k:stop]
        other = np.arange(before[stop] - before[k]) - np.repeat(before[k:stop] - before[k] - start[column[of]], each)
        pairs = np.repeat(row[owner[of]] * common.shape[1], each) + owner[other]
        common += np.bincount(pairs, minlength=common.size).reshape(common.shape)
        k = stop


def linked_parts(sets: list[np.ndarray], linked: Callable, settled: np.ndarray | None = None, width: int = 1 << 12) -> np.ndarray:
    """Each member's part (the number of one of its members): distinct sets are tied where linked(common, n, m) holds.

    settled: members known to hang together. Without it, everything is first held against the first member, which settles
    most families at once. What is left meets all others over the shingles that it shares with any: pairs are counted one by
    one for shingles of few members, and by a matrix product, in strips of columns, for those of many.
    """
    m, n = len(sets), np.array([len(s) for s in sets], np.int64)
    keys, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    if settled is None:
        first = np.sort(sets[0])
        hit = first[np.minimum(np.searchsorted(first, keys), len(first) - 1)] == keys
        settled = linked(np.bincount(owner[hit], minlength=m), n[0], n)
        settled[0] = True
    part = np.arange(m)
    part[settled] = np.argmax(settled)
    rest = np.nonzero(~settled)[0]
    if not len(rest):
        return part
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    column = np.cumsum(np.append(True, keys[1:] != keys[:-1])) - 1
    useful = (np.bincount(column) > 1) & (np.bincount(column, weights=~settled[owner]) > 0)
    some = useful[column]
    owner, column = owner[some], (np.cumsum(useful) - 1)[column[some]]
    common = np.zeros((len(rest), m), np.float32)
    held, held_open = np.bincount(column), np.bincount(column, weights=~settled[owner])
    few = held * held_open * FEW < common.size
    if few.any() and common.size * len(few) > SMALL:
        some = few[column]
        add_pairs(common, owner[some], (np.cumsum(few) - 1)[column[some]], rest)
        owner, column, useful = owner[~some], (np.cumsum(~few) - 1)[column[~some]], ~few
    cuts = np.searchsorted(column, np.arange(0, int(useful.sum()) + width, width))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        x = np.zeros((m, int(column[b - 1]) - k * width + 1 if b > a else 1), np.float32)
        x[owner[a:b], column[a:b] - k * width] = 1
        common += x[rest] @ x.T
    near = linked(common.astype(np.int64), n[rest][:, None], n[None])
    near[np.arange(len(rest)), rest] = True
    while True:
        least = np.where(near, part, m).min(1)
        new = np.minimum(part, np.where(near, least[:, None], m).min(0))
        new[rest] = np.minimum(new[rest], least)
        new[settled] = new[settled].min(initial=m)
        if (new == part).all():
            return part
        part = new


def grouped(batches, width: int):
    """Streams sorted batches as tables that end where the first `width` columns change."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        names = held.schema.names[:width]
        columns = [held[c].to_numpy() for c in names]
        at = held.num_rows - 1
        differs = np.zeros(at + 1, bool)
        for c in columns:
            differs |= c != c[-1]
        cut = int(np.nonzero(differs)[0][-1]) + 1 if differs.any() else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def spans(table: pa.Table, width: int) -> np.ndarray:
    new = np.zeros(table.num_rows + 1, bool)
    new[0] = new[-1] = True
    for c in table.schema.names[:width]:
        v = table[c].to_numpy()
        new[1:-1] |= v[1:] != v[:-1]
    return np.nonzero(new)[0]


#: Families up to this many (12 bytes each) travel by broadcast; beyond, both sides are shuffled.
BROADCAST_FAMILIES = 1_000_000


def sized(members: DataFrame) -> DataFrame:
    """members (family, weight and more) of families of two and more, with chunks."""
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).where("n > 1")
    sizes = save(sizes.select("family", F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("w") / WEIGHT)).cast("int").alias("chunks")), "sizes")
    return members.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_FAMILIES else sizes, "family")


def verified(members: DataFrame, sets: Callable, linked: Callable) -> list[DataFrame]:
    """Edges (a, b) of a spanning forest of the links within each family, as one or two saved tables.

    members: family, chunks (of its family), rep (its id; the anchor's is the family's) and body; sets(bodies) lists the
    distinct shingles of each row of an Arrow column.
    """

    def run(batches):
        for table in grouped(batches, 2):
            cuts, rep = spans(table, 2).tolist(), table["rep"].to_numpy()
            shingles = sets(table["body"].combine_chunks())
            whole, family = table["chunks"].to_numpy() == 1, table["family"].to_numpy()
            for low, high in zip(cuts, cuts[1:]):
                part = linked_parts(shingles[low:high], linked)
                moved = np.nonzero(part != np.arange(high - low))[0]
                yield edges_of(rep[low + moved], rep[low + part[moved]])
                if not whole[low]:
                    open_ = rep[low:high][part != part[0]]
                    yield edges_of(open_, None, np.full(len(open_), family[low]))

    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    anchor = F.col("rep") == F.col("family")
    dealt = members.withColumn("chunk", F.explode(F.when(anchor, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))))
    dealt = dealt.select("family", "chunk", "rep", "chunks", "body").repartition("family", "chunk").sortWithinPartitions("family", "chunk", ~anchor, "rep")
    first = save(dealt.mapInArrow(lean(run), EDGE), "links")
    links, open_ = first.where("b IS NOT NULL").select("a", "b"), first.where("b IS NULL").select(F.col("a").alias("rep"), "family").distinct()
    counts = open_.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    if counts.isEmpty():
        return [links]

    def meet(batches):
        for table in grouped(batches, 4):
            cuts, rep, settled = spans(table, 4).tolist(), table["rep"].to_numpy(), table["settled"].to_numpy().astype(bool)
            shingles = sets(table["body"].combine_chunks())
            for low, high in zip(cuts, cuts[1:]):
                part = linked_parts(shingles[low:high], linked, settled[low:high] if settled[low:high].any() else None)
                moved = np.nonzero((part != np.arange(high - low)) & ~(settled[low:high] & settled[low:high][part]))[0]
                yield edges_of(rep[low + moved], rep[low + part[moved]])

    some = members.join(counts, "family").join(open_.withColumn("open", F.lit(True)), ["family", "rep"], "left")
    some = some.withColumns({"settled": F.col("open").isNull(), "c": chunk, "p": F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("parts")).cast("int")})
    number = lambda kind_, x, y: F.struct(F.lit(kind_).alias("kind"), x.alias("x"), y.alias("y"))
    parts, chunks = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("chunks") - 1)
    among = F.transform(parts, lambda j: number(0, F.least(F.col("p"), j), F.greatest(F.col("p"), j)))
    across = F.transform(chunks, lambda j: number(1, F.col("p"), j))
    with_open = F.transform(parts, lambda j: number(1, j, F.col("c")))
    met = some.withColumn("t", F.explode(F.when(F.col("settled"), with_open).otherwise(F.concat(among, across))))
    met = met.select("family", "t.kind", "t.x", "t.y", "rep", "settled", "body").repartition("family", "kind", "x", "y").sortWithinPartitions("family", "kind", "x", "y", F.desc("settled"), "rep")
    return [links, save(met.mapInArrow(lean(meet), EDGE), "links").select("a", "b")]


EDGE = "a long, b long, family long"


def edges_of(a: np.ndarray, b: np.ndarray | None, family: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    columns = [pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if family is None else pa.array(family, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "family"])
