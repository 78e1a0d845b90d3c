"""Embedding near-duplicates by dual traversal of cover trees: all pairs with cosine >= threshold, exactly.

Equal vectors are first folded into one with a weight. The rest are dealt to the nearest of up to PIVOTS vectors, the top
level of the cover tree, and crowded cells split into blocks of about BLOCK vectors; each block gets a cover tree over its
unit vectors, whose levels halve the covering radius. Two blocks meet if their roots' centres are no further apart than the
threshold's chord and both radii; only then is their payload moved. Every such pair of blocks is one task: it walks both
trees at once, drops a node pair when the centres' distance less both radii exceeds the threshold's chord,
counts all pairs of a node pair as links when the distance plus both radii stays below it, and compares single vectors
otherwise. A task returns link counts and a spanning forest, never the pairs, so a group of near copies costs what it
has members. A block's payload is bounded, and no task holds more than two.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link
with nothing; vectors of different length link with nothing; repeated rows count as further vectors; ties do not arise
(component ids are minima); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import components, lean, read, save, small_table

THRESHOLD = 0.9
BLOCK = 4096
#: Vectors that the first deal goes by, and blocks whose roots are held against each other before they meet: what these two
#: broadcast is bounded. Past MOST_ROOTS blocks all pairs meet.
PIVOTS = 1024
MOST_ROOTS = 1 << 15
SLACK = 1e-9


class Tree:
    """A cover tree over unit vectors. Each node covers rows start:end within radius of its centre, itself one of them."""

    @staticmethod
    def scaled(x: np.ndarray) -> np.ndarray:
        """Rows by their largest component, so that no square overflows or vanishes; angles stay."""
        wide = x.astype(np.float64)
        return wide / abs(wide).max(1, keepdims=True)

    ARRAYS = ("ids", "weight", "x", "centre", "start", "end", "first", "last", "radius")

    def __init__(self, arrays: dict):
        self.ids, self.weight, self.x, self.centre, self.start, self.end, self.first, self.last, self.radius = (arrays[k] for k in self.ARRAYS)
        self.x = self.scaled(self.x)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.unit = self.x / self.norm[:, None]
        self.short = self.unit.astype(np.float32)
        self.sums = np.concatenate([[0], np.cumsum(self.weight)])

    def total(self, node: int) -> int:
        return int(self.sums[self.end[node]] - self.sums[self.start[node]])

    def level(self, radius: float, nodes: np.ndarray | None = None) -> np.ndarray:
        """The highest nodes below `nodes` (the root) whose radius is at most `radius`: together they cover all rows."""
        out, open_ = [], np.zeros(1, np.int64) if nodes is None else nodes
        while len(open_):
            small = self.radius[open_] <= radius
            out.append(open_[small])
            open_ = open_[~small]
            open_ = np.concatenate([np.arange(self.first[k], self.last[k]) for k in open_]) if len(open_) else open_
        return np.concatenate(out)

    @classmethod
    def build(cls, ids: np.ndarray, weight: np.ndarray, x: np.ndarray) -> dict:
        """The tree's arrays, rows in tree order. Covers are chosen greedily in single precision; radii are exact."""
        wide = cls.scaled(x)
        unit = wide / np.sqrt((wide * wide).sum(1))[:, None]
        short = unit.astype(np.float32)
        gram = short @ short.T
        order, held = np.arange(len(ids)), []
        if len(ids):  # the root's centre is the vector nearest to the middle
            middle = int(np.argmax(unit @ unit.mean(0)))
            order[[0, middle]] = order[[middle, 0]]
        centre, start, end, radius, first, last = [], [], [], [], [], []

        def add(members: np.ndarray, at: int) -> None:
            centre.append(members[0])
            start.append(at)
            end.append(at + len(members))
            radius.append(float(np.sqrt(((unit[members] - unit[members[0]]) ** 2).sum(1).max())) if len(members) > 1 else 0.0)
            first.append(0)
            last.append(0)
            held.append(members if len(members) > 1 else None)

        if len(ids):
            add(order.copy(), 0)
            held[0] = order.copy()
        k = 0
        while k < len(centre):
            if held[k] is not None and len(held[k]) > 1:
                # the next of the halving radii below this node's own; nodes of no extent fall apart at once
                reach = 2.0 ** (math.ceil(math.log2(radius[k])) - 1) if radius[k] > 1e-6 else -1.0
                first[k], rest, at, placed = len(centre), held[k], start[k], []
                while len(rest):
                    inside = gram[rest[0], rest] >= 1 - reach * reach / 2 if reach > 0 else np.zeros(len(rest), bool)
                    if reach > 0 and (reach < 0.1 or inside.all()):  # too fine for single precision, or no progress by it
                        inside = ((unit[rest] - unit[rest[0]]) ** 2).sum(1) <= reach * reach
                    inside[0] = True
                    add(rest[inside], at)
                    placed.append(rest[inside])
                    at += len(placed[-1])
                    rest = rest[~inside]
                last[k] = len(centre)
                order[start[k] : end[k]] = np.concatenate(placed)
            held[k] = None
            k += 1
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        nodes = [np.array(v, np.int64) for v in (start, end, first, last)]
        return dict(zip(cls.ARRAYS, (ids[order], weight[order], x[order], place[np.array(centre, np.int64)], *nodes, np.array(radius))))


class Links:
    """Links found between the vectors of two trees (or within one), as counts and joined ranges."""

    def __init__(self, a: Tree, b: Tree, threshold: float):
        self.a, self.b, self.threshold, self.same = a, b, threshold, a is b
        self.chord = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.shift = 0 if self.same else len(a.ids)
        n = len(a.ids) + (0 if self.same else len(b.ids))
        self.counts, self.joined, self.edges = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), []

    def all_linked(self, p: int, q: int) -> None:
        a, b = self.a, self.b
        for tree, node, shift, other in ((a, p, 0, b.total(q)), (b, q, self.shift, a.total(p))):
            s, e = tree.start[node] + shift, tree.end[node] + shift
            self.counts[s] += other
            self.counts[e] -= other
            self.joined[s] += 1
            self.joined[e - 1] -= 1
        self.edges.append((a.start[p], b.start[q] + self.shift))

    def within(self, node: int) -> None:
        """Links among the members of one node."""
        stack = [node]
        while stack:
            k = stack.pop()
            t = self.a
            if t.end[k] - t.start[k] < 2:
                continue
            if 2 * t.radius[k] <= self.chord - SLACK:
                s, e = t.start[k], t.end[k]
                self.counts[s] += t.total(k)
                self.counts[e] -= t.total(k)
                self.counts[s:e] -= t.weight[s:e]
                self.counts[s + 1 : e + 1] += t.weight[s:e]
                self.joined[s] += 1
                self.joined[e - 1] -= 1
                continue
            kids = t.level(self.chord / 2, np.arange(t.first[k], t.last[k]))
            self.between(kids, kids, True)
            stack += [x for x in kids.tolist() if t.end[x] - t.start[x] > 1]

    def near(self, ps: np.ndarray, qs: np.ndarray, upper: bool):
        """Node pairs whose members may link, with their centres' cosine. A loose bound in single precision goes first."""
        a, b = self.a, self.b
        for pa_ in (ps[a.radius[ps] == 0], ps[a.radius[ps] > 0]):
            for qb in (qs[b.radius[qs] == 0], qs[b.radius[qs] > 0]):
                if not len(pa_) or not len(qb):
                    continue
                far = self.chord + SLACK + a.radius[pa_].max() + b.radius[qb].max()
                loose = np.float32(1 - far * far / 2 - 1e-5)
                right = b.short[b.centre[qb]].T
                for k in range(0, len(pa_), 512):
                    some = pa_[k : k + 512]
                    at = np.flatnonzero(a.short[a.centre[some]] @ right >= loose)
                    if not len(at):
                        continue
                    p, q = some[at // len(qb)], qb[at % len(qb)]
                    if upper:
                        p, q = p[p < q], q[p < q]
                    cos = (a.unit[a.centre[p]] * b.unit[b.centre[q]]).sum(1)
                    far = self.chord + SLACK + a.radius[p] + b.radius[q]
                    fine = cos >= 1 - far * far / 2
                    yield from zip(p[fine].tolist(), q[fine].tolist(), cos[fine].tolist())

    def between(self, ps: np.ndarray, qs: np.ndarray, upper: bool = False) -> None:
        a, b = self.a, self.b
        stack = [(ps, qs, upper)]
        while stack:
            for p, q, cos in self.near(*stack.pop()):
                distance, reach = math.sqrt(max(0.0, 2 - 2 * cos)), a.radius[p] + b.radius[q]
                one_p, one_q = a.end[p] - a.start[p] == 1, b.end[q] - b.start[q] == 1
                if one_p and one_q:
                    x, y = a.centre[p], b.centre[q]
                    if a.x[x] @ b.x[y] / (a.norm[x] * b.norm[y]) >= self.threshold:
                        self.all_linked(p, q)
                elif distance + reach <= self.chord - SLACK:
                    self.all_linked(p, q)
                elif one_q or not one_p and a.radius[p] >= b.radius[q]:
                    stack.append((np.arange(a.first[p], a.last[p]), np.array([q]), False))
                else:
                    stack.append((np.array([p]), np.arange(b.first[q], b.last[q]), False))

    def run(self) -> list:
        """(id, smallest id of its part or null, links)."""
        if not len(self.a.ids) or not len(self.b.ids):
            return []
        if self.same:
            self.within(0)
            ids = self.a.ids
        else:
            # nodes wider than the chord prune nothing, so both trees are first opened down to half of it
            self.between(self.a.level(self.chord / 2), self.b.level(self.chord / 2))
            ids = np.concatenate([self.a.ids, self.b.ids])
        counts = np.cumsum(self.counts)[:-1]
        runs = np.concatenate([[0], np.cumsum(np.cumsum(self.joined)[:-2] <= 0)]) if len(ids) > 1 else np.zeros(1, np.int64)
        parent = np.arange(runs[-1] + 1)

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for p, q in self.edges:
            x, y = root(runs[p]), root(runs[q])
            parent[max(x, y)] = min(x, y)
        of = np.array([root(k) for k in range(len(parent))])[runs]
        least = np.full(len(parent), np.iinfo(np.int64).max)
        np.minimum.at(least, of, ids)
        linked = np.nonzero(counts)[0]
        return [(int(ids[k]), int(least[of[k]]), int(counts[k])) for k in linked]


def matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)


def _pack(table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    tree = Tree.build(table["rep"].to_numpy(), table["weight"].to_numpy(), matrix(table["embedding"], dim))
    root = units(tree["x"][tree["centre"][:1]])
    columns = {"dim": pa.array([dim], pa.int32()), "block": table["block"].slice(0, 1), "centre": pa.array(root.tolist(), pa.list_(pa.float64())), "radius": pa.array(tree["radius"][:1]), "tree": pa.array([packed(**tree)], pa.binary())}
    return pa.table(columns)


def units(x: np.ndarray) -> np.ndarray:
    x = Tree.scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def dealt(unique: DataFrame, block: int) -> DataFrame:
    """unique (rep, weight, embedding) with dim and block: the nearest pivot's cell, crowded cells in parts of about `block`.

    Pivots are the vectors that hash lowest; they decide where a vector lies, not what it is compared with.
    """
    spark = unique.sparkSession
    n = unique.count()
    few = unique.select("embedding", F.xxhash64(F.lit(3), "rep").alias("h")).orderBy("h").limit(min(PIVOTS, -(-n // block))).collect()
    by_dim: dict = {}
    for r in few:
        by_dim.setdefault(len(r["embedding"]), []).append(r["embedding"])
    pivots = spark.sparkContext.broadcast({dim: units(np.array(x, np.float64)) for dim, x in by_dim.items()})  # PIVOTS vectors at most

    def nearest(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            dims = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            cell = np.zeros(len(dims), np.int32)
            for dim in set(dims.tolist()) & set(pivots.value):
                rows = np.nonzero(dims == dim)[0]
                cell[rows] = (units(matrix(column.take(pa.array(rows)), dim)) @ pivots.value[dim].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(cell, pa.int32())], names=[*batch.schema.names, "dim", "cell"])

    placed = save(unique.mapInArrow(lean(nearest), T.StructType([*unique.schema, T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType())])), "placed")
    parts, rows, at = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).orderBy("dim", "cell").collect(), [], {}  # a row a pivot, or a dimension without one
    for r in parts:
        some = -(-r["n"] // block)
        rows.append((r["dim"], r["cell"], at.get(r["dim"], 0), some))
        at[r["dim"]] = at.get(r["dim"], 0) + some
    table = small_table(spark, "dim int, cell int, first int, parts int", rows)
    number = F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    return placed.join(F.broadcast(table), ["dim", "cell"]).withColumn("block", number).drop("cell", "first", "parts")


def meetings(trees: DataFrame, threshold: float) -> DataFrame:
    """dim, block and other (block <= other) for the pairs of blocks that may hold a link, judged by their roots."""
    spark = trees.sparkSession
    roots = trees.select("dim", "block", "centre", "radius")
    n = roots.count()
    if n > MOST_ROOTS:
        most = roots.groupBy("dim").agg((F.max("block") + 1).alias("_n"))
        return roots.join(F.broadcast(most), "dim").select("dim", "block", F.explode(F.sequence(F.col("block"), F.col("_n") - 1)).alias("other"))
    held: dict = {}
    for r in roots.collect():
        held.setdefault(r["dim"], []).append((r["block"], r["centre"], r["radius"]))
    every = spark.sparkContext.broadcast({d: (np.array([x[0] for x in v], np.int32), np.array([x[1] for x in v], np.float64), np.array([x[2] for x in v])) for d, v in held.items()})
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def near(batches):
        for batch in batches:
            for r in batch.to_pylist():
                blocks, centres, radii = every.value[r["dim"]]
                apart = np.sqrt(((centres - np.array(r["centre"])) ** 2).sum(1))
                other = blocks[(apart <= chord + radii + r["radius"]) & (blocks >= r["block"])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), r["dim"]), pa.int32()), pa.array(np.full(len(other), r["block"]), pa.int32()), pa.array(other, pa.int32())], names=["dim", "block", "other"])

    return roots.mapInArrow(lean(near), "dim int, block int, other int")


def packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def near_pairs(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors."""
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    fine = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    unique = save(v.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "unique")
    if unique.isEmpty():
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    trees = save(dealt(unique, block).select("rep", "weight", "embedding", "dim", "block").groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, centre array<double>, radius double, tree binary"), "blocks")
    pairs = save(meetings(trees, threshold), "meetings")
    left = pairs.join(trees.select("dim", "block", "tree"), ["dim", "block"])
    right = trees.select("dim", F.col("block").alias("other"), F.col("tree").alias("tree_b"))
    threshold_ = threshold

    def run(batches):
        kept, tree = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                row = batch.slice(row, 1).to_pylist()[0]
                if kept != (row["dim"], row["other"]):
                    kept, tree = (row["dim"], row["other"]), Tree(unpacked(row["tree_b"]))
                a = tree if row["block"] == row["other"] else Tree(unpacked(row["tree"]))
                found = Links(a, tree, threshold_).run()
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    found = save(left.join(right, ["dim", "other"]).select("dim", "block", "other", "tree", "tree_b").mapInArrow(lean(run), "a long, b long, n long"), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    parts = components(found)
    classes = unique.join(counts, F.col("rep") == F.col("a"), "left").join(parts, F.col("rep") == F.col("id"), "left")
    classes = classes.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    named = F.col("vec_id").isNotNull()
    out = v.join(classes, "embedding", "left").select("vec_id", F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(named, F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_pairs(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, (SELECT min(b) FROM r WHERE r.a = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(b) FROM r WHERE r.a = e.vec_id) AS kept FROM embeddings e
"""
