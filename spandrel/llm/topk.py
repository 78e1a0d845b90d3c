"""Exact top-k inner-product search by branch and bound over one ball tree per shard.

Candidates are dealt into shards of about SHARD vectors, each with a ball tree. A query first searches the shard it lies
in; its k-th score there decides which other shards' roots can still better it, and goes with it to those, where leaves are visited by falling upper bound (query times
centre plus query norm times radius, never above the parent's bound) until the bound falls below the k-th score so far.
Queries travel in blocks; a task holds one tree and one block at a time. Lists from the shards meet in a rank per query.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take no part; only
vectors of equal length are compared; repeated rows (same id and vector) count once and no row of the query's own id is a
candidate; ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm.common import lean, read, save
from spandrel.llm.neardup_vectors import matrix, packed, unpacked

K = 20
EVERY = 20
SHARD = 8192
LEAF = 128
#: Shards whose roots travel to all executors; past that queries go to every shard.
MOST_ROOTS = 1 << 15
#: Below any score, and safe to negate.
LOWEST = -np.iinfo(np.int64).max


def ball_tree(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """Nodes in pre-order: parent, range of rows, centre, radius; leaves: numbers of the nodes that are not split."""
    order = np.argsort(ids, kind="stable")
    parent, start, end, centre, radius, leaves, stack = [], [], [], [], [], [], [(-1, 0, len(ids))]
    x64 = x.astype(np.float64)
    while stack:
        up, s, e = stack.pop()
        k, rows = len(parent), order[s:e]
        points = x64[rows]
        middle = points.mean(0)
        parent.append(up)
        start.append(s)
        end.append(e)
        centre.append(middle)
        radius.append(np.sqrt(((points - middle) ** 2).sum(1).max()))
        if e - s <= leaf or radius[-1] == 0:
            leaves.append(k)
            order[s:e] = rows[np.argsort(ids[rows], kind="stable")]
            continue
        axis = int(np.argmax(points.var(0))) if points.shape[1] else 0
        half = (e - s) // 2
        order[s:e] = rows[np.argpartition(points[:, axis], half)]
        stack += [(k, s + half, e), (k, s, s + half)]
    return {"ids": ids[order], "x": x[order], "parent": np.array(parent), "start": np.array(start), "end": np.array(end), "centre": np.array(centre), "radius": np.array(radius), "leaves": np.array(leaves)}


def search(tree: dict, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple:
    """Rows (query's number, candidate id, score) that may belong to a query's best k, none scoring below floor, and the k-th scores."""
    n = len(query_ids)
    most = (abs(tree["x"]).max(initial=0).astype(float) + 1) * (abs(q).max(initial=0).astype(float) + 1) * max(1, q.shape[1])
    exact = np.float64 if most < 2.0**53 else np.int64
    x, qe, q64 = tree["x"].astype(exact), q.astype(exact), q.astype(np.float64)
    norm = np.sqrt((q64 * q64).sum(1))
    bound = _bound(q64, norm, tree["centre"], tree["radius"])
    for node, up in enumerate(tree["parent"]):
        if up >= 0:
            np.minimum(bound[:, node], bound[:, up], out=bound[:, node])
    leaves = tree["leaves"]
    bound = bound[:, leaves]
    turn = np.argsort(-bound, axis=1, kind="stable")
    low = LOWEST
    best, names = np.full((n, k), low), np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.copy()
    for step in range(len(leaves)):
        which = turn[:, step]
        open_ = np.nonzero(bound[np.arange(n), which] >= kth)[0]
        if not len(open_):
            break  # bounds fall from turn to turn and k-th scores only rise
        open_ = open_[np.argsort(which[open_], kind="stable")]
        cuts = np.nonzero(np.diff(which[open_]))[0] + 1
        for rows in np.split(open_, cuts):
            node = leaves[which[rows[0]]]
            s, e = tree["start"][node], tree["end"][node]
            ids = tree["ids"][s:e]
            scores = (qe[rows] @ x[s:e].T).astype(np.int64)
            scores[query_ids[rows][:, None] == ids] = low
            some = np.nonzero(scores.max(1) >= kth[rows])[0]
            rows, scores = rows[some], scores[some]
            if not len(rows):
                continue
            all_scores = np.concatenate([best[rows], scores], 1)
            all_ids = np.concatenate([names[rows], np.broadcast_to(ids, scores.shape)], 1)
            take = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[rows] = np.take_along_axis(all_scores, take, 1)
            names[rows] = np.take_along_axis(all_ids, take, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, -1])
    row, col = np.nonzero((best > low) & (best >= floor[:, None]))
    return row, names[row, col], best[row, col], kth


def _build(table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    x = matrix(table["x"], dim)
    if abs(x).max(initial=0) < 2**31:
        x = x.astype(np.int32)
    tree = ball_tree(table["vec_id"].to_numpy(), x)
    root = {"centre": pa.array(tree["centre"][:1].tolist(), pa.list_(pa.float64())), "radius": pa.array(tree["radius"][:1])}
    return pa.table({"dim": table["dim"].slice(0, 1), "shard": table["shard"].slice(0, 1), **root, "tree": pa.array([packed(**tree)], pa.binary())})


def _bound(q: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The inner product that no row of a node exceeds, by query and node, with room for rounding."""
    bound = q @ centre.T + norm[:, None] * radius
    return bound + 1e-9 * (abs(bound) + norm[:, None] * (np.sqrt((centre**2).sum(1)) + 1)) + 1e-6


def _block(table: pa.Table) -> pa.Table:
    q = packed(ids=table["vec_id"].to_numpy(), x=matrix(table["x"], table["dim"][0].as_py()))
    return pa.table({"dim": table["dim"].slice(0, 1), "shard": table["shard"].slice(0, 1), "queries": pa.array([q], pa.binary())})


def shard_roots(spark, held: dict):
    """Shards' roots (number, centre, radius) by dimension on all executors: MOST_ROOTS at most."""
    return spark.sparkContext.broadcast({d: (np.array([x[0] for x in v]), np.array([x[1] for x in v], np.float64), np.array([x[2] for x in v])) for d, v in held.items()})


def top_k(vectors: DataFrame, scaled: str, is_query: str, vec_id: str = "vec_id", k: int = K, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score for the rows where is_query holds. scaled: SQL for an array of longs (null: takes no part)."""
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.expr(scaled).alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL").distinct()
    v = save(v, "vectors")
    n = max(1, -(-v.count() // shard))
    v = v.withColumns({"dim": F.size("x"), "shard": F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")})
    trees = save(v.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, centre array<double>, radius double, tree binary"), "trees")
    held: dict = {}
    if n <= MOST_ROOTS:
        for r in trees.select("dim", "shard", "centre", "radius").collect():
            held.setdefault(r["dim"], []).append((r["shard"], r["centre"], r["radius"]))
    roots = shard_roots(v.sparkSession, held)
    asked = v.where(is_query).groupBy("dim", "shard").applyInArrow(_block, "dim int, shard int, queries binary")

    def at_home(batches):
        """A query block's own results, and for every other shard the queries that its root may still better."""
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q = unpacked(row["queries"])
                floor = np.full(len(q["ids"]), LOWEST)
                who, ids, scores, kth = search(unpacked(row["tree"]), q["ids"], q["x"], k, floor)
                out = [{"dim": row["dim"], "shard": -1, "queries": None, "found": packed(query=q["ids"][who], ids=ids, scores=scores)}]
                if row["dim"] in roots.value:
                    shards, centre, radius = roots.value[row["dim"]]
                    x = q["x"].astype(np.float64)
                    open_ = _bound(x, np.sqrt((x * x).sum(1)), centre, radius) >= kth[:, None]
                    asked_ = [(int(s), np.nonzero(open_[:, c])[0]) for c, s in enumerate(shards) if s != row["shard"]]
                else:
                    asked_ = [(s, np.arange(len(q["ids"]))) for s in range(n) if s != row["shard"]]
                out += [{"dim": row["dim"], "shard": s, "queries": packed(kth=kth[rows], ids=q["ids"][rows], x=q["x"][rows]), "found": None} for s, rows in asked_ if len(rows)]
                for r in out:  # one at a time: a batch holds one block of queries
                    yield pa.RecordBatch.from_pylist([r], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("queries", pa.binary()), ("found", pa.binary())]))

    names = ["query_id", "vec_id", "score"]

    def rows_of(query, ids, scores):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, ids, scores)], names=names)

    def elsewhere(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q = unpacked(row["queries"])
                who, ids, scores, _ = search(unpacked(row["tree"]), q["ids"], q["x"], k, q["kth"])
                yield rows_of(q["ids"][who], ids, scores)

    def unpack(batches):
        for batch in batches:
            for x in batch.column(0):
                f = unpacked(x.as_py())
                yield rows_of(f["query"], f["ids"], f["scores"])

    schema = "query_id long, vec_id long, score long"
    first = save(trees.select("dim", "shard", "tree").join(asked, ["dim", "shard"]).mapInArrow(lean(at_home), "dim int, shard int, queries binary, found binary"), "home")
    away = first.where("shard >= 0").select("dim", "shard", "queries")
    found = away.join(trees.select("dim", "shard", "tree"), ["dim", "shard"]).mapInArrow(lean(elsewhere), schema).unionByName(first.where("shard < 0").select("found").mapInArrow(lean(unpack), schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Null for a vector that takes no part.
SCALED = "CASE WHEN forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) THEN transform(embedding, x -> cast(floor(64D * double(x)) AS bigint)) END"


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), SCALED, f"vec_id % {EVERY} = 0")


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
