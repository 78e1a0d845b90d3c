import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import common, neardup_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)] + list(extra), SCHEMA)


ODD = [(900, None, 0), (901, [0.0] * 6, 0), (902, [float("nan")] + [1.0] * 5, 0), (903, [float("inf")] + [1.0] * 5, 0), (904, [None] + [1.0] * 5, 0), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0)]


def clusters(n, d, noise, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, d))
    return (base[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * noise).astype(np.float32)


def test_links_match_brute_force(spark):
    for noise in (0.15, 0.4):
        x = clusters(150, 6, noise, 1)
        x[140:] = x[0]
        got = {r.vec_id: r for r in neardup_vectors.near_pairs(frame(spark, x, ODD), block=40).collect()}
        wide = x.astype(np.float64)
        norm = np.linalg.norm(wide, axis=1)
        near = wide @ wide.T / norm[:, None] / norm >= 0.9
        np.fill_diagonal(near, False)
        part = list(range(150))
        for _ in range(150):
            part = [min([part[i], *(part[j] for j in np.nonzero(near[i])[0])]) for i in range(150)]
        assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(150)] == [(int(near[i].sum()), part[i], part[i] == i) for i in range(150)]
        assert [(got[k].n_links, got[k].component_id) for k in range(900, 908)] == [(0, k) for k in range(900, 906)] + [(1, 906), (1, 906)]


def test_cover_tree():
    x = clusters(300, 5, 0.2, 2)
    arrays = neardup_vectors.Tree.build(np.arange(300), np.ones(300, int), x)
    tree = neardup_vectors.Tree(arrays)
    assert sorted(tree.ids) == list(range(300))
    for k in range(len(tree.centre)):
        inside = tree.unit[tree.start[k] : tree.end[k]]
        assert np.sqrt(((inside - tree.unit[tree.centre[k]]) ** 2).sum(1)).max() <= tree.radius[k] + 1e-9
        if tree.last[k]:
            kids = range(tree.first[k], tree.last[k])
            assert tree.start[kids[0]] == tree.start[k] and tree.end[kids[-1]] == tree.end[k] and all(tree.radius[c] < tree.radius[k] or tree.radius[k] < 1e-6 for c in kids)


def test_no_vectors(spark):
    assert neardup_vectors.near_pairs(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, []), topk.SCALED, "vec_id % 20 = 0").count() == 0


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(260, 6)), 1)  # many ties
    got = [tuple(r) for r in topk.top_k(frame(spark, x, [*ODD, (0, [float(np.float32(v)) for v in x[0]], 0)]), topk.SCALED, "vec_id % 20 = 0", shard=64).orderBy("query_id", "rank").collect()]
    ints = np.floor(64 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    want = []
    zero = {901: np.zeros(6, np.int64)}
    for q in range(0, 260, 20):
        every = [(-int(ints[q] @ ints[c]), c) for c in range(260) if c != q] + [(0, 901)]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(sorted(every)[:20])]
    assert zero and got == want


@pytest.mark.parametrize("hub, middle", [(256, 1 << 18), (8, 1 << 18), (8, 0)])
def test_components(spark, monkeypatch, hub, middle):
    monkeypatch.setattr(common, "HUB", hub)
    monkeypatch.setattr(common, "MIDDLE", middle)
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(k, 700) for k in range(600, 640)]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    part = {k: k for e in edges for k in e}
    for _ in range(400):
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    assert got == {k: v for k, v in part.items() if k != v}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([(k * 7919 % 1000,) for k in range(1000)], "k long")
    assert [r.at for r in common.ranked(df, [F.col("k")], "at").orderBy("k").collect()] == list(range(1000))


def test_huge_tiny_and_odd_components(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 1e200]), (3, [1e-200, 1e-201]), (4, [1.0, 0.1]), (5, [3e200, 3.1e199]), (None, [1.0, 0.1]), (4, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n_links": F.lit("clash"), "rep": F.lit("clash"), "block": F.lit("clash")})
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in neardup_vectors.near_pairs(df).collect())
    # 1 is within 0.9 of 3, 4 (twice) and 5; 2 (cosine 0.894 with 1) links with 3, 4 and 5
    assert got == [(0, 0, 0), (1, 4, 1), (2, 4, 1), (3, 5, 1), (4, 5, 1), (4, 5, 1), (5, 5, 1)]


def test_blocks_that_cannot_link_do_not_meet(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = np.eye(16)
    x = (base[rng.integers(0, 16, 800)] + rng.normal(size=(800, 16)) * 0.03).astype(np.float32)
    seen = []
    meetings = neardup_vectors.meetings
    monkeypatch.setattr(neardup_vectors, "meetings", lambda trees, t: seen.append((trees.count(), meetings(trees, t).count())) or meetings(trees, t))
    got = neardup_vectors.near_pairs(frame(spark, x), block=20).collect()
    wide = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(((wide @ wide.T >= 0.9).sum(1) - 1).tolist()))
    blocks, met = seen[0]
    assert met < blocks * (blocks + 1) / 2 / 2


def test_top_k_with_few_candidates_null_ids_and_clashes(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (None, [9.0, 9.0]), (7, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit("clash"), "shard": F.lit("clash"), "score": F.lit("clash")})
    got = [tuple(r) for r in topk.top_k(df, topk.SCALED, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 64 * 192 + 128 * 192), (0, 2, 20, 64 * 32 - 128 * 64), (20, 1, 0, 32 * 64 - 64 * 128), (20, 2, 7, 32 * 192 - 64 * 192)]  # a tie goes to the smaller id
