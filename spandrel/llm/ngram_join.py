"""N-gram Jaccard join: documents whose sets of distinct word n-grams have a Jaccard similarity of at least 85 %.

Documents of one set are folded into a class. Each class hashes its n-grams into GROUPS groups; the group counts are a
point, and the sum of two points' coordinate minima bounds the overlap of the sets (pairs that pass on the first GROUPS
coordinates are held against their finer counts). Classes meet where they can link at
all: two sets this similar share one of the first n - ceil(0.85 n) + 1 n-grams of each in hash order, so each class goes
to the buckets of those. N-grams in more than HOT_SHARE of all texts (and HOT texts) are put last in that order, and the
prefixes are drawn again should one still fill a bucket, so a passage that many documents share opens none. Of buckets
that hold the same classes one is kept. In a bucket
the points are packed into an R-tree; pairs of nodes whose upper corners cannot give the overlap their sizes need are
dropped, then pairs of points; what survives is kept as a spanning forest. The forests' components (candidate families)
are then verified on the n-gram sets themselves (families.py), again leaving a spanning forest of true links. Buckets too
large for a task are cut into blocks, and every two blocks meet in a task of their own.

Defined results: A-Z is lower-cased, words are [^\\x20\\x09-\\x0D]+; a text without words (or null) has no n-grams and
links with nothing; one with fewer words than n has its whole sequence as its only n-gram; rows with a null id link with
nothing of their own; repeated rows fall into one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm import hashing
from spandrel.llm.common import components, lean, read, release, save
from spandrel.llm.families import grouped, sized, spans, verified

WIDTH = 4
PERCENT = 85
#: Groups by size of set: counts of larger sets stand out less, so they are kept finer, about 8 members a group and less;
#: finer groups nest in coarser ones. With three times as many, unrelated sets come within the bound.
GROUPS = 64
FINER = ((512, 256), (2048, 1024), (8192, 4096), (32768, 16384))
BLOCK = 256
HOT = 2048
HOT_SHARE = 0.001
LEAF = 16
FAN = 16
#: Ids up to this many travel by broadcast (16 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
BROADCAST_BUCKETS = 500_000
FULL = np.iinfo(np.uint8).max
#: The same in folded counts, which hold up to 16 of them.
WHOLE = np.iinfo(np.uint16).max


def prefix(n, percent: int):
    return n - (percent * n + 99) // 100 + (n > 0)


def fingerprint(u: np.ndarray) -> tuple[int, int]:
    return int(hashing.mix(u, 3).sum().view(np.int64)), int(hashing.mix(u, 4).sum().view(np.int64))


def group_counts(u: np.ndarray) -> np.ndarray:
    """Members by group, a byte each; all FULL (no bound but size) where a count does not fit."""
    groups = next((g for least, g in reversed(FINER) if len(u) >= least), GROUPS)
    counts = np.bincount((u >> hashing.U(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8) if counts.max() < FULL else np.full(GROUPS, FULL, np.uint8)


def folded(counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return counts.astype(np.uint16) if len(counts) == groups else counts.reshape(groups, -1).sum(1, dtype=np.uint16)


def finer_possible(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> bool:
    """The bound on the finest groups that both sets have."""
    groups = min(len(a), len(b))
    if groups == GROUPS:
        return True
    return bool(possible(n, m, int(np.minimum(folded(a, groups), folded(b, groups)).sum(dtype=np.int64)), percent))


def features(docs: DataFrame, width: int, percent: int, hot: np.ndarray) -> DataFrame:
    """doc_id, n, p and q (fingerprint of the set), counts (group counts, u16) and keys (the prefix)."""
    common = docs.sparkSession.sparkContext.broadcast(np.sort(hot))  # at most 1 / HOT_SHARE times the mean set's size

    def run(batches):
        last = common.value
        for batch in batches:
            data, borders = hashing.texts(batch.column(1))
            for a, b in hashing.chunks(borders):
                n, p, q, counts, keys = [], [], [], [], []
                for u in hashing.word_shingles(data[borders[a] : borders[b]], borders[a : b + 1] - borders[a], width):
                    n.append(len(u))
                    x, y = fingerprint(u)
                    p.append(x)
                    q.append(y)
                    counts.append(group_counts(u).tobytes())
                    if len(last) and len(u):
                        at = last[np.minimum(np.searchsorted(last, u), len(last) - 1)] == u
                        u = np.concatenate([u[~at], u[at]])
                    keys.append(u[: prefix(len(u), percent)].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int32()), pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(counts, pa.binary()), lists], names=["doc_id", "n", "p", "q", "counts", "keys"])

    return docs.mapInArrow(lean(run), "doc_id long, n int, p long, q long, counts binary, keys array<long>")


def frequent(docs: DataFrame, width: int) -> np.ndarray:
    """N-grams that stand in more than HOT_SHARE of the texts (and HOT texts), from those common within a batch.

    They only set the order of n-grams, so one that is missed costs time, not links; at most 1 / HOT_SHARE times the mean
    set's size.
    """

    def common(sets):
        keys, n = np.unique(np.concatenate(sets), return_counts=True)
        some = n >= max(3, HOT_SHARE * len(sets) / 2)
        return pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["key", "n"])

    def run(batches):
        sets, size = [], 0
        for batch in batches:
            data, borders = hashing.texts(batch.column(0))
            for a, b in hashing.chunks(borders):
                found = hashing.word_shingles(data[borders[a] : borders[b]], borders[a : b + 1] - borders[a], width)
                sets += found
                size += sum(map(len, found))
                if size > 1 << 21:
                    yield common(sets)
                    sets, size = [], 0
        if sets:
            yield common(sets)

    most = max(HOT, int(HOT_SHARE * docs.count()))
    found = docs.select("text").mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return np.array([r["key"] for r in found.select("key").collect()], np.int64).view(np.uint64)


def possible(n: np.ndarray, m: np.ndarray, bound: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m members with at most `bound` in common can reach the similarity."""
    return (100 + percent) * bound >= percent * (n + m)


class PointTree:
    """A packed R-tree over group counts; levels[0] are the points, each level above packs FAN nodes into one."""

    def __init__(self, n: np.ndarray, counts: np.ndarray):
        order = np.lexsort((counts[:, int(np.argmax(counts.var(0)))], n // np.maximum(1, n.max() // 16), ))
        self.order, n = order, n[order].astype(np.int64)
        hi = np.where((counts == WHOLE).any(1, keepdims=True), WHOLE, counts)[order]
        # a count that doesn't fit makes its point bounded by size alone
        self.levels = [(hi, n, n)]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            hi, low, high = self.levels[-1]
            cuts = np.arange(0, len(low), step)
            self.levels.append((np.maximum.reduceat(hi, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))
            step = FAN

    def survivors(self, same: np.ndarray, percent: int, chunk: int = 1 << 14):
        """Pairs of points (i < j, in tree order) that may link, by node pairs from the root; same: part of each point so far."""
        top = len(self.levels) - 1
        labels = [same[self.order]]
        for k in range(top):
            cuts = np.arange(0, len(labels[-1]), LEAF if k == 0 else FAN)
            low, high = np.minimum.reduceat(labels[-1], cuts), np.maximum.reduceat(labels[-1], cuts)
            labels.append(np.where(low == high, low, -1))
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            hi, low, high = self.levels[level]
            part = labels[level]
            keep = (part[a] != part[b]) | (part[a] < 0)
            keep &= (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
            a, b = a[keep], b[keep]
            bound = np.minimum(hi[a], hi[b]).sum(1, dtype=np.int64)
            bound = np.where((hi[a, 0] == WHOLE) | (hi[b, 0] == WHOLE), np.minimum(high[a], high[b]), bound)
            keep = possible(low[a], low[b], bound, percent)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            fan = LEAF if level == 1 else FAN
            below = len(self.levels[level - 1][1])
            grid = np.arange(fan)
            i = (a[:, None, None] * fan + grid[:, None] + 0 * grid).ravel()
            j = (b[:, None, None] * fan + 0 * grid[:, None] + grid).ravel()
            fine = (i < below) & (j < below) & ((i < j) if level == 1 else (i <= j))
            i, j = i[fine], j[fine]
            stack += [(level - 1, i[k : k + chunk], j[k : k + chunk]) for k in range(0, len(i), chunk)]


class Parts:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, k: int) -> int:
        p = self.parent
        while p[k] != k:
            p[k] = p[p[k]]
            k = p[k]
        return int(k)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        p = self.parent
        while (q := p[p]).tolist() != p.tolist():
            p = q
        self.parent = p
        return p


def bucket_forest(ids: np.ndarray, n: np.ndarray, counts: np.ndarray, fine: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the count bound lets link within one bucket."""
    parts = Parts(len(ids))
    # most buckets are one family: everything is first held against one member
    full = (counts == WHOLE).any(1)
    bound = np.minimum(counts, counts[0]).sum(1, dtype=np.int64)
    bound = np.where(full | full[0], np.minimum(n, n[0]), bound)
    near = possible(n.astype(np.int64), int(n[0]), bound, percent) & (100 * np.minimum(n, n[0]) >= percent * np.maximum(n, n[0]))
    if len(fine[0]) > GROUPS:
        for k in np.nonzero(near)[0].tolist():
            near[k] = finer_possible(fine[0], fine[k], int(n[0]), int(n[k]), percent)
    near[0] = True
    parts.parent[near] = 0
    if not near.all():
        tree = PointTree(n, counts)
        for a, b in tree.survivors(parts.labels().copy(), percent):
            for i, j in zip(tree.order[a].tolist(), tree.order[b].tolist()):
                if parts.root(i) != parts.root(j) and finer_possible(fine[i], fine[j], int(n[i]), int(n[j]), percent):
                    parts.join(i, j)
    of = parts.labels()
    moved = np.nonzero(of != np.arange(len(of)))[0]
    return ids[moved], ids[of[moved]]


def pairs_of(rows, names=("a", "b")):
    a = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    b = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=list(names))


def blocks(df: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Rows of groups with more than `most` rows once for every pair of blocks they take part in, as lo <= hi."""
    df = df.withColumn("_nb", F.ceil(F.col(size) / most).cast("int")).withColumn("_k", F.pmod(F.xxhash64("rep"), F.col("_nb")).cast("int"))
    df = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return df.withColumns({"lo": F.least("_k", "_j"), "hi": F.greatest("_k", "_j")}).drop("_nb", "_k", "_j")


def candidate_edges(classes: DataFrame, percent: int, counted: DataFrame) -> DataFrame:
    rows = classes.select(F.explode("keys").alias("key"), "rep")
    small = counted.count() <= BROADCAST_BUCKETS
    rows = rows.join(F.broadcast(counted) if small else counted, "key")
    rows = blocks(rows, "key", "rows", BLOCK).join(classes.select("rep", "n", "counts"), "rep")
    rows = rows.select("key", "lo", "hi", "rep", "n", "counts")
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "rep")

    def run(batches):
        for table in grouped(batches, 3):
            ids, n = table["rep"].to_numpy(), table["n"].to_numpy()
            finest = [np.frombuffer(x, np.uint8) for x in table["counts"].to_pylist()]
            counts = np.stack([folded(x) for x in finest])
            counts[[bool(x[0] == FULL) and len(x) == GROUPS for x in finest]] = WHOLE
            cuts = spans(table, 3)
            sizes = np.diff(cuts)
            found = []
            two = cuts[:-1][sizes == 2]
            if len(two):
                a, b = two, two + 1
                bound = np.minimum(counts[a], counts[b]).sum(1, dtype=np.int64)
                bound = np.where((counts[a] == WHOLE).any(1) | (counts[b] == WHOLE).any(1), np.minimum(n[a], n[b]), bound)
                fine = possible(n[a].astype(np.int64), n[b], bound, percent) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                for i, j in zip(a[fine].tolist(), b[fine].tolist()):
                    if finer_possible(finest[i], finest[j], int(n[i]), int(n[j]), percent):
                        found.append((ids[i : i + 1], ids[j : j + 1]))
            for a, b in zip(cuts[:-1][sizes > 2], cuts[1:][sizes > 2]):
                found.append(bucket_forest(ids[a:b], n[a:b], counts[a:b], finest[a:b], percent))
            out = pairs_of(found)
            pair = np.unique(np.stack([np.minimum(out.column(0), out.column(1)), np.maximum(out.column(0), out.column(1))]), axis=1)
            yield pairs_of([(pair[0], pair[1])])

    return dealt.mapInArrow(lean(run), "a long, b long")


def true_edges(docs: DataFrame, members: DataFrame, width: int, percent: int, repeated: bool) -> list[DataFrame]:
    """Links among the members (rep, p, q, family, chunks) of candidate families, as spanning forests."""
    small = members.count() <= BROADCAST_ROWS
    named = docs.select(F.col("doc_id").alias("rep"), "text").join(F.broadcast(members) if small else members, "rep")

    def right(batches):
        """Rows whose text has the member's set: an id may stand for several texts."""
        for batch in batches:
            data, borders = hashing.texts(batch.column(1))
            for a, b in hashing.chunks(borders):
                found = hashing.word_shingles(data[borders[a] : borders[b]], borders[a : b + 1] - borders[a], width)
                p, q = batch.column(2).to_pylist()[a:b], batch.column(3).to_pylist()[a:b]
                keep = [a + k for k, u in enumerate(found) if fingerprint(u) == (p[k], q[k])]
                yield batch.take(pa.array(keep, pa.int64()))

    full = named.select("rep", "text", "p", "q", "family", "chunks").mapInArrow(lean(right), "rep long, body string, p long, q long, family long, chunks int") if repeated else named.withColumnRenamed("text", "body")
    if repeated:
        full = full.dropDuplicates(["rep", "p", "q"])

    def sets(bodies):
        data, borders = hashing.texts(bodies)
        return [u for a, b in hashing.chunks(borders) for u in hashing.word_shingles(data[borders[a] : borders[b]], borders[a : b + 1] - borders[a], width)]

    # texts pack better than their sets
    return verified(full, sets, lambda common, n, m: 100 * common >= percent * (n + m - common))


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hot = frequent(docs, width)
    while True:
        found = save(features(docs, width, percent, hot), "features")
        classes = found.where("n > 0 AND doc_id IS NOT NULL").groupBy("p", "q").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("keys").alias("keys"))
        classes = save(classes, "classes")
        buckets = classes.select("rep", F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")).where("rows > 1")
        # buckets of the same classes (by a 128-bit hash of their ids) ask the same questions; one of them is kept
        counted = save(buckets.groupBy("rows", "x", "y").agg(F.min("key").alias("key")).select("key", "rows"), "buckets")
        most = max(HOT, int(HOT_SHARE * classes.count()))
        new = [r["key"] for r in counted.where(F.col("rows") > most).select("key").collect()]  # under 1 / HOT_SHARE times a prefix's length
        new = np.setdiff1d(np.array(new, np.int64).view(np.uint64), hot)
        if not len(new):
            break
        hot = np.concatenate([hot, new])
        release(found, classes, counted)
    candidates = save(candidate_edges(classes, percent, counted), "candidates")
    families = components(candidates)
    release(candidates, counted)
    roots = families.select("component").distinct()
    ids = families.select(F.col("id").alias("rep"), F.col("component").alias("family")).unionByName(roots.select(F.col("component").alias("rep"), F.col("component").alias("family")))
    members = save(ids.join(classes.select("rep", "p", "q", F.col("n").cast("long").alias("weight")), "rep"), "members")
    named = save(sized(members).drop("weight"), "members")
    release(members)
    ids = found.where("doc_id IS NOT NULL").agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    links = true_edges(docs, named, width, percent, ids[0] > ids[1])
    parts = components(functools.reduce(DataFrame.unionByName, links))
    release(named)
    named = classes.select("p", "q", "rep").join(parts, F.col("rep") == F.col("id"), "left").select("p", "q", F.coalesce("component", "rep").alias("component_id"))
    rows = found.select("doc_id", "n", F.when(F.col("n") > 0, F.col("p")).alias("p"), "q")
    rows = rows.join(named, ["p", "q"], "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
l2 AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l2.b FROM r JOIN l2 ON r.b = l2.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""
