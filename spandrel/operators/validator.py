"""Layout reconstruction: how far a parsed grid can be traced back to the positioned tokens it came from.

Tokens align by text (by occurrence where they repeat), then glued or split words are matched as runs. Alignment is
procedural and runs once per table; the score is SQL over the matched pairs.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.text import number_sign

#: What each violation weighs.
WEIGHTS = {"missing": 0.35, "spurious": 0.10, "row": 0.15, "col": 0.15, "split": 0.10, "permutation": 0.15, "sign": 0.15}
PAIRS = "table_id string, place int, kind string, obs_text string, hyp_text string, obs_row int, obs_col int, hyp_row int, hyp_col int"


def plain(s: str) -> str:
    return "".join(c for c in s if c.isalnum()).lower()


def row_bands(y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    middle, height = (y0 + y1) / 2, np.sort(y1 - y0)
    order = np.argsort(middle, kind="stable")
    step = np.diff(middle[order]) > max(height[len(height) // 2] * 0.9, 2.0)
    out = np.empty(len(order), int)
    out[order] = np.concatenate([[0], np.cumsum(step)])
    return out


def col_bands(x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    wide = np.sort(x1 - x0)
    order = np.argsort(x0, kind="stable")
    reach = np.maximum.accumulate(x1[order])
    step = x0[order][1:] - reach[:-1] > max(wide[len(wide) // 2] * 0.5, 4.0)
    out = np.empty(len(order), int)
    out[order] = np.concatenate([[0], np.cumsum(step)])
    return out


class Ribbon:
    """Words laid end to end, so that a run of whole words that spells a text is found by searching for the text."""

    def __init__(self, numbers: list[int], texts: list[str]):
        self.numbers, self.texts = numbers, [texts[k] for k in numbers]
        self.borders = {at: k for k, at in enumerate([0, *accumulate(map(len, self.texts))])}
        self.whole = "".join(self.texts)

    def take(self, text: str) -> list[int]:
        """The numbers of the first run that spells text, which then leaves the ribbon; none if there is no such run."""
        at = -1
        while (at := self.whole.find(text, at + 1)) >= 0:
            first, last = self.borders.get(at), self.borders.get(at + len(text))
            if first is not None and last is not None:
                run = self.numbers[first:last]
                rest = [k for k in range(len(self.numbers)) if not first <= k < last]
                self.__init__([self.numbers[k] for k in rest], dict(zip(self.numbers, self.texts)))
                return run
        return []


def by_occurrence(words: list[str]) -> dict:
    """The number of each word by the word and how often it came before."""
    seen: Counter = Counter()
    out = {}
    for k, w in enumerate(words):
        out[w, seen[w]] = k
        seen[w] += 1
    return out


def align(obs: list[str], hyp: list[str]) -> list[tuple]:
    """(obs, hyp) numbers of matches, with None for what stays alone; both lists in reading order, in plain form.

    Equal words match by occurrence; then one word here may be several there, and the other way round.
    """
    here, there = by_occurrence(obs), by_occurrence(hyp)
    pairs = sorted((i, there[key]) for key, i in here.items() if key in there)
    alone = sorted(i for key, i in here.items() if key not in there)
    spare = Ribbon(sorted(j for key, j in there.items() if key not in here), hyp)
    split = {i: spare.take(obs[i]) for i in alone}
    left = Ribbon([i for i in alone if not split[i]], obs)
    glued = {j: left.take(hyp[j]) for j in spare.numbers}
    pairs += [(i, j) for i, run in split.items() for j in run] + [(i, j) for j, run in glued.items() for i in run]
    return pairs + [(i, None) for i in left.numbers] + [(None, j) for j, run in glued.items() if not run]


def matched_pairs(obs: DataFrame, hyp: DataFrame) -> DataFrame:
    """PAIRS rows for observed tokens (table_id, text, x0..y1) and parsed cells (table_id, row, col, text)."""
    left = obs.select("table_id", F.lit(0).alias("side"), "text", "x0", "y0", "x1", "y1", F.lit(0).alias("row"), F.lit(0).alias("col"))
    zero = F.lit(0.0).cast("float")
    right = hyp.select("table_id", F.lit(1).alias("side"), "text", zero.alias("x0"), zero.alias("y0"), zero.alias("x1"), zero.alias("y1"), "row", "col")

    def one(table, side, text, box, row, col) -> list[tuple]:
        seen, parsed = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        parsed = parsed[np.lexsort((col[parsed], row[parsed]))]
        if len(seen):
            row[seen], col[seen] = row_bands(box[seen, 1], box[seen, 3]), col_bands(box[seen, 0], box[seen, 2])
            seen = seen[np.lexsort((box[seen, 0], row[seen]))]
        o = [(text[k], int(row[k]), int(col[k])) for k in seen if plain(text[k])]
        h = [(w, int(row[k]), int(col[k])) for k in parsed for w in text[k].split() if plain(w)]
        out = []
        for i, j in align([plain(x[0]) for x in o], [plain(x[0]) for x in h]):
            x, y = o[i] if i is not None else (None,) * 3, h[j] if j is not None else (None,) * 3
            out.append((table, len(out), "missing" if j is None else "spurious" if i is None else "matched", x[0], y[0], x[1], x[2], y[1], y[2]))
        return out

    names = [c.split()[0] for c in PAIRS.split(", ")]

    def run(batches):
        """Tables are small and many: they are cut out of sorted batches by their borders instead of one call each."""
        held = None
        for pdf in chain(batches, [None]):
            last = pdf is None
            held = pdf if held is None else held if last else pd.concat([held, pdf], ignore_index=True)
            if held is None or not len(held):
                continue
            ids = held.table_id.to_numpy()
            cuts = [0, *(np.nonzero(ids[1:] != ids[:-1])[0] + 1).tolist()] + ([len(held)] if last else [])
            side, text, box = held.side.to_numpy(), held.text.fillna("").tolist(), held[["x0", "y0", "x1", "y1"]].to_numpy()
            row, col = held.row.to_numpy().copy(), held["col"].to_numpy().copy()
            rows = [r for a, b in zip(cuts, cuts[1:]) for r in one(ids[a], side[a:b], text[a:b], box[a:b], row[a:b], col[a:b])]
            if rows:
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({c: "Int32" for c in ("place", "obs_row", "obs_col", "hyp_row", "hyp_col")})
            held = None if last else held.iloc[cuts[-1] :].reset_index(drop=True)

    both = left.unionByName(right).withColumn("table_id", F.col("table_id").cast("string"))
    return both.repartition("table_id").sortWithinPartitions("table_id", "side").mapInPandas(run, PAIRS)


def score(pairs: DataFrame) -> DataFrame:
    """Per table: error (0 to 1) and its parts, the column permutation, merge and split sites, missing and spurious tokens."""
    hit = pairs.where("kind = 'matched'")
    share = lambda by, other: hit.groupBy("table_id", by).agg((F.countDistinct(other) > 1).cast("double").alias("v")).groupBy("table_id").agg(F.avg("v").alias("v"))
    named = lambda df, n: df.withColumnRenamed("v", n)
    counts = hit.groupBy("table_id", "hyp_col", "obs_col").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    # of equally frequent columns the one matched first
    top = Window.partitionBy("table_id", "hyp_col").orderBy(F.desc("n"), "place")
    main = counts.withColumn("_r", F.row_number().over(top)).where("_r = 1")
    perm = main.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hyp_col", "obs_col"))), lambda s: s.obs_col).alias("permutation"))
    moved = F.size(F.filter(F.zip_with("permutation", F.array_sort("permutation"), lambda a, b: a != b), lambda x: x))
    perm = perm.withColumn("permutation_penalty", moved / F.size("permutation"))
    a, b = number_sign(F.col("obs_text")), number_sign(F.col("hyp_text"))
    signs = hit.where(a.isNotNull() & b.isNotNull()).groupBy("table_id").agg(F.avg((a != b).cast("double")).alias("sign_violations"))
    kinds = pairs.groupBy("table_id").agg(
        F.count_if(F.col("kind") == "matched").alias("n_matched"), F.count_if(F.col("obs_text").isNotNull()).alias("n_obs"), F.count_if(F.col("hyp_text").isNotNull()).alias("n_hyp"),
        F.count_if(F.col("kind") == "spurious").alias("n_spurious"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == "missing", F.col("obs_text")))), 1, 20).alias("missing_tokens"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == "spurious", F.col("hyp_text")))), 1, 20).alias("spurious_tokens"),
    )
    out = kinds
    for part in (named(share("hyp_row", "obs_row"), "row_violations"), named(share("hyp_col", "obs_col"), "col_violations"), named(share("obs_col", "hyp_col"), "split_violations"), perm, signs):
        out = out.join(part, "table_id", "left")
    out = out.fillna(0.0, ["row_violations", "col_violations", "split_violations", "permutation_penalty", "sign_violations"])
    coverage = F.least(F.coalesce(F.col("n_matched") / F.nullif(F.col("n_obs"), F.lit(0)), F.lit(1.0)), F.lit(1.0))
    out = out.withColumns({"coverage": coverage, "spurious_rate": F.coalesce(F.col("n_spurious") / F.nullif(F.col("n_hyp"), F.lit(0)), F.lit(0.0))})
    w = WEIGHTS
    error = w["missing"] * (1 - F.col("coverage")) + w["spurious"] * F.col("spurious_rate") + w["row"] * F.col("row_violations") + w["col"] * F.col("col_violations")
    error = error + w["split"] * F.col("split_violations") + w["permutation"] * F.col("permutation_penalty") + w["sign"] * F.col("sign_violations")
    return out.withColumn("error", F.greatest(F.lit(0.0), F.least(F.lit(1.0), error)))


def validate(obs: DataFrame, hyp: DataFrame) -> DataFrame:
    return score(matched_pairs(obs, hyp))


def sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, true_positive_rate and false_positive_rate over scores (error, corrupted)."""
    taus = scores.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    rate = lambda bad: F.avg(F.when(F.col("corrupted") == bad, (F.col("error") > F.col("threshold")).cast("double")))
    return taus.groupBy("threshold").agg(rate(True).alias("true_positive_rate"), rate(False).alias("false_positive_rate"))


def corrupt(cells: DataFrame, how: str, a: int = 1, b: int = 2) -> DataFrame:
    """A grid (table_id, row, col, text) with one planted error: swap (columns a, b), drop (cell a, b), merge (b into a),
    shift (header row by one column) or transpose (rows and columns of the square at a, b)."""
    row, col, text = F.col("row"), F.col("col"), F.col("text")
    if how == "swap":
        return cells.withColumn("col", F.when(col == a, b).when(col == b, a).otherwise(col))
    if how == "drop":
        return cells.withColumn("text", F.when((row == a) & (col == b), "").otherwise(text))
    if how == "merge":
        joined = F.max(F.when(col == b, text)).over(Window.partitionBy("table_id", "row"))
        return cells.withColumn("text", F.when(col == a, F.concat_ws(" ", text, joined)).when(col == b, "").otherwise(text))
    if how == "shift":
        wide = F.max(col).over(Window.partitionBy("table_id")) + 1
        return cells.withColumn("col", F.when(row == 0, (col + 1) % wide).otherwise(col))
    if how == "transpose":
        inside = row.between(a, a + 1) & col.between(b, b + 1)
        return cells.withColumns({"row": F.when(inside, a + col - b).otherwise(row), "col": F.when(inside, b + row - a).otherwise(col)})
    raise ValueError(f"unknown corruption {how!r}")
