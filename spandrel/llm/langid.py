"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's maximum over the window goes through a
rectifier into a softmax. The network is trained here in numpy by backpropagation on windows drawn from labelled texts.
A text is cut into fixed-length windows that overlap by the widest filter less one byte, so every filter position of the
whole text is seen; a text's probabilities are its windows' averaged by their bytes. For prediction, embedding and
filters are folded into tables over single bytes and byte pairs, looked up for batches of windows.

Training takes at most PER_LANG texts of each language, chosen by hash, and WINDOWS windows of each, spread over the
whole text at random: that bounds what the driver trains on, whatever the table's size.

Defined results: `und` with score 0 for a text that is null, empty or has no letter, and for every text if nothing could
be learned; rows with a null id are neither held out nor learned from; ties go to the language first in order; repeated
rows are predicted each; an empty table gives an empty result; other columns are kept, same-named ones replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import lean, read

LENGTH = 256
FILTER_WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
PER_LANG = 384
WINDOWS = 4
EPOCHS = 8
BATCH = 128
RATE = 0.01
UNKNOWN = "und"
STEP = LENGTH - max(FILTER_WIDTHS) + 1


def windows(n: int) -> np.ndarray:
    """Starts of the windows of n bytes."""
    return np.arange(0, max(1, n - max(FILTER_WIDTHS) + 1), STEP) if n else np.zeros(0, np.int64)


class ByteNet:
    def __init__(self, labels: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.w = {"e": rng.normal(0, 0.3, (256, EMBEDDING))}
        for k in FILTER_WIDTHS:
            self.w[f"f{k}"] = rng.normal(0, (k * EMBEDDING) ** -0.5, (k, EMBEDDING, FILTERS))
            self.w[f"b{k}"] = np.zeros(FILTERS)
        self.w["d"] = rng.normal(0, 0.1, (FILTERS * len(FILTER_WIDTHS), len(labels)))
        self.w["c"] = np.zeros(len(labels))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def forward(self, x: np.ndarray) -> tuple:
        peaks, places = [], []
        for k in FILTER_WIDTHS:
            n = x.shape[1] - k + 1
            out = sum((self.w["e"] @ self.w[f"f{k}"][j])[x[:, j : j + n]] for j in range(k))
            at = out.argmax(1)
            places.append(at)
            peaks.append(np.take_along_axis(out, at[:, None], 1)[:, 0] + self.w[f"b{k}"])
        pooled = np.maximum(np.concatenate(peaks, 1), 0)
        return pooled, places, softmax(pooled @ self.w["d"] + self.w["c"])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        pooled, places, p = self.forward(x)
        d = p
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"d": pooled.T @ d, "c": d.sum(0), "e": np.zeros_like(self.w["e"])}
        back = (d @ self.w["d"].T) * (pooled > 0)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for i, k in enumerate(FILTER_WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{k}"] = part.sum(0)
            g[f"f{k}"] = np.zeros_like(self.w[f"f{k}"])
            for j in range(k):
                table = np.zeros((256, FILTERS), np.float32)
                np.add.at(table, (x[rows, places[i] + j], np.broadcast_to(cols, part.shape)), part)
                g[f"f{k}"][j] = self.w["e"].T @ table
                g["e"] += table @ self.w[f"f{k}"][j].T
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> ByteNet:
        """Adam with a falling step over `epochs` passes."""
        rng, first, second, t = np.random.default_rng(seed), {}, {}, 0
        steps = max(1, -(-len(x) // BATCH)) * epochs
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                t += 1
                rate = RATE * (1 - (t - 1) / steps)
                for name, g in self.gradients(x[order[k : k + BATCH]], y[order[k : k + BATCH]]).items():
                    m = first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    v = second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                    self.w[name] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def folded(self) -> dict:
        """Tables for prediction: the first two bytes of every width by byte pair, the rest by byte or pair."""
        single = {(k, j): self.w["e"] @ self.w[f"f{k}"][j] for k in FILTER_WIDTHS for j in range(k)}
        pair = lambda k, j: (single[k, j][:, None] + single[k, j + 1][None]).reshape(65536, FILTERS)
        heads = np.concatenate([pair(k, 0) + self.w[f"b{k}"] for k in FILTER_WIDTHS], 1)
        tails = {k: [pair(k, j) if j + 1 < k else single[k, j] for j in range(2, k, 2)] for k in FILTER_WIDTHS}
        return {"heads": heads, "tails": tails, "d": self.w["d"], "c": self.w["c"]}


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def window_probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    heads = np.take(net["heads"], pairs, axis=0, mode="clip")
    pooled = []
    for i, k in enumerate(FILTER_WIDTHS):
        n = x.shape[1] - k + 1
        out = heads[:, :n, i * FILTERS : (i + 1) * FILTERS]
        for at, table in enumerate(net["tails"][k]):
            j = 2 * (at + 1)
            by = pairs if len(table) > 256 else x
            out = out + np.take(table, by[:, j : j + n], axis=0, mode="clip")
        pooled.append(out.max(1))
    return softmax(np.maximum(np.concatenate(pooled, 1), 0) @ net["d"] + net["c"])


def probabilities(net: dict, data: np.ndarray, borders: np.ndarray, chunk: int = 48) -> np.ndarray:
    """Row per text: data holds the texts' bytes end to end, borders where they start and end."""
    lengths = np.diff(borders)
    starts = [windows(int(n)) for n in lengths]
    of = np.repeat(np.arange(len(lengths)), [len(s) for s in starts])
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    left = lengths[of] - at
    out = np.zeros((len(lengths), len(net["c"])))
    padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
    steps = np.arange(LENGTH)
    for k in range(0, len(of), chunk):
        s = slice(k, k + chunk)
        x = padded[(borders[of[s]] + at[s])[:, None] + steps]
        x[steps >= left[s][:, None]] = 0
        np.add.at(out, of[s], window_probabilities(net, x) * np.minimum(left[s], LENGTH)[:, None])
    return out / np.maximum(out.sum(1, keepdims=True), 1e-30)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_lang: int = PER_LANG) -> dict | None:
    """Folded tables with labels, or None if no text can be learned from."""
    from pyspark.sql.functions import broadcast

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & (remainder(F.col("id")) != 2)).withColumn("cell", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(per_lang)))
    # the text that hashes lowest in each of per_lang cells of each language; at most per_lang rows a language
    picked = known.groupBy("lang", "cell").agg(F.min_by("id", F.xxhash64(F.lit(12), "id")).alias("id"))
    n_labels = picked.select("lang").distinct().count()
    if not n_labels:
        return None
    chosen = known.select("id", "text", "lang", "cell").join(broadcast(picked), ["id", "lang", "cell"]).where(has_letter(F.col("text")))

    def draw(batches):
        for batch in batches:
            out = []
            for cell, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = np.frombuffer(body.encode(), np.uint8)
                starts = windows(len(data))
                rng = np.random.default_rng([cell, len(data)])
                x = np.zeros((WINDOWS, LENGTH), np.uint8)
                for row, at in zip(x, rng.choice(starts, WINDOWS, replace=len(starts) < WINDOWS)):
                    piece = data[at : at + LENGTH]
                    row[: len(piece)] = piece
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["lang", "cell", "x"])

    drawn = chosen.select("lang", "cell", "text").mapInArrow(lean(draw), "lang string, cell long, x binary")
    found = sorted(tuple(r) for r in drawn.groupBy("lang", "cell").agg(F.min("x").alias("x")).collect())
    if not found:
        return None
    labels = sorted({r[0] for r in found})
    x = np.frombuffer(b"".join(bytes(r[2]) for r in found), np.uint8).reshape(-1, LENGTH)
    y = np.repeat([labels.index(r[0]) for r in found], WINDOWS)
    return ByteNet(labels).train(x, y).folded() | {"labels": labels}


def identify(docs: DataFrame, net: dict | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    out = docs.drop("lang_pred", "score")
    if net is None:
        return out.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of tables, rows by label
    where = out.columns.index(text)
    asked = out.select(*(F.col(f"`{c}`") for c in out.columns), has_letter(F.col(text)).alias("_" * (1 + max(map(len, out.columns)))))

    def run(batches):
        model = shared.value
        labels = pa.array([*model["labels"], UNKNOWN])
        for batch in batches:
            column = batch.column(where).cast(pa.large_string()).fill_null("")
            borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            body = column.buffers()[2]
            data = np.frombuffer(body, np.uint8) if body and body.size else np.zeros(0, np.uint8)
            p = probabilities(model, data[: borders[-1]], borders)
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(letter, p.argmax(1), len(labels) - 1)
            score = np.where(letter, np.clip(p.max(1, initial=0), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], labels.take(pa.array(best)), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return asked.mapInArrow(lean(run), T.StructType([*out.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
