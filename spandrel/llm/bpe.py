"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved down to short leaves, which are encoded on their own. Two neighbours are joined by re-encoding a window
around their border. The window ends at safe cuts: positions between a character that is no white space and an ASCII
space. No alternative of the split pattern matches white space after anything else, so the pattern always ends a match
there and starts afresh behind it, whatever stands further away; tokens outside such a window are therefore final. A
window without a safe cut on both sides is doubled, up to the whole pair. Decoding concatenates the tokens' bytes up a
tree.

Defined results: a null text counts as empty and gives no ids; ids that are null decode to no bytes; an id outside the
vocabulary raises. Texts of any length are handled whole, and rows are independent, so there is no shuffle.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import lean, read

RANKS = "byte_bpe_50k.tiktoken"
#: Characters, and ids in decoding, of a leaf: short enough that most texts are put together from several.
LEAF = 512
WINDOW = 64
NONE = np.zeros(0, np.uint32)


class Codec:
    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.length_of = np.array([len(x) for x in self.bytes_of], np.int64)
        self.leaf = leaf

    def plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()) if text else NONE

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self.plain(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """The ids of left + right from those of both sides."""
        if not left or not right:
            return b if not left else a
        reach = WINDOW
        while True:
            low = last_cut(left, max(0, len(left) - reach))
            high = first_cut(left[-1], right, min(len(right), reach))
            if reach >= len(left):
                low = max(low, 0)
            if reach >= len(right) and high < 0:
                high = len(right)
            if low >= 0 and high >= 0:
                break
            reach *= 2
        kept_a = self.count_back(a, len(left[low:].encode())) if low else 0
        kept_b = self.count_on(b, len(right[:high].encode())) if high < len(right) else len(b)
        return np.concatenate([a[:kept_a], self.plain(left[low:] + right[:high]), b[kept_b:]])

    def count_back(self, ids: np.ndarray, n: int) -> int:
        """How many ids stand before the last n bytes; a safe cut is always a border between ids."""
        at = len(ids)
        while n:
            at -= 1
            n -= int(self.length_of[ids[at]])
        return at

    def count_on(self, ids: np.ndarray, n: int) -> int:
        at = 0
        while n:
            n -= int(self.length_of[ids[at]])
            at += 1
        return at

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def last_cut(text: str, start: int) -> int:
    """The last i >= start with white-space-free text[i - 1] and text[i] a space, or -1."""
    at = len(text)
    while (at := text.rfind(" ", max(start, 1), at)) > 0:
        if not text[at - 1].isspace():
            return at
    return -1


def first_cut(before: str, text: str, end: int) -> int:
    """The first i < end with text[i] a space and no white space in front of it, or -1."""
    at = -1
    while (at := text.find(" ", at + 1, end)) >= 0:
        if not (text[at - 1] if at else before).isspace():
            return at
    return -1


@functools.lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(ranks_path, pattern)


def tokenizer_file(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """df with column `ids`: the text's ids as little-endian unsigned 32-bit integers."""
    out = df.drop(ids) if ids != text else df
    where = out.columns.index(text)

    def run(batches):
        c = codec(*tokenizer_file(ranks))
        for batch in batches:
            found = [c.encode(x or "").astype("<u4").tobytes() for x in map(pa.StringScalar.as_py, batch.column(where))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, ids])

    return out.mapInArrow(lean(run), T.StructType([*out.schema, T.StructField(ids, T.BinaryType())]))


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """df with column `decoded`: the bytes that the ids stand for."""
    out = df.drop(decoded)
    where = out.columns.index(ids)

    def run(batches):
        c = codec(*tokenizer_file(ranks))
        for batch in batches:
            found = [c.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, decoded])

    return out.mapInArrow(lean(run), T.StructType([*out.schema, T.StructField(decoded, T.BinaryType())]))


def code(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """decode(encode(df)) less the text, in one Python worker a task instead of two that each hold a codec."""
    out = df.drop(ids, decoded) if text not in (ids, decoded) else df
    where, rest = out.columns.index(text), [c for c in out.columns if c != text]

    def run(batches):
        c = codec(*tokenizer_file(ranks))
        for batch in batches:
            found, back = [], []
            for x in batch.column(where):
                some = c.encode(x.as_py() or "")
                found.append(some.astype("<u4").tobytes())
                back.append(c.decode(some))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(found, pa.binary()), pa.array(back, pa.binary())], names=[*rest, ids, decoded])

    fields = [f for f in out.schema if f.name != text]
    return out.mapInArrow(lean(run), T.StructType([*fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())]))


def digests(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(code(read(spark, sf_dir, "documents").select("doc_id", "text")))
