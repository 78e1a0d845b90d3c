"""Token counts that follow edits.

Each document keeps a segment tree whose leaves are pre-token runs of its text (pieces that end where a space follows
something that is no white space, so that no pre-token crosses them) and whose inner nodes are sums of token counts. An
edit replaces text[start:end]; only the leaves it touches, with one leaf of context on both sides, are split and encoded
again, and the sums above them are updated. A tree is a treap kept in order by size, so that leaves can be put in and
taken out anywhere in logarithmic time.

Defined results: a null text counts as empty; edits that are null or none leave the count as it is; an edit's bounds are
clipped to the text, and an inserted null counts as ''. Edits are applied in order, each on the text the one before left.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.bpe import RANKS, codec, tokenizer_file
from spandrel.llm.common import lean, read

#: Characters a leaf comes to before it is closed at the next safe cut.
LEAF = 512
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())]))


def pieces(text: str, leaf: int = LEAF) -> list[str]:
    """text cut before spaces that follow no white space, each piece at least `leaf` long but for the last."""
    out, start, at = [], 0, leaf
    while (at := text.find(" ", max(at, 1))) >= 0:
        if text[at - 1].isspace():
            at += 1
            continue
        out.append(text[start:at])
        start, at = at, at + leaf
    return [*out, text[start:]] if start < len(text) else out


class Node:
    __slots__ = ("text", "own", "weight", "left", "right", "chars", "tokens")

    def __init__(self, text: str, own: int, weight: float):
        self.text, self.own, self.weight = text, own, weight
        self.left = self.right = None
        self.sum()

    def sum(self) -> None:
        self.chars, self.tokens = len(self.text), self.own
        for side in (self.left, self.right):
            if side:
                self.chars += side.chars
                self.tokens += side.tokens


def merge(a, b):
    if not a or not b:
        return a or b
    if a.weight > b.weight:
        a.right = merge(a.right, b)
        a.sum()
        return a
    b.left = merge(a, b.left)
    b.sum()
    return b


def split(node, at: int):
    """Leaves that end at or before character `at`, and the rest."""
    if not node:
        return None, None
    before = node.left.chars if node.left else 0
    if before + len(node.text) <= at:
        a, b = split(node.right, at - before - len(node.text))
        node.right = a
        node.sum()
        return node, b
    a, b = split(node.left, at)
    node.left = b
    node.sum()
    return a, node


def leaves(node) -> list:
    out, stack = [], []
    while stack or node:
        while node:
            stack.append(node)
            node = node.left
        node = stack.pop()
        out.append(node)
        node = node.right
    return out


def edge(node, last: bool):
    while (step := node.right if last else node.left):
        node = step
    return node


class Counted:
    """A text with its token count; encoded: characters encoded so far, to show what edits cost."""

    def __init__(self, text: str, count, leaf: int = LEAF):
        self.count, self.leaf, self.encoded, self.random = count, leaf, 0, random.Random(0)
        self.root = self.build(text)

    def build(self, text: str):
        root = None
        for piece in pieces(text, self.leaf):
            root = merge(root, Node(piece, self.count(piece), self.random.random()))
        self.encoded += len(text)
        return root

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def text(self) -> str:
        return "".join(x.text for x in leaves(self.root))

    def edit(self, start: int, end: int, text: str) -> None:
        total = self.root.chars if self.root else 0
        start = min(max(start, 0), total)
        end = min(max(end, start), total)
        before, rest = split(self.root, max(start - 1, 0))
        # a leaf that ends at `start` is touched too: its end may no longer be a safe cut
        if before:
            before, near = split(before, before.chars - len(edge(before, True).text))
            rest = merge(near, rest)
        at = before.chars if before else 0
        touched, after = split(rest, end - at)
        if after:  # the leaf that holds `end`, and as context the one behind it
            for _ in range(2):
                if after:
                    near, after = split(after, len(edge(after, False).text))
                    touched = merge(touched, near)
        old = "".join(x.text for x in leaves(touched))
        new = old[: start - at] + text + old[end - at :]
        self.root = merge(merge(before, self.build(new)), after)


def edit_counts(df: DataFrame, text: str = "text", edits: str = "edits", ranks: str = RANKS) -> DataFrame:
    """df with n_tokens (of the text), n_tokens_edited (after the edits), n_chars_edited and n_chars_reencoded."""
    names = ("n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_reencoded")
    out = df.drop(*names)
    at_text, at_edits = out.columns.index(text), out.columns.index(edits)

    def run(batches):
        count = lambda x, c=codec(*tokenizer_file(ranks)): len(c.plain(x))
        for batch in batches:
            rows = []
            for value, changes in zip(batch.column(at_text), batch.column(at_edits)):
                doc = Counted(value.as_py() or "", count)
                first, read_ = doc.tokens, doc.encoded
                for x in changes.as_py() or ():
                    if x and x["start"] is not None and x["end"] is not None:
                        doc.edit(x["start"], x["end"], x["text"] or "")
                rows.append((first, doc.tokens, doc.root.chars if doc.root else 0, doc.encoded - read_))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return out.mapInArrow(lean(run), T.StructType([*out.schema, *(T.StructField(n, T.LongType()) for n in names)]))


def sample_edits(length):
    """Three edits spread over a text of that many characters: an insertion, a deletion and a replacement."""
    third = F.floor(length / 3)
    made = lambda start, end, text: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(text).alias("text"))
    return F.array(made(third, third, " an added remark"), made(third * 2, third * 2 + 7, ""), made(F.lit(0), F.lit(3), "It's 2026: "))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("edits", sample_edits(F.coalesce(F.length("text"), F.lit(0))))
    return edit_counts(docs).drop("text", "edits")
