"""Token-id files with keyed access through a minimal perfect hash.

Documents are range-sorted by id, encoded and packed into shard files of about SHARD_IDS ids. A shard file is one byte
string (layout below) and stands on its own; files travel as rows of a table that Spark's writer commits, so a lost
executor leaves no half file and any store that Spark can write will do. `export` puts them into a folder as .tok files.

Layout, little-endian: magic "SPTK1\\0\\0\\0"; 8 unsigned 64-bit numbers: keys, records, ids, levels of the hash, bytes of
its bits, records under a null key, 0, 0; then the sections: level sizes (u64), bits, fingerprint per key slot (u32),
first record per key slot (u64), records per key slot (u32), record borders (u64, records + 1), ids (u16), and the keys in
order (i64). The hash is a cascade of bit arrays (Limasset et al., 2017): a key that is alone at its place in a level
sets the bit there, the others go on to the next level; a key's slot is the number of bits set before its own.

Defined results: a null text counts as empty and has the end id alone; rows with a null id come first and are kept under
the null key; rows that share an id are separate records, in the order of their texts' checksums; an empty table gives no
files and no rows. Keys that were never stored are found absent by fingerprint but for one in 2**32.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import lean, read, save, small_table, sorted_parts

TOKENIZER = "word_bpe_49k.json"
END = 1
SHARD_IDS = 1 << 22
#: Words whose ids a worker keeps; the store is emptied when full.
CACHE = 700_000
BEFORE_STOP = re.compile("(?<=[a-z\u00e0-\u00f6\u00f8-\u00ff])(?=[.,])")
MAGIC = b"SPTK1\0\0\0"
GAMMA = 2


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct keys, from bit arrays of about three bits a key."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype(np.int64), bits
        self.before = np.concatenate([[0], np.cumsum(bits)])
        self.offset = np.concatenate([[0], np.cumsum(self.sizes)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, rest = [], [], keys
        while len(rest):
            m = GAMMA * len(rest) + 1
            at = (mix(rest, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1: surely not a stored key."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            at = self.offset[level] + (mix(keys[open_], level) % np.uint64(m)).astype(np.int64)
            hit = self.bits[at].astype(bool)
            out[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def pack(keys: list, records: list[bytes]) -> bytes:
    """A shard file of records (ids as u16 bytes) under keys (integers or None, equal ones adjacent, None first)."""
    nulls = sum(k is None for k in keys)
    every = np.array([k for k in keys if k is not None], np.int64)
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    first = np.nonzero(new)[0]
    distinct = every[first]
    count = np.diff(np.append(first, len(every)))
    unsigned = distinct.view(np.uint64)
    hashed = PerfectHash.build(unsigned)
    slot = hashed.slots(unsigned)
    prints, firsts, counts = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u8"), np.zeros(len(distinct), "<u4")
    prints[slot] = (mix(unsigned, 99) >> np.uint64(32)).astype("<u4")
    firsts[slot] = first + nulls
    counts[slot] = count
    borders = np.concatenate([[0], np.cumsum([len(r) // 2 for r in records])]).astype("<u8")
    bits = np.packbits(hashed.bits)
    head = struct.pack("<8Q", len(distinct), len(records), int(borders[-1]), len(hashed.sizes), len(bits), nulls, 0, 0)
    sections = (hashed.sizes.astype("<u8"), bits, prints, firsts, counts, borders)
    return b"".join([MAGIC, head, *(s.tobytes() for s in sections), *records, distinct.astype("<i8").tobytes()])


class TokenFile:
    """A shard file opened for keyed access."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_keys, self.n_records, self.n_ids, levels, n_bits, self.nulls, _, _ = struct.unpack_from("<8Q", data, 8)
        at = 72

        def section(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        sizes, bits = section("<u8", levels), section("u1", n_bits)
        self.hash = PerfectHash(sizes, np.unpackbits(bits, count=int(sizes.sum()) if levels else 0))
        self.prints, self.firsts, self.counts = section("<u4", self.n_keys), section("<u8", self.n_keys), section("<u4", self.n_keys)
        self.borders, self.ids, self.keys = section("<u8", self.n_records + 1), section("<u2", self.n_ids), section("<i8", self.n_keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; no records for absent ones."""
        unsigned = np.asarray(keys, np.int64).view(np.uint64)
        slot = self.hash.slots(unsigned)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == (mix(unsigned[known], 99) >> np.uint64(32)).astype(np.uint32)
        first, count = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        first[known], count[known] = self.firsts[slot[known]], self.counts[slot[known]]
        return first, count

    def record(self, k: int) -> np.ndarray:
        return self.ids[int(self.borders[k]) : int(self.borders[k + 1])]

    def get(self, key: int | None) -> list[np.ndarray]:
        if key is None:
            return [self.record(k) for k in range(self.nulls)]
        first, count = self.find(np.array([key], np.int64))
        return [self.record(int(first[0]) + k) for k in range(int(count[0]))]


class Words:
    """Encodes texts word by word. The tokenizer splits at white space and never looks across it, and spaces leave no ids,
    so a text's ids are those of the parts between its spaces, one after the other. In Latin-1 texts it also lower-cases
    letter by letter and always splits between a letter and a dot or comma, so this is done first: fewer words differ."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges for words that need neither normalizing nor splitting
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, texts: list[str], bare: bool = False) -> list[np.ndarray]:
        return [np.array(x.ids, "<u2") for x in (self.bare if bare else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        # a run of lower-case Latin letters is one unit of the tokenizer and ends with its only word-final token
        plain = [w for w in words if w.isalpha() and w == w.lower() and max(w) < "\u0250"]
        for k in range(0, len(plain), 1024):
            some = plain[k : k + 1024]
            ids = self.ids([" ".join(some)], bare=True)[0]
            borders = [0, *((np.nonzero(self.ends[ids])[0] + 1) * 2).tolist()]
            if len(borders) != len(some) + 1:
                raise ValueError("the vocabulary has no word-final tokens")
            data = ids.tobytes()
            self.known.update(zip(some, (data[a:b] for a, b in zip(borders, borders[1:]))))
        rest = list(set(words).difference(plain))
        for k in range(0, len(rest), 1024):
            some = rest[k : k + 1024]
            self.known.update(zip(some, (x.tobytes() for x in self.ids(some))))

    def parts(self, text: str) -> list[str]:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = BEFORE_STOP.sub(" ", text.lower())
            except UnicodeEncodeError:
                pass
        return text.split(" ")

    def know(self, words: set) -> None:
        missing = words.difference(self.known)
        if missing and len(self.known) + len(missing) > CACHE:
            self.known = {"": b""}
            missing = words - {""}
        if missing:
            self.learn(list(missing))

    def encode(self, text: str) -> bytes:
        parts, out = self.parts(text), []
        for k in range(0, len(parts), CACHE // 2):  # a very long text in steps whose words fit the store
            some = parts[k : k + CACHE // 2]
            self.know(set(some))
            out += map(self.known.__getitem__, some)
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out, k = [], 0
        while k < len(texts):
            held, n = [], 0
            while k < len(texts) and n + len(texts[k]) < CACHE:  # a group's words fit the store
                held.append(self.parts(texts[k]))
                n += len(texts[k])
                k += 1
            if held:
                self.know(set().union(*held))
                known = self.known.__getitem__
                out += [b"".join(map(known, x)) for x in held]
            else:
                out.append(self.encode(texts[k]))
                k += 1
        return out


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def write(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = TOKENIZER, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """A saved table of shard files in ascending order of doc_id: part, seq, n_ids, low, high (keys), data."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    narrow = narrow.withColumn("sum", F.crc32("text"))
    parts = sorted_parts(narrow, F.col("doc_id").asc_nulls_first(), "sum").select(F.col("_pid").cast("long").alias("part"), "doc_id", "text")
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("data", pa.binary())])
    last = np.array([end], "<u2").tobytes()

    def run(batches):
        import public_tokenizers

        encoder = words(public_tokenizers.path(tokenizer))
        keys, records, n, seq, part = [], [], 0, 0, None

        def file():
            known = [k for k in keys if k is not None]
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_ids": n, "low": min(known, default=None), "high": max(known, default=None), "data": pack(keys, records)}], schema=schema)

        for batch in batches:
            for at, key, body in zip(*(batch.column(k).to_pylist() for k in range(2)), encoder.encode_all(batch.column(2).to_pylist())):
                if part != at or n >= shard_ids and key != keys[-1]:  # records of one key stay in one file
                    if keys:
                        yield file()
                        seq += 1
                    keys, records, n, part = [], [], 0, at
                keys.append(key)
                records.append(body + last)
                n += len(records[-1]) // 2
        if keys:
            yield file()

    return save(parts.mapInArrow(lean(run), "part long, seq int, n_ids long, low long, high long, data binary"), "tokens")


def starts(files: DataFrame) -> DataFrame:
    """files with column start: the ids in all files before. One row per file reaches the driver."""
    at, rows = 0, []
    for r in sorted(files.select("part", "seq", "n_ids").collect()):
        rows.append((r["part"], r["seq"], at))
        at += r["n_ids"]
    table = small_table(files.sparkSession, "part long, seq int, start long", rows)
    return files.join(F.broadcast(table), ["part", "seq"])  # a file holds millions of ids, so there are few files


def records(files: DataFrame) -> DataFrame:
    """doc_id, start and ids (little-endian u32) of every record, each found by its key through the file's hash."""

    def run(batches):
        for batch in batches:
            for start, data in zip(batch.column(0), batch.column(1)):
                file, base = TokenFile(data.as_py()), start.as_py()
                first, count = file.find(file.keys)
                at = [*range(file.nulls), *(f + k for f, c in zip(first.tolist(), count.tolist()) for k in range(c))]
                keys = [None] * file.nulls + np.repeat(file.keys, count).tolist()
                for k in range(0, len(at), 1024):
                    some = at[k : k + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 1024], pa.int64()), pa.array([base + int(file.borders[r]) for r in some], pa.int64()), pa.array([file.record(r).astype("<u4").tobytes() for r in some], pa.binary())], names=["doc_id", "start", "ids"])

    return starts(files).select("start", "data").mapInArrow(lean(run), "doc_id long, start long, ids binary")


def lookup(files: DataFrame, key: int) -> list[np.ndarray]:
    """The ids of every record under key: only files whose range holds it are read."""
    found = files.where((F.col("low") <= key) & (F.col("high") >= key)).select("data").toLocalIterator()
    return [ids for r in found for ids in TokenFile(bytes(r["data"])).get(key)]


def export(files: DataFrame, folder: str) -> int:
    """Write every shard file into a folder that the driver sees, as <number>.tok; returns how many."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in files.orderBy("part", "seq").select("data").toLocalIterator():
        with open(os.path.join(folder, f"{n:06d}.tok"), "wb") as out:
            out.write(r["data"])
        n += 1
    return n


def query(spark, sf_dir: str) -> DataFrame:
    found = records(write(read(spark, sf_dir, "documents")))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
