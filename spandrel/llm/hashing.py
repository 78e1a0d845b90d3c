"""Vectorised hashing of words and shingles in byte buffers, shared by the joins on word and character shingles."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from spandrel.llm.common import SCRATCH

ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 2**64)
U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + U(ODD * (salt + 1) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(size, U), np.ones(size, U)
    up[1:], down[1:] = U(ODD), U(INVERSE)
    return np.cumprod(up), np.cumprod(down)


SCRATCH.append(_powers)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    return _powers(size)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the borders of its texts (null: empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[borders[0] : borders[-1]], borders - borders[0]


def chunks(borders: np.ndarray, most: int = 1 << 19):
    """Ranges of texts that come to about `most` bytes; a longer text stands alone."""
    k, n = 0, len(borders) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(borders, borders[k] + most, side="right")) - 1)
        yield k, end
        k = end


def word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and how many words each text has."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(borders) - 1, np.int64)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    new = np.zeros(len(data) + 1, bool)
    new[borders] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | new[1:-1]
    end[:-1] &= ~word[1:] | new[1:-1]
    s, e = np.nonzero(start)[0], np.nonzero(end)[0] + 1
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)])])
    h = (sums[e] - sums[s]) * down[s]
    counts = np.diff(np.searchsorted(s, borders))
    return mix(h + (e - s).astype(U) * U(0xD6E8FEB86659FD93)), counts


def word_shingles(data: np.ndarray, borders: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted hashes; a text of fewer words has its whole sequence as one."""
    words, counts = word_hashes(data, borders)
    first = np.concatenate([[0], np.cumsum(counts)])
    factors = [U(pow(ODD, k + 2, 2**64)) for k in range(width)]
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, U)
    for k, f in enumerate(factors):
        rolled += words[k : k + n] * f
    rolled = mix(rolled, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            total = sum((int(w) * int(f) for w, f in zip(words[a:b], factors)), (b - a) << 7) % 2**64
            out.append(mix(np.array([total], U), width + 1))
        else:
            out.append(np.zeros(0, U))
    return out
