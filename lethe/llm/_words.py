"""Vectorised word kernels shared by the Arrow-batched operators.

Texts arrive as Arrow string arrays; every function here works on the UTF-8
bytes of a slice of them at once, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; bounds a worker's memory whatever the batch.
CHUNK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    byte = np.arange(256)
    low = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    spread = mix((low.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD))
    space = (byte == 32) | ((byte >= 9) & (byte <= 13))
    alnum = (byte >= 128) | ((byte >= 48) & (byte <= 57)) | ((low >= 97) & (low <= 122))
    return {"spread": spread, "exact": mix((byte.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)), "space": ~space, "alnum": alnum}


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, 0, np.uint64)
    down = np.full(n, 0, np.uint64)
    up[:] = np.uint64(_ODD)
    down[:] = np.uint64(pow(_ODD, -1, 1 << 64))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def room_for(n: int) -> int:
    """n or a little more, so that about equal slices share their tables."""
    return (n // (1 << 18) + 1) << 18


class Words:
    """Words of consecutive texts.

    ``ptr[i]:ptr[i + 1]`` are the words of text ``i``; ``start``/``end`` are byte
    offsets in ``data`` and ``hash`` is a 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: str, fold: bool = True):
        t = _tables()
        self.data, self.bounds = data, bounds
        inside = t[kind][data]
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.ptr = np.searchsorted(self.start, bounds)
        up, down = _powers(room_for(len(data)))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(t["spread" if fold else "exact"][data] * up[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.ptr[1:], self.counts()) - np.arange(len(self))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; only meaningful where they fit."""
    out = np.zeros(len(h), np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for j in range(n):
        out *= _GRAM
        out += padded[j : j + len(h)]
    return mix(out + np.uint64(n))


def grams_at(h: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    """grams(h, n)[pos], computed only there."""
    out = np.zeros(len(pos), np.uint64)
    for j in range(n):
        out *= _GRAM
        out += h[pos + j]
    return mix(out + np.uint64(n))


def ends(edge: np.ndarray, n: int) -> np.ndarray:
    """Where the groups that start at edge end, of n entries."""
    return np.append(edge[1:], n)[: len(edge)]


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of runs of texts of about ``limit`` bytes; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, flat[at[lo] : at[hi]], (at[lo : hi + 1] - at[lo]).astype(np.int64)
        lo = hi
