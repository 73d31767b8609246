"""Vectorised character kernels: code points, letters and hashed character n-grams of Arrow text slices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lethe.llm._words import pieces

SPACE = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-cased letter of each code point; a space for everything else."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts and their bounds; malformed bytes read as U+FFFD."""
    raw = data.tobytes()
    cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    if lead[-1] == len(cp):
        return cp, lead[bounds]
    each = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for a, b in zip(bounds, bounds[1:])]
    return np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))


def letter_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the texts with one space for whatever stands between them, and the bounds."""
    cp, at = code_points(data, bounds)
    x = letters()[cp]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != SPACE) | (x[:-1] != SPACE)
    starts = at[:-1][at[:-1] < len(x)]
    keep[starts] = True
    to = np.zeros(len(x) + 1, np.int64)
    np.cumsum(keep, out=to[1:])
    return x[keep], to[at]


_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def hashed(x: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features (below 1 << bits) of all n-grams inside the texts, text by text, and their bounds."""
    n = len(x)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found, of = [], []
    for k in orders:
        if k > n:
            continue
        h = np.full(n - k + 1, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
        for j in range(k):
            h = (h ^ x[j : n - k + 1 + j]) * _FACTORS[j]
            h ^= h >> np.uint32(15)
        ok = room[: n - k + 1] >= k
        found.append((h[ok] >> np.uint32(32 - bits)).astype(np.int32))
        of.append(owner[: n - k + 1][ok])
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    of_ = np.concatenate(of)
    order = np.argsort(of_, kind="stable")
    return np.concatenate(found)[order], np.append(0, np.cumsum(np.bincount(of_, minlength=len(bounds) - 1)))


def text_features(texts: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, features, bounds, whether the row has a letter) of slices of texts."""
    for lo, hi, data, bounds in pieces(texts):
        x, at = letter_runs(data, bounds)
        some = np.zeros(len(x) + 1, np.int64)
        np.cumsum(x != SPACE, out=some[1:])
        f, to = hashed(x, at, orders, bits)
        yield lo, hi, f, to, some[at[1:]] > some[at[:-1]]
