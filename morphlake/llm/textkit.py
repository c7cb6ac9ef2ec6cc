"""Vectorised word and window hashing over Arrow string columns.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes that aren't separators. Hashes are
polynomial sums modulo 2**64 (odd base, so that any window comes from two prefix sums), finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are worked on in slices of about so many bytes, to bound memory.
SLICE = 1 << 19

_pow = {"n": 0, "up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if _pow["n"] < n:
        n = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(n, base, U)
            out[0] = 1
            _pow[name] = np.cumprod(out, dtype=U)
        _pow["n"] = n
    return _pow["up"][:n], _pow["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    white = np.zeros(256, bool)
    white[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
    punct = white.copy()
    for b in range(0x80):
        if not chr(b).isalnum():
            punct[b] = True
    return lower, white, punct


LOWER, WHITE, PUNCT = _tables()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return d, o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row is alone in its range."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """Words of some rows: byte ranges ``start``/``end``, hash ``h``, and per row the range ``first[i]:first[i+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, fold: bool = False):
        n = len(data)
        self.data, self.offsets = data, offsets
        inside = ~separators[data]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            edges = offsets[offsets < n]
            before[edges] = False
            after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, U)
        bytes_ = LOWER[data] if fold else data
        np.cumsum((bytes_.astype(U) + U(1)) * up[:n], out=total[1:])
        self.h = mix((total[self.end] - total[self.start]) * down[self.start])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and which of these windows lie within one row."""
        n = len(self.h)
        last = np.repeat(self.first[1:], np.diff(self.first))
        if n < k:
            return np.zeros(n, U), np.zeros(n, bool)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.h * up[:n], out=total[1:])
        out = np.zeros(n, U)
        out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])
        return out, np.arange(n) + k <= last


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of the rightmost minimum of every run of ``width`` hashes (all, if there are fewer).

    Two equal runs of ``width`` hashes get the same choice, so any match of that many windows shares one.
    """
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= width:
        return np.array([n - 1 - int(np.argmin(h[::-1]))])
    seen = np.lib.stride_tricks.sliding_window_view(h[::-1], width)
    at = n - 1 - (np.arange(len(seen)) + np.argmin(seen, axis=1))
    return np.unique(at)
