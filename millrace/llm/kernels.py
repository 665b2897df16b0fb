"""Vectorised text kernels over Arrow batches: bytes, words, word hashes, shingle hashes.

All of them work on the UTF-8 bytes of many documents at once. A word is `[^\\x20\\x09-\\x0D]+`;
those separators are single ASCII bytes, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240517))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

CHUNK_BYTES = 1 << 21


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Texts:
    """Documents of one chunk: `data` is their bytes, each followed by one space; document i is
    data[start[i]:end[i]]."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        n = len(column)
        _, off, raw = column.buffers()
        off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        self.n = n
        self.length = np.diff(off)
        self.start = off[:-1] + np.arange(n)
        self.end = self.start + self.length
        self.data = np.full(len(raw) + n, 32, np.uint8)
        keep = np.ones(len(self.data), bool)
        keep[self.end] = False
        self.data[keep] = raw

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


class Words:
    """Words of a Texts chunk: byte ranges, document of each, first word of each document."""

    def __init__(self, texts: Texts):
        inside = ~SPACE[texts.data]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, texts.start)
        self.last = np.append(self.first[1:], len(self.start)) if texts.n else self.first
        self.count = self.last - self.first
        self.doc = np.repeat(np.arange(texts.n), self.count)


def powers(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if _kept.get("n", 0) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _kept[name] = np.cumprod(p, dtype=np.uint64)
        _kept["n"] = size
    return _kept["up"][:n], _kept["down"][:n]


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes (polynomial over random byte values, then mixed)."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:-1], out=prefix[1:])
    h = (prefix[words.end] - prefix[words.start]) * down[words.start]
    return mix64(h ^ (words.end - words.start).astype(np.uint64) * MIX[63])


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; callers keep those inside one document."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += h[j : j + m] * MIX[j]
    return mix64(out)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `limit` bytes (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // limit
        cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cut, cut[1:], strict=False):
            yield batch.slice(lo, hi - lo)
