"""Benchmark decontamination by q-gram lemma filtering.

An item of m bytes counts as contained in a document if some region of it is within k = m // 10 edits
of the item, both with A-Z lower-cased and white-space runs taken as one space. By the q-gram lemma
such a region keeps at least m + 1 - (k + 1) q of the item's q-grams, and those lie in a band of k + 1
diagonals. Documents are scanned once: each position's q-gram is looked up in the items'
grams, hits are counted in overlapping bands of diagonals, and only bands that reach the bound are
verified, by an alignment restricted to the band. q is 8, or less for short items, so that the bound
stays positive. Nothing is sampled: the filter loses no region within the budget.

Items are broadcast in blocks of at most `BLOCK_BYTES`, one scan for each block.

Defined results: null and empty texts contain nothing; items of fewer than `MIN_ITEM` bytes after
normalisation match nothing, or with `short` exactly and only between word bounds; equal items and repeated rows each give rows
of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K

Q, MIN_ITEM, BLOCK_BYTES = 8, 24, 16 << 20
BITS = 22
#: Added to diagonals so that none is negative; items are shorter.
SHIFT = 1 << 30
#: Bytes of words: letters, digits, the underscore and all beyond ASCII.
PART = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])


def budget(m: int) -> int:
    return m // 10


def gram_size(m: int) -> int:
    """The largest q up to Q with a positive bound."""
    return min(Q, m // (budget(m) + 1))


def normalised(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes lower-cased with one space for each run of white space, and where each came from."""
    space = K.SPACE[data]
    keep = np.flatnonzero(~(space & np.concatenate(([False], space[:-1]))))
    out = K.LOWER[data[keep]]
    out[space[keep]] = 32
    return out, keep


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each position on as one number (zeros follow the end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.ndarray((len(data),), "<u8", padded.data, strides=(1,))
    return word & np.uint64((1 << (8 * q)) - 1) if q < 8 else word.copy()


def slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def bounded(data: np.ndarray, at: int, to: int, first: int, last: int) -> bool:
    """Whether data[at:to], inside the text data[first:last], doesn't cut a word at either end."""
    return not (at > first and PART[data[at - 1]] and PART[data[at]]) and not (to < last and PART[data[to - 1]] and PART[data[to]])


class Items:
    """Benchmark items with their q-grams, ready for lookup."""

    def __init__(self, ids: list, texts: list[str | None], short: bool = False):
        self.ids, self.bytes = [], []
        for i, t in zip(ids, texts, strict=True):
            flat = normalised(np.frombuffer(f"{t or ''} ".encode(), np.uint8))[0].tobytes().strip()
            if len(flat) >= (1 if short else MIN_ITEM):
                self.ids.append(i)
                self.bytes.append(flat)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.exact = self.size < MIN_ITEM
        self.q = np.array([min(Q, len(b)) if len(b) < MIN_ITEM else gram_size(len(b)) for b in self.bytes], np.int64)
        self.k = np.array([0 if len(b) < MIN_ITEM else budget(len(b)) for b in self.bytes], np.int64)
        self.bound = self.size + 1 - (self.k + 1) * self.q
        self.width = 1 << np.ceil(np.log2(self.k + 1)).astype(np.int64)
        self.tables = {}
        for q in sorted(set(self.q.tolist())):
            own = np.flatnonzero(self.q == q)
            g = [grams(np.frombuffer(self.bytes[i], np.uint8), q)[: self.size[i] - q + 1] for i in own]
            item = np.repeat(own, [len(x) for x in g])
            place = np.concatenate([np.arange(len(x)) for x in g])
            g = np.concatenate(g)
            order = np.argsort(g, kind="stable")
            mark = np.zeros(1 << BITS, bool)
            mark[slot(g)] = True
            self.tables[q] = (g[order], item[order], place[order], mark)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place in item) of all shared q-grams."""
        out = []
        for q, (table, item, place, mark) in self.tables.items():
            g = grams(data, q)
            at = np.flatnonzero(mark[slot(g)])
            lo, hi = np.searchsorted(table, g[at]), np.searchsorted(table, g[at], "right")
            n = hi - lo
            some = np.flatnonzero(n)
            at, lo, n = at[some], lo[some], n[some]
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
            out.append((np.repeat(at, n), item[j], place[j]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def banded_alignment(item: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best match of the whole item anywhere in the region, or None if it
    needs more than k edits. Cells off the band of diagonals 0..len(region) - len(item) + k, where the
    match must lie, are never filled."""
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    m, n = len(item), len(region)
    width = max(1, n - m + 2 * k + 1)  # diagonals -k .. n - m + k
    text = np.full(n + m + 4 * k + 8, 0xFF, np.uint8)
    text[k : k + n] = np.frombuffer(region, np.uint8)
    step, far = np.arange(width), np.int64(1 << 62)
    # Cost and start together: the smaller cost wins, then the later start, which is below the unit.
    cost = np.where((step >= k) & (step <= n + k), -(step - k), far).astype(np.int64)
    unit = np.int64(1 << 32)
    for j, c in enumerate(item):
        same = text[j : j + width] == c
        new = cost + np.where(same, 0, unit)
        new[:-1] = np.minimum(new[:-1], cost[1:] + unit)
        new = np.minimum.accumulate(new - step * unit) + step * unit
        inside = (step + j + 1 - k >= 0) & (step + j + 1 - k <= n)
        cost = np.where(inside, new, far)
        if j % 8 == 7 and cost.min() > k * unit:
            return None
    best = int(np.argmin(cost))
    distance = -(-int(cost[best]) // int(unit))
    if distance > k:
        return None
    return distance, distance * int(unit) - int(cost[best]), best + m - k


def overlaps(items: Items, texts: K.Texts) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start, end, distance) with byte ranges of the original texts: the best region
    of each contained item."""
    data, came_from = normalised(texts.data)
    start, end = np.searchsorted(came_from, texts.start), np.searchsorted(came_from, texts.end)
    at, item, place = items.hits(data)
    doc = np.searchsorted(start, at, "right") - 1
    inside = at + items.q[item] <= end[doc]
    at, item, place, doc = at[inside], item[inside], place[inside], doc[inside]
    diagonal = at - place + SHIFT
    width, k = items.width[item], items.k[item]
    band = diagonal // width
    low = diagonal % width < k  # also within reach of the band before
    doc, item, band, place = (np.append(x, y) for x, y in ((doc, doc[low]), (item, item[low]), (band, band[low] - 1), (place, place[low])))
    if not len(doc):
        return []
    pair = doc << 20 | item
    order = np.lexsort((place, band, pair))
    pair, band, place = pair[order], band[order], place[order]
    new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])))
    fresh = new | np.concatenate(([True], place[1:] != place[:-1]))
    first_of = np.flatnonzero(new)
    count = np.bincount((np.cumsum(new) - 1)[fresh], minlength=len(first_of))  # places of the item that are met in the band
    first_of = first_of[count >= items.bound[pair[first_of] & 0xFFFFF]]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for code, b in zip(pair[first_of].tolist(), band[first_of].tolist(), strict=True):
        d, i = code >> 20, code & 0xFFFFF
        if best.get((d, i), (1,))[0] == 0:
            continue
        k, m, w = int(items.k[i]), int(items.size[i]), int(items.width[i])
        if items.exact[i]:
            at = b - SHIFT
            if at >= start[d] and at + m <= end[d] and data[at : at + m].tobytes() == items.bytes[i] and bounded(data, at, at + m, int(start[d]), int(end[d])):
                best[d, i] = (0, at, at + m)
            continue
        first = b * w - SHIFT
        lo, hi = max(int(start[d]), first - k), min(int(end[d]), first + w + 2 * k + m)
        got = banded_alignment(items.bytes[i], data[lo:hi].tobytes(), k)
        if got and got < best.get((d, i), (1 << 30, 0, 0)):
            best[d, i] = (got[0], lo + got[1], lo + got[2])
    return [(d, i, int(came_from[s] - texts.start[d]), int(came_from[e - 1] + 1 - texts.start[d]), dist) for (d, i), (dist, s, e) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, item_key: str, item_text: str, short: bool = False) -> Iterator[Items]:
    """The benchmark in blocks small enough to broadcast: about BLOCK_BYTES and 500,000 items at most."""
    total = benchmark.agg(F.sum(F.octet_length(item_text)), F.count("*")).first()
    blocks = max(1, math.ceil((total[0] or 0) / BLOCK_BYTES), math.ceil(total[1] / 500_000))
    for block in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(blocks)) == block) if blocks > 1 else benchmark
        rows = own.select(item_key, item_text).collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows], short)


def contained_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", short: bool = False) -> DataFrame:
    """(key, item key, start, end, distance): items contained in documents, with the byte range of the best region."""
    kinds, out = f"{key} {dict(docs.dtypes)[key]}, {item_key} {dict(benchmark.dtypes)[item_key]}, start bigint, end bigint, distance int", None
    for block in item_blocks(benchmark, item_key, item_text, short):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in K.chunks(batches, text):
                found = overlaps(items, K.Texts(b.column(1)))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([items.ids[f[1]] for f in found], pa.int64()),
                    *(pa.array([f[i] for f in found], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32()))),
                ], [key, item_key, "start", "end", "distance"])

        part = docs.select(key, text).mapInArrow(run, kinds)
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", short: bool = False) -> DataFrame:
    """The rows of docs that contain no item, in one scan for each block of items."""
    for block in item_blocks(benchmark, item_key, item_text, short):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in K.chunks(batches, text):
                clean = np.ones(b.num_rows, bool)
                clean[[f[0] for f in overlaps(items, K.Texts(b.column(b.schema.get_field_index(text))))]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
