"""Runs of words: stretches that repeat with a period, by maximal pairs of an LCP-interval tree.

A run [s, e) of smallest period q and length at least 2q is the maximal pair (s, s + q): the words that
follow the two places agree for exactly e - s - q words, at least q, and the words before them differ. So a
pair at distance d with common prefix l is a run of period d where l >= d, and nothing has to be extended.

Suffixes of each document are sorted by prefix doubling from a seed of half the least length (a run's pair
agrees at least that far, so only seeds met twice in a document enter); neighbours in that order have
common prefixes from the doubled ranks. The tree is built bottom-up on a stack. An interval keeps its
places in order, each with its class, the word to its left; where children join, pairs are taken between
different children and different classes only. Between s and s + q no other place of the same interval can
lie (it would give the run a smaller period), so next places in the list suffice: a join costs the places
of its smaller part. Distances that are multiples of the period give pairs of the same start and end; the
smallest distance stays.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import kernels as K
from millrace.llm.wordbytes import joined

LEAST = 12


def _first(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each key, how many keys are smaller; order sorts them."""
    step = np.flatnonzero(np.diff(key[order], prepend=-1))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(step, np.diff(np.append(step, len(key))))
    return out


def _ranks(codes: np.ndarray, doc: np.ndarray, g: int) -> np.ndarray:
    """The rank of each place by its document, then its next g words; the end of a document comes after any word."""
    n = len(codes)
    single = np.unique(codes, return_inverse=True)[1]

    def longer(rank: np.ndarray, width: int, more: np.ndarray) -> np.ndarray:
        to = np.minimum(np.arange(n) + width, n - 1)
        inside = (np.arange(n) + width < n) & (doc[to] == doc)
        return np.unique(rank * np.int64(n + 1) + np.where(inside, more[to], n), return_inverse=True)[1]

    rank, width = single, 1
    for bit in f"{g:b}"[1:]:
        rank, width = longer(rank, width, rank), 2 * width
        if bit == "1":
            rank, width = longer(rank, width, single), width + 1
    key = doc * np.int64(n + 1) + rank
    return _first(key, np.argsort(key, kind="stable"))


def _seeded(codes: np.ndarray, doc: np.ndarray, g: int) -> np.ndarray:
    """Which words are of documents that have some g words twice."""
    gram = K.shingle_hashes(codes, g)
    at = np.flatnonzero(doc[: len(gram)] == doc[g - 1 :]) if len(gram) else np.zeros(0, np.int64)
    key = K.mix64(gram[at] ^ K.mix64((doc[at] + 1).astype(np.uint64)))
    by = np.argsort(key)
    again = at[by[1:][np.diff(key[by].view(np.int64)) == 0]]
    have = np.zeros(int(doc[-1]) + 1 if len(doc) else 0, bool)
    have[doc[again]] = True
    return have[doc]


def _sorted_suffixes(codes: np.ndarray, doc: np.ndarray, rank: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose next g words occur again in their document, their order by suffix, and the common
    prefix of neighbours in that order (0 below g)."""
    n = len(codes)
    at = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    m = len(at)
    place = np.full(n + 1, -1, np.int64)
    place[at] = np.arange(m)
    rank = np.append(rank, n)
    levels, h, live = [(g, rank[at])], g, at
    while len(live):
        key = rank[live] * np.int64(n + 1) + rank[live + h]
        by = np.argsort(key)
        old, start = rank[live], _first(key, by)
        rank[live] = old + start - _first(old, by)
        h *= 2
        levels.append((h, rank[at]))
        live = live[np.bincount(start, minlength=len(start))[start] > 1]
    order = np.argsort(rank[at])
    i, j = at[order[:-1]], at[order[1:]]
    own, common = doc[i], np.zeros(max(0, m - 1), np.int64)
    for h, r in reversed(levels):
        p, q = place[np.minimum(i, n)], place[np.minimum(j, n)]
        same = ((p >= 0) & (q >= 0) & (r[p] == r[q])) * np.int64(h)
        common, i, j = common + same, i + same, j + same
    going = common >= g
    for _ in range(g - 1):
        p, q = np.minimum(i, n - 1), np.minimum(j, n - 1)
        going = going & (i < n) & (j < n) & (doc[p] == own) & (doc[q] == own) & (codes[p] == codes[q])
        common, i, j = common + going, i + going, j + going
    return at, order, common


def _near(at: np.ndarray, rank: np.ndarray, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of the places that may be of a pair: the words there (rank) occur again no
    further away than they can agree."""
    reach = np.zeros(len(at), np.int64)
    reach[order] = np.maximum(np.append(common, 0), np.append(0, common))
    by = np.argsort(rank, kind="stable")
    step = np.where(np.diff(rank[by]) == 0, np.diff(at[by]), np.iinfo(np.int64).max)
    gap = np.empty(len(at), np.int64)
    gap[by] = np.minimum(np.append(step, np.iinfo(np.int64).max), np.append(np.iinfo(np.int64).max, step))
    kept = np.flatnonzero((gap <= reach)[order])
    if len(kept) < 2:
        return order[:0], common[:0]
    return order[kept], np.minimum.reduceat(common[: kept[-1]], kept[:-1])


def _pairs(places: list[int], common: list[int], left: dict[int, int], least: int, g: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, distance) of the maximal pairs that are runs, from the tree of the sorted places."""
    stack: list[tuple[int, list[int]]] = []
    for place, after in zip(places, [*common, 0], strict=True):
        here = [place]
        while stack and (stack[-1][0] > after or stack[-1][0] == after >= g):
            depth, there = stack.pop()
            few, many = (here, there) if len(here) <= len(there) else (there, here)
            for x in few:
                k = bisect_left(many, x)
                for a, b in ((many[k - 1], x) if k else (x, x), (x, many[k]) if k < len(many) else (x, x)):
                    if 0 < b - a <= depth and b - a + depth >= least and left[a] != left[b]:
                        yield a, b - a + depth, b - a
            if len(few) == 1:
                insort(many, few[0])
            else:
                many += few
                many.sort()
            here = many
        if after >= g:
            stack.append((after, here))


def runs_of(codes: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs of at least `least` words, by start, then period. codes: a number
    for each word, doc: the document of each, in order. A run lies in one document."""
    g = max(1, (least + 1) // 2)
    whole = np.flatnonzero(_seeded(codes, doc, g))
    codes, doc = codes[whole], doc[whole]
    rank = _ranks(codes, doc, g) if len(whole) else whole
    at, order, common = _sorted_suffixes(codes, doc, rank, g)
    order, common = _near(at, rank[at], order, common)
    if not len(order):
        return tuple(np.zeros((3, 0), np.int64))
    places = at[order]
    before = np.maximum(places - 1, 0)
    begins = (places == 0) | (doc[before] != doc[places])
    left = dict(zip(places.tolist(), np.where(begins, -1, np.unique(codes[before], return_inverse=True)[1]).tolist(), strict=True))
    found = np.array(list(_pairs(places.tolist(), common.tolist(), left, least, g)), np.int64).reshape(-1, 3).T
    start, length, period = found
    by = np.lexsort((period, length, start))
    start, length, period = found[:, by]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, period = start[first], length[first], period[first]
    by = np.lexsort((period, start))
    return whole[start[by]], length[by], period[by]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """key, n_words, runs (start, length and period in words, by start, then period) and collapsed, the words
    outside of repetitions (a run keeps its first period) joined by one space, of each row.

    A null, empty or wordless text has no words, no runs and an empty collapsed text. Repeated rows and null
    keys give a row each; no rows give none; other columns are not read. Words are told apart by 64 bits of hash.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, text):
            texts = K.Texts(b.column(1))
            words = K.Words(texts)
            start, length, period = runs_of(K.word_hashes(texts.data, words), words.doc, least)
            change = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            count = np.bincount(words.doc[kept], minlength=texts.n)
            of = words.doc[start]
            fields = [pa.array(start - words.first[of]), pa.array(length), pa.array(period)]
            offsets = pa.array(np.searchsorted(of, np.arange(texts.n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(words.count.astype(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
                joined(texts.data, words.start[kept], words.end[kept], count),
            ], [key, "n_words", "runs", "collapsed"])

    runs = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words bigint, runs {runs}, collapsed string")
