"""Suffix-array dedup: remove every byte covered by a string of `min_length` bytes that starts
anywhere else in the corpus too.

Strings that are equal must meet, without one index over everything. Each window of min_length bytes
picks an anchor, the smallest hash among the grams inside it; equal windows pick equal grams at equal
places. Windows of one document that pick the same anchor form a context, and anchors whose gram
occurs once in the corpus are dropped. Contexts of equal grams come together in a task, which builds
a suffix array and its Burrows-Wheeler transform and finds, by threshold-bounded interval expansion,
which windows occur twice: intervals are extended backward, breadth first, so that common-prefix
values come out in increasing order, and the search stops at min_length. A boundary between
neighbouring suffixes that no interval has reached by then has a longer common prefix.

Equal contexts enter the transform once, with their number as a weight, so large groups of copies
cost no more than one of them. Documents are known by a hash of their text: results depend on the
text alone, and copies share them.

Defined results: null texts are empty; texts shorter than min_length lose nothing; repeated rows are
documents of their own and so remove each other's text, as any other copies do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.shared import discard, written

MIN_LENGTH, GRAM = 200, 32
SEPARATOR = 0xFF  # never a byte of UTF-8
#: Bytes of contexts for one transform; key groups are never divided.
TRANSFORM_BYTES = 2 << 20


def anchors(texts: K.Texts, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, number of starts, gram hash) of each run of windows that picks one anchor."""
    data, n = texts.data, len(texts.data)
    span = min_length - GRAM + 1
    if n < min_length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    word = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
    g = word[: n - 31] * K.MIX[10]
    for j in (8, 16, 24):
        g += word[j : n - 31 + j] * K.MIX[10 + j]
    v = ((g ^ (g >> np.uint64(31))) * K.MIX[40]) & np.uint64(0xFFFFFFFF00000000)
    v |= np.arange(len(v), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if span > width:
        v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
    at = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)  # anchor of the window that starts here
    long_ = np.flatnonzero(texts.length >= min_length)
    whole = np.zeros(n + 1, np.int8)
    whole[texts.start[long_]] += 1
    whole[texts.end[long_] - min_length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    own = at[starts]
    first = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    begin, count = starts[first], np.diff(np.append(first, len(starts)))
    doc = np.searchsorted(texts.start, begin, "right") - 1
    return doc, begin - texts.start[doc], count, K.mix64(g[own[first]])


def suffix_order(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of t by prefix doubling, and which slots begin a group of suffixes with equal first `depth` bytes."""
    n = len(t)
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    key = np.ndarray((n,), ">u8", padded.data, strides=(1,)).astype(np.uint64)
    sa = np.argsort(key)
    head = np.ones(n, bool)
    s = key[sa]
    head[1:] = s[1:] != s[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h, seed = 8, None
    while True:
        if h == depth:
            seed = head.copy()
        alone = head & np.append(head[1:], True)
        slot = np.flatnonzero(~alone)
        if not len(slot) or h >= n:
            break
        sub = sa[slot]
        second = np.where(sub + h < n, rank[np.minimum(sub + h, n - 1)] + 1, 0)
        both = rank[sub] << 32 | second
        o = np.argsort(both)
        sub, both = sub[o], both[o]
        sa[slot] = sub
        new = np.ones(len(sub), bool)
        new[1:] = both[1:] != both[:-1]
        head[slot] = new
        rank[sub] = np.maximum.accumulate(np.where(new, slot, 0))
        h *= 2
    return sa, head if seed is None else seed


def long_common_prefixes(t: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of t, and for each slot whether its suffix shares at least min_length bytes with
    the one before. Suffixes that reach a separator within min_length bytes have no defined answer."""
    n, depth = len(t), 8
    while depth * 2 <= min(32, min_length):
        depth *= 2
    sa, seed = suffix_order(t, depth)
    bwt = t[sa - 1]
    order = np.argsort(bwt, kind="stable")  # inverse of the last-to-first mapping
    same = bwt[order[1:]] == bwt[order[:-1]]
    to_first = np.empty(n, np.int64)
    to_first[order] = np.arange(n)
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[order[:-1][same]] = order[1:][same]
    previous[order[1:][same]] = order[:-1][same]
    whole = bwt != SEPARATOR
    open_ = np.append(~seed, False)  # boundaries whose common prefix isn't known yet
    lo = np.flatnonzero(seed)
    hi = np.append(lo[1:], n) - 1
    for value in range(depth, min_length):
        if not len(lo):
            break
        size = hi - lo + 1
        total = np.cumsum(size)
        own = np.repeat(np.arange(len(lo)), size)
        j = np.arange(total[-1]) + (lo - total + size)[own]
        last = to_first[j[(following[j] > hi[own]) & whole[j]]]
        first = to_first[j[(previous[j] < lo[own]) & whole[j]]]
        last.sort()
        first.sort()
        found = open_[last + 1]
        open_[last[found] + 1] = False  # common prefix: value
        lo, hi = first[found], last[found]
    return sa, open_[:n]


def repeated_starts(contexts: list[bytes], weights: np.ndarray, starts: np.ndarray, min_length: int) -> list[list[tuple[int, int]]]:
    """For each context, the ranges of window ends [a, b) that cover its repeated windows."""
    text = np.frombuffer(bytes([SEPARATOR]).join([b"", *contexts, b""]), np.uint8)
    begin = np.cumsum([1] + [len(c) + 1 for c in contexts])[:-1]
    sa, more = long_common_prefixes(text, min_length)
    twice = np.zeros(len(text), bool)
    twice[sa[more]] = True
    twice[sa[:-1][more[1:]]] = True
    out = []
    for b, w, k in zip(begin, weights, starts, strict=True):
        hit = np.ones(k, bool) if w > 1 else twice[b : b + k]
        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        out.append([(int(x), int(y) - 1 + min_length) for x, y in zip(edge[::2], edge[1::2], strict=True)])
    return out


def _occurrences(docs: DataFrame, min_length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, "text"):
            doc, start, count, gram = anchors(K.Texts(b.column(1)), min_length)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(gram.view(np.int64)), "h": b.column(0).take(pa.array(doc)), "at": pa.array(start << 16 | count)})

    return docs.where(F.octet_length("text") >= min_length).select("h", "text").mapInArrow(run, "gram bigint, h bigint, at bigint")


def _contexts(rows: DataFrame, min_length: int) -> DataFrame:
    """Rows (h, text, n, ats, grams) to (gram, context, h, at, n, body); body only with the first equal context of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in K.chunks(batches, "text"):
            out: list[list] = [[] for _ in range(6)]
            for h, text, n, anchored in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                for a in anchored:
                    at, gram = a["at"], a["gram"]
                    start, count = at >> 16, at & 0xFFFF
                    body = raw[start : start + count + min_length - 1]
                    context = xxhash.xxh3_64_intdigest(body) - (1 << 63)
                    known = (gram, context) in seen
                    if not known:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add((gram, context))
                    for o, v in zip(out, (gram, context, h, at, n, None if known else body), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64() if i < 5 else pa.binary()) for i, o in enumerate(out)], ["gram", "context", "h", "at", "n", "body"])

    return rows.select("h", "text", "n", "anchored").mapInArrow(run, "gram bigint, context bigint, h bigint, at bigint, n bigint, body binary")


def _repeats(contexts: DataFrame, min_length: int) -> DataFrame:
    """(h, spans) for contexts that lie together by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size, gram = 0, None

        def flush() -> pa.RecordBatch:
            groups = list(held.values())
            ranges = repeated_starts([g[0] for g in groups], np.array([g[1] for g in groups]), np.array([g[2] for g in groups]), min_length)
            hs, lo, hi = [], [], []
            for g, own in zip(groups, ranges, strict=True):
                for h, start in g[3]:
                    for x, y in own:
                        hs.append(h)
                        lo.append(start + x)
                        hi.append(start + y)
            return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["h", "lo", "hi"])

        for b in batches:
            for g, c, h, at, n, body in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if g != gram:
                    if size > TRANSFORM_BYTES:
                        yield flush()
                        held.clear()
                        size = 0
                    gram = g
                own = held.get((g, c))
                if own is None:
                    own = held[(g, c)] = [None, 0, at & 0xFFFF, []]
                if body is not None and own[0] is None:
                    own[0] = body
                    size += len(body)
                own[1] += n
                own[3].append((h, at >> 16))
        if held:
            yield flush()

    near = contexts.repartition("gram").sortWithinPartitions("gram", "context")
    return near.mapInArrow(run, "h bigint, lo bigint, hi bigint")


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(h, r, text): hash of the text, and a number that tells its copies apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(whole).alias("h"), F.xxhash64(F.col(key)).alias("r"), whole.alias("text"))


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(h, r, ranges) by hash h of the text: byte ranges to remove, which may overlap; r is the row
    that stands for all copies of the text. Texts that lose nothing are left out."""
    texts = _hashed(docs, key, text)
    found = written(_occurrences(texts, min_length), "anchors")
    twice = found.groupBy("gram").count().where("count > 1").select("gram")
    live = found.join(twice, "gram").groupBy("h").agg(F.collect_set(F.struct("at", "gram")).alias("anchored"))
    copies = texts.where(F.octet_length("text") >= min_length).groupBy("h").agg(F.min("r").alias("r"), F.count("*").alias("n"))
    live = written(live.join(copies, "h"), "live-anchors")
    discard(found)
    rows = texts.join(live.hint("shuffle_hash"), ["h", "r"])
    spans = _repeats(_contexts(rows, min_length), min_length).groupBy("h").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    ranges = written(spans.join(live.select("h", "r"), "h").select("h", "r", "ranges"), "ranges")
    discard(live)
    return ranges


def joined(ranges: list[dict]) -> list[tuple[int, int]]:
    """Ranges in order, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in spans:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]])


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, "text"):
            out: list[list] = [[] for _ in range(4)]
            for h, text_, ranges in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw, spans = text_.encode(), joined(ranges)
                for o, v in zip(out, (h, sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.string() if i == 3 else pa.int64()) for i, o in enumerate(out)], ["h", "removed", "spans", "sha"])

    ranges = repeated_ranges(docs, key, text, min_length)
    changed = _hashed(docs, key, text).join(ranges.hint("shuffle_hash"), ["h", "r"]).select("h", "text", "ranges").mapInArrow(run, "h bigint, removed bigint, spans bigint, sha string")
    changed = changed.groupBy("h").agg(*(F.first(c).alias(c) for c in ("removed", "spans", "sha")))
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key), F.xxhash64(whole).alias("h"), F.octet_length(whole).cast("bigint").alias("n_bytes"), F.sha2(whole.cast("binary"), 256).alias("own"))
    return base.join(changed, "h", "left").select(
        key, "n_bytes", F.coalesce("removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """docs with the repeated bytes taken out of its text; a character cut in two goes as a whole."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([kept_bytes(t.encode(), joined(r)).decode("utf-8", "ignore") for t, r in zip(texts, ranges, strict=True)])

    ranges = repeated_ranges(docs, key, text, min_length).select(F.col("h").alias("__own_h"), F.col("ranges").alias("__own_ranges"))
    marked = docs.withColumn("__own_h", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(ranges.hint("shuffle_hash"), "__own_h", "left")
    lost = F.col("__own_ranges").isNotNull()
    whole = F.when(lost, cut(F.when(lost, F.col(text)).otherwise(""), F.coalesce("__own_ranges", F.array().cast("array<struct<lo:bigint,hi:bigint>>")))).otherwise(F.col(text))
    return marked.withColumn(text, whole).select(*docs.columns)
