"""Language-model scores by prediction by partial matching over bytes.

Training counts how often each byte follows each context of `ORDER` bytes, over all training
documents; shorter contexts follow by summing. The trie of contexts is static when documents are
scored. A byte that a context hasn't seen costs an escape (method C: distinct symbols over total plus
distinct symbols) and is looked for in the context one byte shorter, where symbols of the longer one
are excluded; below the empty context all other bytes are equally likely. Byte 0xFF, which UTF-8
never uses, ends a text and stands before its beginning. The score is the log10 probability of the
text and its end.

The trie is never held as a whole. All contexts that end in the same `SUFFIX` bytes, longer ones
included, lie in one task, which needs nothing else but the counts of shorter contexts (at most one
for each three bytes that follow each other in UTF-8, fewer than 256 ** 3; broadcast, and made a trie once a task). There every (context, symbol) pair of any document gets its probability once; those
of the `MAX_CONTEXTS` pairs met most often are broadcast, all others are looked up by a join.

Beside it stands a word-unigram base. Counts of the `MAX_WORDS` most frequent words are broadcast,
all other words are looked up by a join, so every count is exact.

Texts of more than twice CHUNK are read in parts of about CHUNK bytes, cut behind white space; each part sees the bytes
before it, so the sums are those of the whole text, and memory doesn't grow with the longest one but for its longest word.

Defined results: null texts are empty: one end token; repeated rows get equal scores; with no training
document the base is that of unseen tokens and every byte is equally likely.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.shared import written

ORDER = 5
#: What is broadcast; the rest is joined, so neither changes a result.
MAX_CONTEXTS = 1_000_000
MAX_WORDS = 300_000
#: Last bytes of a context by which contexts are brought together, and pairs of which a trie is made at once.
SUFFIX = 3
PAIRS = 125_000
WINDOW = 2_000_000
#: Bytes of text taken at once: the arrays made of them are some hundred times as large.
CHUNK = 1 << 18
END = 0xFF
WHITE = re.compile(rb"[\x20\x09-\x0D]")


class HashTable:
    """uint64 keys to row numbers, open addressing, built and read by arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.key = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.row = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.row[slot] < 0
            self.row[slot[free]] = left[free]
            self.key[slot[free]] = keys[left[free]]
            out = self.row[slot] != left
            left, slot = left[out], (slot[out] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = self._slot(keys)
        out = np.where(self.key[slot] == keys, self.row[slot], -1)
        rest = np.flatnonzero((out < 0) & (self.row[slot] >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            s = slot[rest]
            hit = self.key[s] == keys[rest]
            out[rest[hit]] = self.row[s[hit]]
            rest = rest[~hit & (self.row[s] >= 0)]
        return out


def parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array, bytes | None, bool]]:
    """(rows, texts, before, last) of about CHUNK bytes: whole texts (before: None, last), or one part of a long one,
    cut behind white space so that no word is divided, with the bytes before it and whether it is the last."""
    for b in K.chunks(batches, text, CHUNK):
        column = b.column(b.schema.get_field_index(text))
        whole = column[0].as_py() if b.num_rows == 1 else None
        if whole is None or len(whole) <= 2 * CHUNK:
            yield b, column, None, True
            continue
        raw = whole.encode()
        at = 0
        while at < len(raw):
            cut = min(at + CHUNK, len(raw))
            space = WHITE.search(raw, cut)
            cut = space.end() if space and cut < len(raw) else len(raw)
            yield b, pa.array([raw[at:cut]], pa.large_binary()).cast(pa.large_string()), raw[max(0, at - 16) : at], cut == len(raw)
            at = cut


def symbols(texts: K.Texts, order: int, before: bytes | None = None, last: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all documents with `order` END bytes before each and one after; the
    positions to predict, and how many each document has. For a part of a document, `before` stands in place
    of the bytes before it, and only the last part has an end."""
    if before is not None:
        head = (bytes([END]) * order + before)[len(before) :] if order else b""
        out = np.concatenate((np.frombuffer(head, np.uint8), texts.data[: texts.length[0]], np.full(1, END, np.uint8)))
        at = np.arange(order, len(out) - (not last))
        out[:-1] = np.where(out[:-1] == END, END, K.LOWER[out[:-1]])
        return out, at, np.array([len(at)])
    out = np.full(len(texts.data) + texts.n * order, END, np.uint8)
    shift = order * (np.arange(texts.n) + 1)
    inside = np.ones(len(texts.data), bool)
    inside[texts.end] = False
    at = np.arange(len(texts.data)) + np.repeat(shift, texts.length + 1)
    out[at[inside]] = K.LOWER[texts.data[inside]]
    return out, at, texts.length + 1


def contexts(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The `order` bytes before each position and its own, as one number, the symbol lowest."""
    key = data.astype(np.uint64)
    width = 1
    value, have = key, 1  # value at i holds the `have` bytes that end at i
    total = order + 1
    while have * 2 <= total:
        new = value.copy()
        new[have:] |= value[:-have] << np.uint64(8 * have)
        value, have = new, have * 2
    if have < total:
        rest = total - have
        new = value & np.uint64((1 << (8 * have)) - 1)
        new[rest:] |= value[:-rest] << np.uint64(8 * rest)
        value = new & np.uint64((1 << (8 * total)) - 1)
    return value[at] & np.uint64((1 << (8 * total)) - 1)


class Trie:
    """Static trie of (context, symbol) counts for orders 0..order; levels[k] holds keys and counts. With
    `below`, a trie of lower orders, levels are those that follow, and its own are not made again."""

    PARTS = ("entry", "gain", "single", "node", "top", "into", "escape")

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], below: Trie | None = None):
        for name in self.PARTS:
            setattr(self, name, list(getattr(below, name)) if below else [])
        self.order = len(self.entry) + len(levels) - 1
        before = below.last if below else None
        for keys, counts in levels:
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order].astype(float)
            ctx = keys >> np.uint64(8)
            first = np.flatnonzero(np.diff(ctx, prepend=~ctx[:1])) if len(ctx) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(ctx)))
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            self.entry.append(HashTable(keys))
            self.gain.append(np.log10(counts) - np.log10(np.repeat(total + size, size)))
            self.single.append(np.log10(counts))
            self.node.append(HashTable(ctx[first]))
            self.top.append(np.log10(size / (total + size)))
            if before is not None:  # escaping from these nodes into the shorter context, without their symbols
                short, short_counts, short_total, short_size, short_nodes = before
                mask = np.uint64((1 << (8 * (len(self.entry) - 1))) - 1)
                also = short.find(keys & mask)
                parent = short_nodes.find((ctx[first] & (mask >> np.uint64(8))))
                left = short_total[parent] - (np.add.reduceat(short_counts[also], first) if len(first) else 0)
                more = short_size[parent] - size
                with np.errstate(divide="ignore"):
                    self.into.append(np.where(more > 0, np.log10(np.maximum(left + more, 1e-9)), 0.0))
                    self.escape.append(np.where(more > 0, np.log10(np.maximum(more, 1e-9) / np.maximum(left + more, 1e-9)), 0.0))
            else:
                self.into.append(np.zeros(len(first)))
                self.escape.append(np.zeros(len(first)))
            before = (self.entry[-1], counts, total, size, self.node[-1])
        self.last = before
        self.rest = below.rest if below else -np.log10(256.0 - (len(levels[0][0]) if len(levels[0][0]) < 256 else 255))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol in each key after the context in it."""
        out = np.zeros(len(keys))
        row = self.entry[self.order].find(keys)
        hit = row >= 0
        out[hit] = self.gain[self.order][row[hit]]
        at = np.flatnonzero(~hit)
        keys = keys[at]
        child = np.full(len(at), -1)  # the longer context just left, -1 if none was known yet
        for k in range(self.order, -1, -1):
            own = keys & np.uint64((1 << (8 * (k + 1))) - 1)
            if k < self.order:
                row = self.entry[k].find(own)
                hit = row >= 0
                new = hit & (child < 0)
                out[at[new]] += self.gain[k][row[new]]
                old = hit & (child >= 0)
                out[at[old]] += self.single[k][row[old]] - self.into[k + 1][child[old]]
                at, keys, child, own = at[~hit], keys[~hit], child[~hit], own[~hit]
            node = self.node[k].find(own >> np.uint64(8))
            known = node >= 0
            new = known & (child < 0)
            out[at[new]] += self.top[k][node[new]]
            if k < self.order:
                old = known & (child >= 0)
                out[at[old]] += self.escape[k + 1][child[old]]
            child = np.where(known, node, -1)
        out[at] += self.rest
        return out


def training(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(10)) != 0, F.lit(True))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counts(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n, met): word counts (kind 0) and context counts (kind 1), n summed over the learned
    rows of docs, met over all; words of other rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]  # words, contexts, contexts of rows not learned

        def put(kind: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            held[kind].append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held[kind]) > WINDOW // 4:
                merge(kind)
                if len(held[kind][0][0]) > WINDOW // 8:
                    yield flush(kind)

        def merge(kind: int) -> None:
            held[kind] = [summed(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))]

        def flush(kind: int) -> pa.RecordBatch:
            merge(kind)
            keys, n = held[kind].pop()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), min(kind, 1), np.int32)), pa.array(keys.view(np.int64)), pa.array(n if kind < 2 else np.zeros_like(n)), pa.array(n)], ["kind", "key", "n", "met"])

        for b, column, before, last in parts(batches, "text"):
            texts = K.Texts(column)
            own = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            words = K.Words(texts)
            if len(words.start):
                hashes = K.word_hashes(K.LOWER[texts.data], words)[np.repeat(own, words.count)]
                yield from put(0, hashes)
            data, at, size = symbols(texts, order, before, last)
            keys, own = contexts(data, at, order), np.repeat(own, size)
            yield from put(1, keys[own])
            yield from put(2, keys[~own])
        for kind in range(3):
            if held[kind]:
                yield flush(kind)

    return docs.select("text", "learned").mapInArrow(run, "kind int, key bigint, n bigint, met bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))


def _bounded(counts: DataFrame, most: int, weight: str = "n", least: int = 0) -> tuple[int, DataFrame]:
    """The rows whose weight reaches the smallest power of two, at least `least`, that leaves `most` rows."""
    level = {r.k: r["count"] for r in counts.groupBy(F.floor(F.log2(weight)).cast("int").alias("k")).count().collect()}
    while sum(c for k, c in level.items() if k >= least) > most:
        least += 1
    return least, counts.where(F.floor(F.log2(weight)) >= least)


def _short(counts: DataFrame, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of the trie below `length`, whole: at most 256 ** length entries in the longest."""
    if not length:
        return []
    own = counts.where("kind = 1 and n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * length)) - 1).cast("bigint")).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    keys, n = own.column("key").to_numpy().view(np.uint64), own.column("n").to_numpy()
    return [summed(keys & np.uint64((1 << (8 * (k + 1))) - 1), n) for k in range(length)]


def probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(key, met, value) of every context and symbol in counts: how often all documents have it, and its
    log10 probability in the trie of all learned contexts."""
    length = min(SUFFIX, order)
    shared = counts.sparkSession.sparkContext.broadcast(_short(counts, length))
    cut = np.uint64((1 << (8 * length)) - 1)

    def valued(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], short: Trie | None) -> pa.RecordBatch:
        keys, n, met = (np.concatenate(x) for x in zip(*rows, strict=True))
        seen = n > 0
        own = [summed(keys[seen] & np.uint64((1 << (8 * (k + 1))) - 1), n[seen]) for k in range(length, order + 1)]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(met), pa.array(Trie(own, short).log10(keys))], ["key", "met", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0  # sorted by suffix, of which none is divided
        short = Trie(shared.value) if shared.value else None
        for b in batches:
            keys, n, met = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()
            if not len(keys):
                continue
            suffix = (keys >> np.uint64(8)) & cut
            if rows >= PAIRS:
                stop = int(np.searchsorted(suffix, (held[-1][0][-1] >> np.uint64(8)) & cut, side="right"))
                if stop < len(keys):
                    yield valued([*held, (keys[:stop], n[:stop], met[:stop])], short)
                    held, rows = [], 0
                    keys, n, met = keys[stop:], n[stop:], met[stop:]
            held.append((keys, n, met))
            rows += len(keys)
        if held:
            yield valued(held, short)

    suffix = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(int(cut)).cast("bigint"))
    own = counts.where("kind = 1").select("key", "n", "met", suffix.alias("suffix")).repartition("suffix").sortWithinPartitions("suffix")
    return own.select("key", "n", "met").mapInArrow(run, "key bigint, met bigint, value double")


_loaded: dict[str, tuple] = {}


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key), training(F.col(key)).alias("learned"), F.xxhash64(whole).alias("h"), whole.alias("text"))
    counts = written(_counts(base, order), "counts")
    ends = base.where("learned").count()
    words = counts.where("kind = 0").select("key", "n")
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + ends, distinct + (ends > 0)
    chances = written(probabilities(counts, order), "chances")
    least, often = _bounded(chances, MAX_CONTEXTS, "met")
    tables = [(t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()) for t in (often.select("key", "value").toArrow(), _bounded(words, MAX_WORDS)[1].toArrow())]
    shared = spark.sparkContext.broadcast(tables)
    name, scale = uuid.uuid4().hex, float(np.log10(total + 0.1 * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            (pairs, chance), (keys, n) = shared.value
            _loaded[name] = (HashTable(pairs), chance, HashTable(keys), n.astype(float))
        pairs, chance, table, n = _loaded[name]
        held: list[tuple] = []  # parts so far of a long text
        for b, column, before, last in parts(batches, "text"):
            texts = K.Texts(column)
            words = K.Words(texts)
            data, at, size = symbols(texts, order, before, last)
            asked = contexts(data, at, order)
            row = pairs.find(asked)
            there = row >= 0
            gain = np.zeros(len(asked))
            gain[there] = chance[row[there]]
            part = np.concatenate(([0.0], np.cumsum(gain)))
            stop = np.cumsum(size)
            score = part[stop] - part[stop - size]
            far = np.concatenate(([0], np.cumsum(~there)))[np.concatenate(([0], stop))]
            hashes = K.word_hashes(K.LOWER[texts.data], words)
            row = table.find(hashes)
            known = row >= 0
            value = np.zeros(len(hashes))
            value[known] = np.log10(n[row[known]] + 0.1) - scale
            sums = [np.concatenate(([0], np.cumsum(x))) for x in (value, known)]
            got, seen = (s[words.last] - s[words.first] for s in sums)
            rare = [hashes[a:z][~known[a:z]] for a, z in zip(words.first.tolist(), words.last.tolist(), strict=True)]
            flat, unseen = np.concatenate(rare) if rare else np.zeros(0, np.uint64), asked[~there]
            count, ends = words.count, np.cumsum([0] + [len(r) for r in rare])
            if before is not None:
                held.append((count, seen, got, score, flat, unseen))
                if not last:
                    continue
                count, seen, got, score = (sum(x) for x in list(zip(*held, strict=True))[:4])
                flat, unseen = (np.concatenate(x) for x in list(zip(*held, strict=True))[4:])
                ends, far = np.array([0, len(flat)]), np.array([0, len(unseen)])
                held = []
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(count.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(got), pa.array(score),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(far, pa.int32()), pa.array(unseen.view(np.int64))),
            ], ["h", "words", "seen", "got", "score", "rare", "pairs"])

    made = written(base.select("h", "text").mapInArrow(run, "h bigint, words bigint, seen bigint, got double, score double, rare array<bigint>, pairs array<bigint>"), "scores")
    one = made.groupBy("h").agg(*(F.first(c).alias(c) for c in ("words", "seen", "got", "score")), F.count("*").alias("copies"))
    rare = made.select("h", F.explode("rare").alias("key")).groupBy("key", "h").agg(F.count("*").alias("times"))
    rare = rare.join(words.withColumnRenamed("n", "c"), "key", "left")
    rare = rare.groupBy("h").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_seen"), F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) - F.lit(scale))).alias("rare_got"))
    others = made.select("h", F.explode("pairs").alias("key")).join(chances.where(F.floor(F.log2("met")) < least).select("key", "value"), "key").groupBy("h").agg(F.sum("value").alias("rest"))
    end = float(np.log10(ends + 0.1) - scale)
    each = one.join(rare, "h", "left").join(others, "h", "left").select(
        "h", (F.col("words") + 1).alias("n_tokens"),
        (F.col("seen") + F.coalesce(F.col("rare_seen") / F.col("copies"), F.lit(0)) + int(ends > 0)).cast("bigint").alias("n_known"),
        (F.col("got") + F.coalesce(F.col("rare_got") / F.col("copies"), F.lit(0.0)) + F.lit(end)).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("rest") / F.col("copies"), F.lit(0.0))).alias("score"),
    )
    return base.select(key, "learned", "h").join(each, "h").select(
        key, (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
