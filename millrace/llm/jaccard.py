"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the distinct hashes of its 5-word shingles. Sets with Jaccard similarity of at
least 4/5 share at least t = ceil(4n/5) of the n shingles of each, so in any order common to all
sets, their first common shingle is among the first n - t + 1 of both and the second among the first
n - t + 2. The order puts rare shingles before frequent ones. A rare shingle in the prefix is indexed
alone. Where the first common shingle is frequent, so are all, and the prefix extended by one holds
two of them: frequent shingles are indexed as combinations of two. A set of n frequent shingles has some
n * n / 50 combinations, 8 million for 20,000 words, so sets of `LONG` shingles or more index frequent shingles
alone; sets that may match either kind are indexed both ways, and the links are the same.

Which shingles are frequent only decides speed; any table gives the same result. It is counted over
all documents and holds at most `MAX_FREQUENT` shingles, so it can be broadcast. Shingles that crowd in places are
counted window by window; those spread thinly over a large corpus by one in `ONE_IN` of all (shingle, set) pairs, taken
by hash, so that what is shuffled for the counts stays a fixed part of the input.

Documents with equal sets enter once. Within an index entry, each set is first paired with the most
central one only, and pairs are verified exactly, after a bound from small sketches; then only sets that are still in different
components, and that position and length don't rule out, are paired. So an entry of n near copies
gives about n pairs, and no link between components is missed.

Defined results: null texts and texts without words have empty sets and no links; a text of fewer
than five words is one shingle; repeated rows are copies, linked with one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.components import components
from millrace.llm.shared import discard, written

WORDS = 5
#: A shingle counted this often is frequent; the count of a window only sees shingles met LOCAL times in it.
FREQUENT, LOCAL, WINDOW = 64, 4, 4_000_000
#: Part of all (shingle, set) pairs, by hash, whose counts are kept without a window; MET of them make a shingle frequent.
ONE_IN, MET = 64, 8
MAX_FREQUENT = 500_000
LONG = 1000
#: Parts that the rows of one component are dealt to when they get its smallest key.
SALTS = 32
#: Classes of a set's sketch.
BUCKETS = 512


def needed(n: np.ndarray | int):
    """Least overlap of a set of n with any set linked to it: ceil(4n / 5)."""
    return (4 * n + 4) // 5


def document_sets(texts: K.Texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    data = K.LOWER[texts.data]
    words = K.Words(texts)
    h = K.word_hashes(data, words)
    s = K.shingle_hashes(h, WORDS)
    out = []
    for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(s[a : b - WORDS + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for j in range(a, b):
                short = K.mix64(short * K.MIX[20] + h[j : j + 1])
            out.append(K.mix64(short + K.MIX[20 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Order:
    """The frequent shingles, and the common order: rare ones first, each kind by hash."""

    def __init__(self, frequent: np.ndarray):
        self.table = np.sort(frequent.astype(np.uint64))
        self.mark = np.zeros(1 << 20, bool)
        self.mark[(self.table >> np.uint64(44)).astype(np.int64)] = True

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.mark[(s >> np.uint64(44)).astype(np.int64)])
        known = np.zeros(len(s), bool)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.table, s[maybe]), len(self.table) - 1)
            known[maybe] = self.table[at] == s[maybe]
        return s[~known], s[known]

    def signatures(self, s: np.ndarray, long_: int = LONG) -> tuple[np.ndarray, np.ndarray]:
        """Index keys of a set, and the position in the order (from 0) of the first shingle of each."""
        n = len(s)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        t = int(needed(n))
        rare, frequent = self.split(s)
        keys, places = [rare[: n - t + 1]], [np.arange(min(len(rare), n - t + 1))]
        if n >= needed(long_) or n == 1:
            alone = frequent[: max(0, n - t + 1 - len(rare))]
            keys.append(alone)
            places.append(len(rare) + np.arange(len(alone)))
        if 1 < n < long_:
            two = frequent[: max(0, n - t + 2 - len(rare))]
            i, j = np.triu_indices(len(two), 1)
            keys.append(K.mix64(two[i] * K.MIX[30] + two[j] * K.MIX[31]))
            places.append(len(rare) + i)
        return np.concatenate(keys), np.concatenate(places)


def _sets_and_counts(docs: DataFrame) -> DataFrame:
    """Rows (key, n, set_id) of documents and rows (shingle, seen, met) of shingles met often in a window, or in the part
    of pairs that is counted everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, thin, size = [], [], 0
        names = ["key", "n", "set_id", "shingle", "seen", "met"]

        def counted() -> Iterator[pa.RecordBatch]:
            for some, least, column in ((held, LOCAL, 4), (thin, 1, 5)):
                s, n = np.unique(np.concatenate(some), return_counts=True)
                s, n = s[n >= least], n[n >= least]
                rows = [[None] * len(s)] * 6
                rows[3], rows[column] = s.view(np.int64), n
                yield batch(rows)
                some.clear()

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names)

        for b in K.chunks(batches, "text"):
            sets = document_sets(K.Texts(b.column(1)))
            none = [None] * len(sets)
            ids = [set_id(s) if len(s) else None for s in sets]
            yield batch([b.column(0), [len(s) for s in sets], ids, none, none, none])
            for s, i in zip(sets, ids, strict=True):
                if i is not None:
                    held.append(s)
                    thin.append(s[K.mix64(s ^ np.uint64(i % 2**64)) % np.uint64(ONE_IN) == 0])
                    size += len(s)
            if size > WINDOW:
                yield from counted()
                size = 0
        if held:
            yield from counted()

    return docs.mapInArrow(run, "key bigint, n bigint, set_id bigint, shingle bigint, seen bigint, met bigint")


def _frequent(counts: DataFrame) -> np.ndarray:
    """The frequent shingles; the least count is doubled until at most MAX_FREQUENT are left."""
    met = F.sum("met")
    everywhere = F.when(met >= MET, met * ONE_IN)
    total = counts.groupBy("shingle").agg(F.greatest(F.sum("seen"), everywhere).alias("seen")).where(F.col("seen") >= FREQUENT)
    level = total.groupBy(F.floor(F.log2("seen")).alias("k")).count().collect()
    left, least = sum(r["count"] for r in level), 0
    for r in sorted(level, key=lambda r: r.k):
        if left <= MAX_FREQUENT:
            break
        left, least = left - r["count"], r.k + 1
    got = total.where(F.floor(F.log2("seen")) >= least).select("shingle").toPandas()["shingle"]
    return got.to_numpy(np.int64).view(np.uint64)


def _index(docs: DataFrame, order: Order) -> DataFrame:
    """(sig, set_id, n, rest): index entries; rest is how many shingles follow from the entry's first on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, "text"):
            done: set[int] = set()
            keys, ids, sizes = [], [], []
            for s in document_sets(K.Texts(b.column(0))):
                if len(s) and (i := set_id(s)) not in done:
                    done.add(i)
                    k, place = order.signatures(s)
                    keys.append(k)
                    ids.append(np.full(len(k), i))
                    sizes.append(len(s) << 32 | (len(s) - place))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes))], ["sig", "set_id", "size"])

    return docs.select("text").mapInArrow(run, "sig bigint, set_id bigint, size bigint")


def possible(n: np.ndarray, rest: np.ndarray, m: int, others: int) -> np.ndarray:
    """Whether sets of n can overlap enough with one of m, by what follows the shared entry in both."""
    return (9 * np.minimum(rest, others) >= 4 * (n + m)) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole runs of equal sig from batches sorted by it, as arrays of the other columns.

    The parts of the run that is still open are put together once, when it ends.
    """
    parts: list[list[np.ndarray]] = []

    def ended() -> Iterator[tuple[np.ndarray, ...]]:
        whole = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        if whole and len(whole[0]) > 1:
            yield whole[1:]

    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        cut = np.append(np.flatnonzero(np.diff(cols[0])) + 1, len(cols[0]))
        begin = np.append(0, cut[:-1])
        if parts and parts[0][0][0] != cols[0][0]:
            yield from ended()
        if len(cut) > 1:
            parts.append([c[: cut[0]] for c in cols])
            yield from ended()
            for i in np.flatnonzero(cut - begin > 1):
                if 0 < i < len(cut) - 1:
                    yield tuple(c[begin[i] : cut[i]] for c in cols[1:])
        parts.append([c[begin[-1] :] for c in cols])
    yield from ended()


def _pairs(rows: DataFrame, crossing: bool) -> DataFrame:
    """Candidate pairs (a, b), a < b, of index entries. First each member with the most central one;
    with `crossing`, members of different components (column label) with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        out: list[tuple[int, int]] = []

        def put(a: int, others: np.ndarray) -> None:
            for b in others.tolist():
                p = (a, b) if a < b else (b, a)
                if p not in seen:
                    seen.add(p)
                    out.append(p)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

        for ids, size, *label in _groups(batches):
            n, rest = size >> 32, size & 0xFFFFFFFF
            if crossing:
                label = label[0]
                names, count = np.unique(label, return_counts=True)
                if len(names) == 1:
                    continue
                largest = names[np.argmax(count)]
                outside = np.flatnonzero(label != largest)
                for x, i in enumerate(outside):
                    ok = possible(n, rest, n[i], rest[i]) & (label != label[i])
                    ok[outside[:x]] = False
                    put(int(ids[i]), ids[ok])
                    if len(out) > 50_000:
                        yield batch()
                        out.clear()
            else:
                i = np.lexsort((ids, -(rest / n)))[0]
                ok = possible(n, rest, n[i], rest[i]) & (ids != ids[i])
                put(int(ids[i]), ids[ok])
            if len(seen) > 200_000:
                seen.clear()
            if len(out) > 50_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    names = ["sig", "set_id", "size", *(["label"] if crossing else [])]
    near = rows.select(*names).repartition("sig").sortWithinPartitions("sig")
    return near.mapInArrow(run, "a bigint, b bigint").distinct()


def sketch(s: np.ndarray) -> bytes:
    """How many shingles of a set fall in each of BUCKETS classes (255: that many or more)."""
    return np.minimum(np.bincount((s >> np.uint64(16)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs that the sketches don't rule out: the overlap is at most the sum of the smaller counts,
    so no linked pair is lost, and only few sets have to travel for the exact test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, BUCKETS) for i in (4, 5))
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            open_ = (x == 255).any(1) | (y == 255).any(1)
            yield b.select([0, 1]).filter(pa.array(open_ | (9 * most >= 4 * n)))

    first = pairs.join(sketches.withColumnsRenamed({"set_id": "a", "n": "na", "sketch": "ka"}), "a")
    both = first.join(sketches.withColumnsRenamed({"set_id": "b", "n": "nb", "sketch": "kb"}), "b")
    return both.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough, by exact overlap of the shingle sets."""
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    of = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("r").alias("r")).join(wanted, "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, "text"):
            ids = b.column(0).to_pylist()
            own = [(i, s) for i, s in zip(ids, document_sets(K.Texts(b.column(1))), strict=True) if len(s) and set_id(s) == i]
            flat = np.concatenate([s for _, s in own]) if own else np.zeros(0, np.uint64)
            ends = np.cumsum([0] + [len(s) for _, s in own])
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in own], pa.int64()), pa.array([len(s) for _, s in own], pa.int64()), pa.array([sketch(s) for _, s in own], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64))),
            ], ["set_id", "n", "sketch", "shingles"])

    found = docs.join(of.hint("shuffle_hash"), "r").select("set_id", "text").mapInArrow(run, "set_id bigint, n bigint, sketch binary, shingles array<bigint>")
    found = written(found, "sets")
    likely = written(_likely(pairs, found.select("set_id", "n", "sketch")), "likely-pairs")
    shingles = found.select("set_id", "shingles").hint("merge")  # Spark takes an array for one element when it sizes a table
    first = likely.join(shingles.withColumnsRenamed({"set_id": "a", "shingles": "sa"}), "a")
    second = first.join(shingles.withColumnsRenamed({"set_id": "b", "shingles": "sb"}), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    links = written(second.where(100 * both >= 80 * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct(), "links")
    discard(found, likely)
    return links


def linked_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row of docs; component_id is the smallest key that
    links lead to."""
    base = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = written(_sets_and_counts(base), "sets-and-counts")
    sets = made.where("n IS NOT NULL").select("key", "n", "set_id").withColumn("r", F.xxhash64("key"))
    order = Order(_frequent(made.where("shingle IS NOT NULL")))
    # One shuffle of the index; entries of a single set go before anything else happens to them.
    same = Window.partitionBy("sig")
    index = _index(base, order).withColumn("least", F.min("set_id").over(same)).withColumn("most", F.max("set_id").over(same))
    entries = written(index.where("least <> most").select("sig", "set_id", "size"), "index")
    texts = base.select(F.xxhash64("key").alias("r"), "text")
    links = _verified(written(_pairs(entries, False), "pairs"), texts, sets)
    labels = components(links)
    labelled = entries.join(labels.select(F.col("v").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    more = written(_pairs(labelled, True), "crossing-pairs")
    if not more.isEmpty():
        labels = components(links.union(_verified(more, texts, sets)))
    discard(entries)
    named = sets.join(labels.select(F.col("v").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    # A row alone in its component has its own key. Of other components there is one row for each part; Spark sizes that table
    # as if it were not exploded, so it is kept from being broadcast.
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("key").alias("component_id"), F.count("*").alias("rows")).where("rows > 1")
    least = least.select("label", "component_id", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")).hint("merge")
    return named.withColumn("salt", F.pmod(F.xxhash64("key", "set_id"), F.lit(SALTS)).cast("int")).join(least, ["label", "salt"], "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when one document of each component stays: the one with the
    smallest key (nulls last); of rows with equal key and text one stays."""
    own = docs.withColumn("__own_s", F.xxhash64(F.col(key), F.col(text)))
    linked = linked_documents(own.select("__own_s", F.col(text).alias("text")), "__own_s", "text")
    linked = linked.select("__own_s", "component_id").distinct()
    ids = own.select("__own_s", F.col(key).alias("__own_key")).distinct()
    first = F.min(F.struct(F.col("__own_key").isNull(), "__own_key", "__own_s"))
    stay = linked.join(ids, "__own_s").groupBy("component_id").agg(first.alias("first")).select(F.col("first.__own_s").alias("__own_s"))
    stay = written(stay, "stay")
    kept = own.join(stay, "__own_s", "left_semi")
    if not ids.isEmpty() and own.select("__own_s").join(stay, "__own_s", "left_semi").groupBy("__own_s").count().where("count > 1").isEmpty():
        return kept.select(*docs.columns)
    return kept.dropDuplicates(["__own_s"]).select(*docs.columns)
