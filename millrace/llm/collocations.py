"""Collocations of two to five words, set-oriented: relations of occurrences, joined, counted and thinned.

R1 holds the occurrences of frequent words, one row a text: the places of the words in order (a piece's
end skips a place, so next places lie in one piece) and the group, a number for the language's word. Each
round writes the relation as a table, joins it with itself by piece and next place (a phrase of k + 1
words is a frequent phrase of k words whose next place holds another one), counts the pairs of groups, and
keeps the occurrences of pairs met often enough: their groups are the next round's. As a piece lies in
one row, and places are sorted, the join is a merge within rows; what is shuffled are counts summed per batch.

Frequent groups meet the occurrences by broadcast while there are at most `BROADCAST_ROWS`. Beyond that each
row's distinct keys are joined with them by a shuffle, and no result changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.shared import discard, written
from millrace.llm.wordbytes import strings

#: Rows and bytes that Spark hands to Python at once: a text is a row, in a relation with twelve bytes a word.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
LONGEST = 5
BROADCAST_ROWS = 1_000_000
#: Occurrences of a relation that a task works on at once (a longer text stands alone), pairs that it
#: gathers before it counts them, and counts that it hands on at once.
PLACES, PAIRS, COUNTS = 1 << 18, 1 << 21, 1 << 16
#: A language's phrases are ranked in so many slices first, whose best are ranked together.
SLICES = 64
BREAK = np.zeros(256, bool)
BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
BLANK = BREAK.copy()
BLANK[[9, 32]] = True

Occurrences = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]


class Pieces:
    """Words of the texts of a chunk, lower-cased: bytes, text and place of each; key: a number for the
    word in its language."""

    def __init__(self, column: pa.Array, langs: pa.Array):
        texts = K.Texts(column)
        texts.data = K.LOWER[texts.data]
        edge = np.flatnonzero(np.diff((~BLANK[texts.data]).astype(np.int8), prepend=np.int8(0)))
        self.data, self.start, self.end = texts.data, edge[::2], edge[1::2]
        self.doc = np.searchsorted(texts.start, self.start, "right") - 1
        broken = np.cumsum(BREAK[texts.data], dtype=np.int64)[self.start]
        step = 1 + ((np.diff(broken, prepend=0) > 0) | (np.diff(self.doc, prepend=0) > 0))
        at = np.cumsum(step)
        first = np.searchsorted(self.start, texts.start)
        self.place = at - np.append(at, 0)[np.minimum(first, len(at))][self.doc] if len(at) else at
        names = langs.dictionary_encode()
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in names.dictionary.to_pylist()], np.uint64)
        self.lang = names.indices.to_numpy(zero_copy_only=False)[self.doc] if len(self.doc) else self.doc
        h = K.word_hashes(texts.data, self)
        self.key = K.mix64(h ^ seeds[self.lang]).view(np.int64) if len(h) else np.zeros(0, np.int64)
        self.names, self.n = names.dictionary, texts.n


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, key and count of the distinct words of each chunk."""
    for b in K.chunks(batches):
        p = Pieces(b.column(1), b.column(0))
        key, first, n = np.unique(p.key, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([
            p.names.take(pa.array(p.lang[first])).cast(pa.string()), strings(p.data, p.start[first], p.end[first]), pa.array(key), pa.array(n),
        ], ["lang", "word", "key", "n"])


def _of_texts(batches: Iterator[pa.RecordBatch]) -> Occurrences:
    """Texts as (place, key, text) of each word and the number of texts."""
    for b in K.chunks(batches):
        p = Pieces(b.column(1), b.column(0))
        yield p.place, p.key, p.doc, p.n


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """BATCH holds for what runs meanwhile."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a relation in slices of about PLACES occurrences."""
    for b in batches:
        size = np.diff(b.column(b.schema.get_field_index("place")).offsets.to_numpy())
        cut = [0, *(np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // PLACES)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:], strict=False):
            yield b.slice(lo, hi - lo)


def _of_pairs(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Occurrences]:
    """Rows of a relation as (place, key, row) of the occurrences that another one follows at the next
    place; key: both groups."""

    def read(batches: Iterator[pa.RecordBatch]) -> Occurrences:
        for b in _slices(batches):
            place, group = (b.column(b.schema.get_field_index(k)) for k in ("place", "group"))
            row = np.repeat(np.arange(len(place)), np.diff(place.offsets.to_numpy()))
            place, group = place.flatten().to_numpy().astype(np.int64), group.flatten().to_numpy()
            place = np.cumsum(place)  # differences are stored
            k = np.flatnonzero((np.diff(place) == 1) & (np.diff(row) == 0))
            place = place - np.concatenate(([0], place))[np.searchsorted(row, np.arange(b.num_rows))][row] if len(row) else place
            yield place[k], group[k] * np.int64(groups) + group[k + 1], row[k], b.num_rows

    return read


def _pair_counts(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate(held)
        held.clear()
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        n = np.diff(first, append=len(key))
        key = key[first]
        for lo in range(0, len(key), COUNTS):
            yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + COUNTS]), pa.array(n[lo : lo + COUNTS])], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, key, _, _ in _of_pairs(groups)(batches):
            held.append(key)
            if sum(map(len, held)) >= PAIRS:
                yield from counted(held)
        if held:
            yield from counted(held)

    return run


def _numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """rows, written, with an id from 0 on without gaps, and how many there are."""
    own = written(rows.withColumn("__at", F.monotonically_increasing_id()), name)
    counts = dict(own.groupBy(F.shiftright("__at", 33).alias("p")).count().collect())  # one row a partition
    start, total = [], 0
    for p in sorted(counts):
        start.append((p, total))
        total += counts[p]
    if total >= 3_000_000_000:
        raise ValueError("more than three thousand million frequent groups")
    spark = rows.sparkSession
    begins = F.broadcast(spark.createDataFrame(start, "p bigint, start bigint"))
    return own.join(begins, F.shiftright("__at", 33) == F.col("p")).select(*rows.columns, (F.col("__at") - F.shiftleft("p", 33) + F.col("start")).alias("id")), total


def _relation(place: np.ndarray, group: np.ndarray, row: np.ndarray, n: int) -> list[pa.Array]:
    """The occurrences as one row each: differences of places, and groups."""
    offsets = np.searchsorted(row, np.arange(n + 1))
    step = np.diff(place, prepend=0)
    begin = offsets[:-1][np.diff(offsets) > 0]
    step[begin] = place[begin]
    offsets = pa.array(offsets.astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(step.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(group))]


def _thinned(rows: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Occurrences], frequent: DataFrame, n: int, name: str) -> DataFrame:
    """The occurrences whose key is in frequent (key, id), as a written relation (place, group)."""
    if n <= BROADCAST_ROWS:
        table = frequent.select("key", "id").toArrow()
        key, of = (table.column(k).combine_chunks().to_numpy() for k in ("key", "id"))
        by = np.argsort(key)
        shared = rows.sparkSession.sparkContext.broadcast((key[by], of[by]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, ids = shared.value
            for place, key, row, n in read(batches):
                at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                hit = np.flatnonzero(keys[at] == key) if len(keys) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(_relation(place[hit], ids[at[hit]], row[hit], n), ["place", "group"])

        return written(rows.mapInArrow(run, "place array<int>, group array<bigint>").where("size(place) > 1"), name)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, key, row, n in read(batches):
            yield pa.RecordBatch.from_arrays(_relation(place, key, row, n), ["place", "keys"])

    whole = rows.mapInArrow(spread, "place array<int>, keys array<bigint>").where("size(place) > 1")
    whole = written(whole.withColumn("r", F.monotonically_increasing_id()), f"{name}-keys")
    met = whole.select("r", F.explode(F.array_distinct("keys")).alias("key")).join(frequent.select("key", "id"), "key")
    met = met.groupBy("r").agg(F.collect_list(F.struct("key", "id")).alias("met"))  # at most the words of a text

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            place, keys, met = b.columns
            met_row = np.repeat(np.arange(b.num_rows), np.diff(met.offsets.to_numpy()))
            row = np.repeat(np.arange(b.num_rows), np.diff(place.offsets.to_numpy()))
            known = met.flatten()
            by = np.lexsort((known.field(0).to_numpy(), met_row))
            met_key, met_id = known.field(0).to_numpy()[by], known.field(1).to_numpy()[by]
            every, of = np.unique(np.concatenate((met_key, keys.flatten().to_numpy())), return_inverse=True)
            code = met_row * np.int64(len(every)) + of[: len(by)]
            want = row * np.int64(len(every)) + of[len(by) :]
            at = np.minimum(np.searchsorted(code, want), len(code) - 1)
            hit = np.flatnonzero(code[at] == want)
            steps = place.flatten().to_numpy().astype(np.int64)
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            total = np.cumsum(steps)
            place = total - np.repeat(total[begin] - steps[begin], np.diff(np.append(begin, len(row))))
            yield pa.RecordBatch.from_arrays(_relation(place[hit], met_id[at[hit]], row[hit], b.num_rows), ["place", "group"])

    out = whole.join(met, "r").select("place", "keys", "met").mapInArrow(keep, "place array<int>, group array<bigint>")
    out = written(out.where("size(place) > 1"), name)
    discard(whole)
    return out


def _exact_score() -> Column:
    """struct(score, k, l, r) of the lowest cut: floor(1000 * a * n / (l * r)), in whole numbers of 38 digits."""
    whole = "decimal(18,0)"

    def cut(k: Column) -> Column:
        left, right = F.element_at("prefixes", k), F.element_at("suffixes", F.size("prefixes") - k)
        over = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast(whole) * F.col("n").cast(whole)
        score = F.call_function("div", over, left.cast(whole) * right.cast(whole))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("prefixes") - 1), cut))


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase (space-joined), a, prefixes and suffixes (counts of its beginnings and
    ends of 1, 2, ... words) and peer (the count of the commonest phrase one word longer that holds it, or
    null), of all phrases of 2 to `longest` words met at least `least` times; lang and n, its words, of each language."""
    own = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = own.mapInArrow(_word_counts, "lang string, word string, key bigint, n bigint")
    counts = written(counts.groupBy("lang", "word").agg(F.min("key").alias("key"), F.sum("n").alias("a")), "words")
    totals = written(counts.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    level, n = _numbered(counts.where(F.col("a") >= least).select("key", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", F.array("a").alias("prefixes"), F.array("a").alias("suffixes")), "level")
    relation = _thinned(own, _of_texts, level, n, "occurrences")
    discard(counts)
    found = None
    for _ in range(2, longest + 1):
        pairs = relation.select("place", "group").mapInArrow(_pair_counts(n), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        pairs = pairs.withColumn("left", F.col("key").cast("bigint") if n == 0 else F.expr(f"key div {n}")).withColumn("right", F.col("key") if n == 0 else F.expr(f"key % {n}"))
        pairs, m = _numbered(pairs, "pairs")
        pairs = pairs.select("key", "left", "right", "id", F.col("a").alias("b"))
        holds = pairs.select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "b").groupBy("id").agg(F.max("b").alias("peer"))
        if found is not None:
            done = level.join(holds, "id", "left").select("lang", "phrase", "a", "prefixes", "suffixes", "peer")
            found = done if found is True else found.unionByName(done)
        ends = level.select(F.col("id").alias("right"), F.col("last").alias("end"), F.col("suffixes").alias("ends"))
        head = level.select(F.col("id").alias("left"), "lang", "phrase", "prefixes")
        longer = pairs.join(head, "left").join(ends, "right").select(
            "key", "id", "lang", F.concat_ws(" ", "phrase", "end").alias("phrase"), F.col("end").alias("last"), F.col("b").alias("a"),
            F.array_append("prefixes", F.col("b")).alias("prefixes"), F.array_append("ends", F.col("b")).alias("suffixes"))
        longer = written(longer, "level")
        old, relation = relation, _thinned(relation, _of_pairs(n), longer, m, "occurrences")
        discard(old)
        level, n, found = longer, m, found if found is not None else True
    done = level.select("lang", "phrase", "a", "prefixes", "suffixes", F.lit(None).cast("bigint").alias("peer"))
    return (done if found is True else found.unionByName(done)), totals


def collocations(docs: DataFrame, least: int = 100, best: int = 2000, longest: int = LONGEST, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `best` phrases of 2 to `longest` words met
    at least `least` times, by score, then a, both falling, then phrase by bytes. A phrase goes where every
    occurrence lies in a longer one of as many.

    score is the lowest floor(1000 * a * n / (l * r)) over cuts into two parts met l and r times, of n words.
    A null language is `und`; null, empty and wordless texts add nothing; repeated rows count each; no rows
    give none; other columns are not read. Words are told apart by 64 bits of hash, and counted by their letters.
    """
    with _small_batches(docs.sparkSession):  # all that goes through Python ends in there
        phrases, totals = frequent_phrases(docs, least, longest, lang, text)
    kept = phrases.where("peer IS NULL OR peer < a").join(totals, "lang").withColumn("cut", _exact_score())
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("bigint").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    first = slices.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= best)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return first.withColumn("rank", rank).where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
