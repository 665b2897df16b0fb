"""Quality rules: rule statistics of each document, and isolation forests over them.

Statistics cover every whole text. One forest looks at the statistics of characters, another at those
of repetition. As the method has it, each tree grows on `TREE_ROWS` rows, drawn for it from all labelled
documents. Each threshold comes from the scores of all of them: where the labels separate best without
dropping more than `MAX_CLEAN_DROPPED` of the good ones.

Labelled documents with equal statistics are counted together, so results depend neither on the order
of rows nor on how they are partitioned. What reaches the driver is what the trees drew, and the scores
of that small part of the good ones among which a threshold lies.

Defined results: null and empty texts have no words, fail the base rule and are not kept; repeated
rows get equal results; without labels of both kinds nothing but the base rule drops a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.shared import discard, written

TREES, TREE_ROWS, SEED = 100, 256, 11
#: Rows met for each one that a tree keeps: those with the lowest draws of so many, or of all.
SPARE = 1.5
MAX_CLEAN_DROPPED = 0.001
#: Features that each forest looks at.
VIEWS = ((0, 1, 2), (3, 4))
#: Bad rows for each good one that the trees see: anomalies must be rare to stand alone.
RARE = 0.03
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_marks", "n_lines")
KINDS = ", ".join(f"{k} bigint" for k in (*COUNTS, *EXTRA))
#: Copies of one row that are drawn at once.
COPIES = 1 << 16


def per_doc(flags: np.ndarray, texts: K.Texts) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[texts.end] - total[texts.start]


def repeated_words(h: np.ndarray, words: K.Words) -> np.ndarray:
    """Per document, the words that lie in a 3-word window found twice or more in it."""
    n = len(h)
    covered = np.zeros(n, bool)
    if n >= 3:
        at = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        key = K.mix64(K.shingle_hashes(h, 3)[at] + K.mix64(words.doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        for j in range(3):
            covered[hit + j] = True
    total = np.concatenate(([0], np.cumsum(covered)))
    return total[words.last] - total[words.first]


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    texts = K.Texts(column)
    words = K.Words(texts)
    starts_char = ((texts.data & 0xC0) != 0x80) & ~K.SPACE[texts.data]
    dup = np.zeros(texts.n, np.int64)
    lines = np.zeros(texts.n, np.int64)
    for i in range(texts.n):
        own = [x for x in texts.bytes_of(i).split(b"\n") if x.strip()]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": per_doc(starts_char, texts),
        "n_symbols": per_doc(SYMBOL[texts.data], texts),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(K.word_hashes(texts.data, words), words),
        "n_upper": per_doc(UPPER[texts.data], texts),
        "n_marks": per_doc(MARK[texts.data], texts),
        "n_lines": lines,
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([
        s["n_symbols"] / words,
        s["n_upper"] / chars,
        s["n_marks"] / words,
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / words,
    ], axis=1)


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays: feature (-1 in a leaf), split value, children, path length at a leaf."""

    def __init__(self, draws: list[np.ndarray], seed: int = SEED):
        """draws: the rows of each tree."""
        rng = np.random.Generator(np.random.PCG64(seed))
        self.trees = []
        self.size = float(np.mean([len(x) for x in draws])) if draws else 0.0
        for own in draws if self.size > 1 else []:
            nodes: list[list[float]] = []
            self._grow(own, 0, math.ceil(math.log2(max(self.size, 2))), rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, rows, depth, limit, rng, nodes) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + float(expected_path(len(rows)))])
        lo, hi = rows.min(0), rows.max(0)
        open_ = np.flatnonzero(hi > lo)
        if depth < limit and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            at = rng.uniform(lo[f], hi[f])
            left = rows[:, f] <= at
            nodes[me][:2] = [f, at]
            nodes[me][2] = self._grow(rows[left], depth + 1, limit, rng, nodes)
            nodes[me][3] = self._grow(rows[~left], depth + 1, limit, rng, nodes)
        return me

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score: 2 ** -(mean path / expected path); near 1 is isolated at once."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for t in self.trees:
            at = np.zeros(len(rows), np.int64)
            f = t[at, 0].astype(np.int64)
            while (inner := f >= 0).any():
                go = every[inner]
                node = at[go]
                left = rows[go, f[go]] <= t[node, 1]
                at[go] = np.where(left, t[node, 2], t[node, 3]).astype(np.int64)
                f = t[at, 0].astype(np.int64)
            total += t[at, 4]
        return 2.0 ** -(total / len(self.trees) / float(expected_path(self.size)))


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def of_batch(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: b.column(b.schema.get_field_index(k)).to_numpy() for k in (*COUNTS, *EXTRA)}


class Judge:
    """The forests of all views with their thresholds; an infinite one drops nothing."""

    def __init__(self, draws: list[np.ndarray]):
        self.forests = [IsolationForest([x[:, list(v)] for x in draws]) for v in VIEWS]
        self.cuts = [float("inf")] * len(VIEWS)

    def each(self, x: np.ndarray) -> np.ndarray:
        """Anomaly by view."""
        return np.stack([f.score(x[:, list(v)]) for f, v in zip(self.forests, VIEWS, strict=True)])

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the worst view lies over its threshold (at most 0: none does), and the highest anomaly."""
        each = self.each(x)
        return (each - np.array(self.cuts)[:, None]).max(0), each.max(0)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the statistics of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, text):
            s = statistics(b.column(1))
            yield pa.RecordBatch.from_pydict({key: b.column(0), **{k: pa.array(s[k]) for k in (*COUNTS, *EXTRA)}})

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, {KINDS}")


def drawn(rows: DataFrame, each: float, rare: float) -> list[np.ndarray]:
    """Features of the rows that each tree drew without replacement from rows (statistics, good, bad: how many
    documents). A bad document weighs `rare` of a good one; each: the part of weight 1 that a tree meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = of_batch(b)
            x, h = features(s), np.full(b.num_rows, SEED, np.uint64)
            for k in (*COUNTS, *EXTRA):
                h = K.mix64(h * np.uint64(K.BASE) + s[k].astype(np.uint64))
            for name, weight in (("good", 1.0), ("bad", rare)):
                n = b.column(b.schema.get_field_index(name)).to_numpy()
                end = np.cumsum(n)
                for lo in range(0, int(n.sum()), COPIES):
                    copy = np.arange(lo, min(lo + COPIES, int(n.sum())))
                    row = np.searchsorted(end, copy, "right")
                    own = K.mix64(h[row] + (copy - end[row] + n[row]).astype(np.uint64) * np.uint64(2) + np.uint64(weight == 1))
                    for t in range(TREES):
                        u = (K.mix64(own + np.uint64(t)) >> np.uint64(11)) / 2.0**53 / weight
                        hit = np.flatnonzero(u < min(each, 1.0))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), t)), pa.array(u[hit]), *map(pa.array, x[row[hit]].T)], [f.name for f in kind])

    kind = pa.schema([("t", pa.int64()), ("u", pa.float64()), *((f"x{i}", pa.float64()) for i in range(sum(map(len, VIEWS))))])
    got = rows.mapInArrow(run, ", ".join(f"{f.name} {'bigint' if f.name == 't' else 'double'}" for f in kind)).toPandas().to_numpy()
    got = got[np.lexsort(got.T[::-1])]
    return [got[got[:, 0] == t][:TREE_ROWS, 2:] for t in range(TREES)] if len(got) else []


def threshold(scores: DataFrame, score: str, n_good: int) -> float:
    """The cut with the best balance of dropped bad and kept good rows among those above which at most
    MAX_CLEAN_DROPPED of the good lie, in the middle of its gap; infinite without bad ones above. scores: (score, good, bad: how many)."""
    over = math.floor((n_good - 1) * MAX_CLEAN_DROPPED)
    top = scores.where("good > 0").groupBy(score).agg(F.sum("good").alias("n")).orderBy(F.desc(score)).limit(over + 1).collect()
    floor, seen = float("inf"), 0
    for r in top:
        floor, seen = r[0], seen + r.n
        if seen > over:
            break
    above = scores.where((F.col("bad") > 0) & (F.col(score) > floor)).agg(F.min(score)).first()[0]
    return float("inf") if above is None else (floor + above) / 2


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> Judge:
    """Forests and thresholds from all labelled documents that the base rule lets through; stats: of `measured`."""
    labelled = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.min("quality") > 0).cast("bigint").alias("good"))
    own = stats.where((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))).join(labelled, key)
    rows = written(own.groupBy(*COUNTS, *EXTRA).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")), "labelled")
    good, bad = (x or 0 for x in rows.agg(F.sum("good"), F.sum("bad")).first())
    rare = min(1.0, RARE * good / bad) if good and bad else 1.0
    judge = Judge(drawn(rows, SPARE * TREE_ROWS / max(1.0, good + rare * bad), rare))
    if not good or not bad:
        return judge
    names = [f"s{i}" for i in range(len(VIEWS))]
    shared = rows.sparkSession.sparkContext.broadcast(judge)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_view = shared.value.each(features(of_batch(b)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, by_view), *(b.column(b.schema.get_field_index(k)) for k in ("good", "bad"))], [*names, "good", "bad"])

    scores = written(rows.mapInArrow(score, ", ".join(f"{k} double" for k in names) + ", good bigint, bad bigint"), "scores")
    judge.cuts = [threshold(scores, k, good) for k in names]
    discard(rows, scores)
    return judge


def verdicts(stats: DataFrame, model: Judge, key: str = "doc_id") -> DataFrame:
    """Counts of every document with base_failed, kept and the anomaly score; stats: of `measured`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = of_batch(b)
            failed, (excess, score) = base_failed(s), model.score(features(s))
            yield pa.RecordBatch.from_pydict({key: b.column(b.schema.get_field_index(key)), **{k: pa.array(s[k]) for k in COUNTS}, "base_failed": pa.array(failed), "kept": pa.array(~failed & (excess <= 0)), "anomaly": pa.array(score)})

    return stats.mapInArrow(run, f"{key} {dict(stats.dtypes)[key]}, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Judge:
    """Forests and thresholds from all labelled documents."""
    return learn(measured(docs, key, text), labels, key)


def judge(docs: DataFrame, model: Judge, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every document with base_failed, kept and the anomaly score."""
    return verdicts(measured(docs, key, text), model, key)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`judge` with a model of the same documents, which are read and measured once."""
    stats = written(measured(docs, key, text), "statistics")
    return verdicts(stats, learn(stats, labels, key), key)
