"""Language identification in two steps: linear support vector machines first tell language families
apart, then one-versus-one machines separate the languages within the chosen family.

Features are hashed byte trigrams of the whole text (ASCII lower-cased, everything that is not a
letter taken as one space). The machines are fitted on at most about `SAMPLE_ROWS` labelled
documents; predictions read every document in full.

Defined results: `und` with score 0 for null texts and texts without a letter, and for every text if
nothing was learned; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K

SAMPLE_ROWS = 2000
BITS = 13
#: Language families by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic", "hr": "slavic", "sr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "hi": "indic", "bn": "indic", "ur": "indic", "ar": "semitic", "he": "semitic",
}

LETTER = np.full(256, 32, np.uint8)
LETTER[65:91] = np.arange(97, 123)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)
ASCII_LETTER = LETTER[:128] != 32


def trigrams(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram at each byte, and whether it counts (holds a letter and starts inside a document)."""
    d = LETTER[texts.data].astype(np.uint32)
    code = d.copy()
    code[:-1] |= d[1:] << np.uint32(8)
    code[:-2] |= d[2:] << np.uint32(16)
    counts = d != 32
    counts[:-1] |= d[1:] != 32
    h = code * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - BITS)).astype(np.int64), counts


def has_letter(texts: K.Texts) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(ASCII_LETTER[np.minimum(texts.data, 127)] & (texts.data < 128))))
    found = total[texts.end] > total[texts.start]
    for i in np.flatnonzero(~found & (texts.length > 0)):
        found[i] = any(c.isalpha() for c in texts.bytes_of(i).decode("utf-8", "replace"))
    return found


class Machines:
    """All pairwise linear machines as the columns of one weight table."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.family = {x: FAMILY.get(x, x) for x in langs}
        self.families = sorted(set(self.family.values()))
        self.pairs: list[tuple[str, str, bool]] = [(a, b, True) for a, b in combinations(self.families, 2)]
        for f in self.families:
            self.pairs += [(a, b, False) for a, b in combinations([x for x in langs if self.family[x] == f], 2)]
        self.weights = np.zeros((1 << BITS, max(1, len(self.pairs))), np.float32)
        self.bias = np.zeros(max(1, len(self.pairs)), np.float32)

    def fit(self, x: np.ndarray, lang: np.ndarray) -> Machines:
        family = np.array([self.family[v] for v in lang])
        for k, (a, b, outer) in enumerate(self.pairs):
            of = family if outer else lang
            use = (of == a) | (of == b)
            self.weights[:, k], self.bias[k] = svm(x[use], np.where(of[use] == a, 1.0, -1.0).astype(np.float32))
        return self

    def margins(self, texts: K.Texts) -> np.ndarray:
        """One row of margins per document: mean weight of its trigrams plus bias."""
        code, counts = trigrams(texts)
        n = np.concatenate(([0], np.cumsum(counts)))
        n = np.maximum(n[texts.end] - n[texts.start], 1)
        out = np.zeros((texts.n, len(self.bias)))
        code = code[counts]
        at = np.concatenate(([0], np.cumsum(counts)))
        for k in range(len(self.pairs)):
            total = np.concatenate(([0.0], np.cumsum(self.weights[:, k][code], dtype=np.float64)))
            out[:, k] = (total[at[texts.end]] - total[at[texts.start]]) / n + self.bias[k]
        return out

    def choose(self, margins: np.ndarray, among: list[str], outer: bool) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes (then by summed margin) and its share of belief, per row."""
        place = {x: i for i, x in enumerate(among)}
        votes = np.zeros((len(margins), len(among)))
        belief = np.zeros((len(margins), len(among)))
        for k, (a, b, o) in enumerate(self.pairs):
            if o == outer and a in place and b in place:
                p = 1 / (1 + np.exp(-np.clip(4 * margins[:, k], -50, 50)))
                votes[:, place[a]] += margins[:, k] > 0
                votes[:, place[b]] += margins[:, k] <= 0
                belief[:, place[a]] += p
                belief[:, place[b]] += 1 - p
        best = np.argmax(votes + belief / (len(among) + 1), axis=1) if len(among) > 1 else np.zeros(len(margins), int)
        share = belief[np.arange(len(margins)), best] / (len(among) - 1) if len(among) > 1 else np.ones(len(margins))
        return best, share

    def predict(self, texts: K.Texts) -> tuple[list[str], np.ndarray]:
        pred, score = np.full(texts.n, "und", object), np.zeros(texts.n)
        if self.langs and texts.n:
            m = self.margins(texts)
            fam, p = self.choose(m, self.families, True)
            for i, f in enumerate(self.families):
                own = [x for x in self.langs if self.family[x] == f]
                rows = np.flatnonzero(fam == i)
                best, q = self.choose(m[rows], own, False)
                pred[rows], score[rows] = np.array(own, object)[best], p[rows] * q
            none = ~has_letter(texts)
            pred[none], score[none] = "und", 0.0
        return pred.tolist(), np.clip(score, 0, 1)


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by accelerated gradient descent; classes weigh the same."""
    n, d = x.shape
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    scale = np.float32(1 / max(1e-12, float(np.sqrt((x * x).sum(1)).mean()))) if n else np.float32(1)
    w = np.zeros(d + 1, np.float32)
    v, t, step = w.copy(), 1.0, 1 / (2 * 4.0 + penalty)
    for _ in range(rounds if n else 0):
        lack = np.maximum(0, 1 - y * (scale * (x @ v[:d]) + v[d]))
        g = -2 * share * y * lack
        grad = np.append(scale * (g @ x), g.sum()).astype(np.float32) + np.float32(penalty) * np.append(v[:d], 0).astype(np.float32)
        new, t2 = v - step * grad, (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = (new + (t - 1) / t2 * (new - w)).astype(np.float32), new.astype(np.float32), t2
    return w[:d] * scale, float(w[d])


def remainder(key: Column, by: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Machines:
    """Machines from at most about sample_rows of the labelled rows of docs, chosen by a hash of the key."""
    known = docs.where(F.col(lang).isNotNull())
    by = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    langs = sorted(by)
    each = max(1, sample_rows // max(1, len(langs)))
    share = F.coalesce(*[F.when(F.col(lang) == x, F.lit(min(1.0, each / by[x]))) for x in langs]) if langs else F.lit(0.0)
    sample = known.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1_000_003)) < share * 1_000_003).select(lang, text)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, text):
            texts = K.Texts(b.column(1))
            code, counts = trigrams(texts)
            rows = []
            for s, e in zip(texts.start, texts.end, strict=True):
                at, n = np.unique(code[s:e][counts[s:e]], return_counts=True)
                rows.append((at.astype(np.int32), n.astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"lang": b.column(0).cast(pa.string()), "at": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "n": pa.array([r[1] for r in rows], pa.list_(pa.int32()))})

    got = sample.mapInArrow(measure, "lang string, at array<int>, n array<int>").toPandas()
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for i, (at, n) in enumerate(zip(got["at"], got["n"], strict=True)):
        if len(at):
            x[i, at] = np.asarray(n, np.float32) / np.sum(n)
    order = np.lexsort((x[:, :64] @ np.arange(1, 65, dtype=np.float32), got["lang"].to_numpy().astype(str))) if len(got) else np.zeros(0, int)
    return Machines(langs).fit(x[order], got["lang"].to_numpy()[order].astype(str))


def predict(docs: DataFrame, machines: Machines, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, text):
            pred, score = machines.predict(K.Texts(b.column(1)))
            yield pa.RecordBatch.from_pydict({key: b.column(0), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double")


def keep_recognised(docs: DataFrame, machines: Machines, least: float, text: str = "text") -> DataFrame:
    """The rows of docs whose language is recognised with a score of at least `least`, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, text):
            pred, score = machines.predict(K.Texts(b.column(b.schema.get_field_index(text))))
            yield b.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
