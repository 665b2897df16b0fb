"""Collocations against counts of every phrase by plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import collocations as C


def brute(rows, least, best):
    words, phrases = Counter(), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, 6):
                phrases.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: a for k, a in phrases.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        n = words[lang]
        if any(x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in found.items()):
            continue
        cuts = [(1000 * a * n // (phrases[lang, p[:k]] * phrases[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), phrases[lang, p[:k]], phrases[lang, p[k:]], n))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n, -s) for lang, r in out.items() for i, (s, a, p, left, right, n) in enumerate(sorted(r)[:best]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "naïve", "日本", "a", "b", "c\x1c", "x-y", "(z)"]
    fixed = ["new york city", "in the state of", "a a a a", "x-y (z) x-y (z)"]
    out = []
    for _ in range(200):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        out.append((rng.choice(["en", "de", None, "und", "en"]), "".join(p + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", " ! ", "\r\n"]) for p in parts)))
    return out + [("en", None), ("en", ""), ("fr", " . ,\n"), (None, "a"), *[("en", "New York city.")] * 40, ("de", "w " * 4000)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("bound", "least", "best"), [(1_000_000, 5, 2000), (0, 12, 7)])
def test_collocations_equal_plain_counts(spark, rows, monkeypatch, bound, least, best):
    monkeypatch.setattr(C, "BROADCAST_ROWS", bound)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, a int").repartition(4)
    df = C.collocations(docs, least, best)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert got(df) == brute(rows, least, best)


def test_large_batches_are_worked_on_in_slices():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(400, rng.integers(0, 300), replace=False)) + 1 for _ in range(9_000)] + [np.arange(1, 400_000)]
    groups = [rng.integers(0, 40, len(r)) for r in rows]
    batch = pa.RecordBatch.from_arrays([
        pa.array([np.diff(r, prepend=0) for r in rows], pa.list_(pa.int32())), pa.array(groups, pa.list_(pa.int64()))], ["place", "group"]).slice(7)
    whole = list(C._of_pairs(40)(iter([batch])))
    assert sum(n for *_, n in whole) == batch.num_rows and len(whole) > 4 and max(len(key) for _, key, _, n in whole if n > 1) < C.PLACES + 300
    want, lo = Counter(), 7
    for place, key, row, n in whole:
        ends = np.searchsorted(row, np.arange(n + 1))
        for i in range(n):
            r, g, own = rows[lo + i], groups[lo + i], slice(ends[i], ends[i + 1])
            at = np.flatnonzero(np.diff(r) == 1)
            assert (place[own] == r[at]).all() and (key[own] == g[at] * 40 + g[at + 1]).all()
            want.update((g[at] * 40 + g[at + 1]).tolist())
        lo += n
    got = Counter()
    for b in C._pair_counts(40)(iter([batch])):
        for k, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[k] += n
    assert got == want
    assert list(C._pair_counts(40)(iter([batch.slice(0, 0)]))) == []


def test_scores_beyond_64_bits(spark):
    made = [("en", "a b", 9 * 10**14, [10**15, 9 * 10**14], [9 * 10**14 + 7, 9 * 10**14], 10**17)]
    row = spark.createDataFrame(made, "lang string, phrase string, a long, prefixes array<long>, suffixes array<long>, n long").select(C._exact_score().alias("s")).first().s
    assert (int(row.score), row.k, row.l, row.r) == (1000 * 9 * 10**14 * 10**17 // (10**15 * (9 * 10**14 + 7)), 1, 10**15, 9 * 10**14 + 7)


def test_no_rows_and_nothing_frequent(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert got(C.collocations(empty)) == []
    assert got(C.collocations(spark.createDataFrame([("en", "one two three")], "lang string, text string"))) == []
