"""Runs of words against a plain scan of every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from millrace.llm import kernels as K
from millrace.llm import periods
from millrace.llm.queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=12):
    """(start, period, length) of every run, by start, then period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, q, n) for (s, n), q in found.items())


def made_words(rng):
    n, a = rng.choice([0, 1, 11, 12, 13, 40, 90]), rng.choice([1, 2, 3, 12])
    w = [rng.randrange(a) for _ in range(n)]
    if n and rng.random() < 0.6:
        s, p = rng.randrange(n), rng.randint(1, 14)
        w[s:] = [w[s + (i - s) % p] for i in range(s, n)]
    return w


def test_runs_equal_a_scan_of_all_periods():
    rng = random.Random(2)
    for _ in range(600):
        docs, least = [made_words(rng) for _ in range(rng.randint(1, 4))], rng.choice([12, 12, 2, 3, 7])
        codes = K.mix64(np.array([x + 7 for d in docs for x in d], np.uint64))
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        start, length, period = periods.runs_of(codes, doc, least)
        offset = np.cumsum([0, *map(len, docs)])
        want = [(s + offset[k], q, n) for k, d in enumerate(docs) for s, q, n in plain_runs(d, least)]
        assert list(zip(start.tolist(), period.tolist(), length.tolist(), strict=True)) == want


def test_work_grows_nearly_with_length():
    for make in (lambda i: i * 0, lambda i: i % 7, lambda i: i * i % 11):
        codes = K.mix64(make(np.arange(120_000)).astype(np.uint64) + np.uint64(3))
        start, length, _ = periods.runs_of(codes, np.zeros(len(codes), np.int64))
        assert start.tolist() == [0] and length.tolist() == [120_000]


def contract_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, q, k in runs for i in range(s + q, s + k)}
    text = "".join(f"{s},{k},{q}\n" for s, q, k in runs)
    top = max(((k, -s, -q) for s, q, k in runs), default=None)
    best = (-top[1], top[0], -top[2], 1000 * top[0] // -top[2]) if top else (None,) * 4
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (text, " ".join(x for i, x in enumerate(w) if i not in drop))]
    return (doc_id, len(runs), *best, *sha)


def test_query_equals_the_contract_by_plain_loops(spark, tmp_path):
    rng = random.Random(9)
    gaps = [" ", "\n", "\t", " \r\n\x0b\x0c", "  "]
    rows = [(i, "".join(f"w{x}é" + rng.choice(gaps) for x in made_words(rng))) for i in range(160)]
    rows += [(900, None), (901, ""), (902, " \n "), (None, "a b " * 12), (903, "日本 語\x1c " * 9), (904, "\x00 x " * 14), (5, rows[5][1]), (905, "n" * 300)]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((contract_row(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5


def test_operator_gives_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([("k", "x " + "a b c " * 5 + "d"), (None, None)], "doc_id string, text string")
    rows = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert [tuple(x) for x in rows["k"].runs] == [(1, 15, 3)] and rows["k"].collapsed == "x a b c d" and rows["k"].n_words == 17
    assert rows[None].runs == [] and rows[None].collapsed == "" and rows[None].n_words == 0
    assert periods.periodic_runs(docs.limit(0)).collect() == []
