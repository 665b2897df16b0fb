from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import linear
from millrace.functions import text as T
from millrace.operators import dml
from millrace.plans import shell


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_identifiers(spark):
    assert one(spark, T.parse_id(F.lit("own__repo.1234abcd.pr_77"))).number == 77
    assert one(spark, T.parse_id(F.lit("own__repo-12"))).repo == "own/repo"
    assert one(spark, T.parse_id(F.lit("some-slug-pr-5-ab"))).repo == "some-slug"
    assert one(spark, T.parse_id(F.lit("nothing"))) is None
    assert one(spark, T.repo_slug(F.lit("FreeCAD__FreeCAD "))) == "freecad-freecad"
    assert one(spark, T.norm_id(F.lit(" A_interface"))) == "a"


def test_shingles_and_quality(spark):
    assert one(spark, T.shingles(T.tokens(F.lit("a b c")), 2)) == ["a b", "b c"]
    assert one(spark, T.shingles(T.tokens(F.lit("")), 2)) == []
    assert one(spark, T.quality_reason(F.lit("  "))) == "empty"
    assert one(spark, T.quality_reason(F.lit("a b"))) == "short"
    assert one(spark, T.quality_reason(F.lit("x " * 30))) == "repetitive"
    assert one(spark, T.quality_reason(F.lit("one two three four five six seven eight"))) is None


def test_blob_and_letters(spark):
    assert one(spark, T.blob_sha1(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, T.letter_value(F.lit("t"))) == 1.0
    assert one(spark, T.letter_value(F.lit("z"))) is None and one(spark, T.letter_value(F.lit("AB"))) is None
    worth = {"A": 0.0, "C": 0.075, "E": 0.15, " f": 0.19, "J": 0.35, "k": 0.42, "O": 0.7, "S": 0.94}
    assert {k: one(spark, T.letter_value(F.lit(k))) for k in worth} == worth
    assert one(spark, T.concise_fault(F.lit("x\nValueError: no\ntail"))) == "ValueError: no"


def test_linkage_and_fit():
    assert linear.average_linkage([[1, 0], [1, 0.01], [0, 1]], 0.55) == [0, 0, 1]
    c, r = linear.nonnegative_fit(np.array([1.0, 2.0]), np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert np.allclose(c, [1, 2]) and r < 1e-9
    assert linear.matched_rows(np.eye(3), np.eye(3)[[2, 0, 1]]).tolist() == [1, 2, 0]
    noise = np.random.default_rng(0).standard_normal((40, 40))
    assert linear.spectrum(noise + 50 * np.outer(np.ones(40), np.ones(40)))["structured"] > 0.9 > linear.spectrum(noise)["structured"]


def test_weights(spark):
    from millrace.operators import weights

    assert abs(linear.gavish_donoho(1.0) - 2.858) < 2e-3 and abs(linear.gavish_donoho(0.5) - 2.1711) < 2e-3
    rng = np.random.default_rng(0)
    w = rng.standard_normal((6, 5))
    order = [3, 0, 5, 1, 2, 4]
    place, cos, same = linear.one_to_one(w[order], w)
    assert [order[p] for p in place] == list(range(6)) and cos > 0.999 and same < 0.5
    assert sorted(linear.one_to_one(np.eye(3), np.ones((3, 3)))[0]) == [0, 1, 2]  # ties never share a row
    kinds = "model string, tensor string, rows array<array<double>>"
    rows = [("a", "t", w.tolist()), ("b", "t", w.tolist()), ("b", "u", (2 * w).tolist()), ("c", "t", (w + 1).tolist())]
    got = {r.model: r for r in weights.fingerprints(spark.createDataFrame(rows, kinds), k=4, width=8).collect()}
    assert got["a"].sketches["t"] == got["b"].sketches["t"] != got["c"].sketches["t"] and len(got["a"].vector) == 8
    assert np.allclose(got["b"].norm, np.sqrt(5) * np.linalg.norm(w)) and sorted(got["b"].samples) == ["t", "u"]
    pairs = spark.createDataFrame([("a", "t", w[order].tolist(), w.tolist())], kinds + ", ref_rows array<array<double>>")
    assert [order[p] for p in weights.aligned(pairs).first().place] == list(range(6))
    flags = spark.sql("SELECT * FROM VALUES (0.5D, 0.95D, 0.1D), (0.4D, 0.95D, 0.99D), (0.4D, 0.3D, 0.4D), (0.4D, 0.3D, 0.2D) AS t(r, m, k)")
    assert [r[0] for r in flags.select(weights.expert_choice(F.col("r"), F.col("m"), F.col("k"))).collect()] == [False, True, False, True]


FILES = [("a/x.py", "import os\ndef f():\n  return 1\n"), ("a/y.txt", "foo\nbar\nfoo\n"), ("b/z.py", "return\n")]


@pytest.mark.parametrize("command, want", [
    ("grep -rn return a", [("a/x.py", 3, "  return 1")]),
    ("grep -rE '^(foo|bar)$' a", [("a/y.txt", 1, "foo"), ("a/y.txt", 2, "bar"), ("a/y.txt", 3, "foo")]),
    ("grep -r --include='*.py' -A1 def .", [("a/x.py", 2, "def f():"), ("a/x.py", 3, "  return 1")]),
    ("sed -n 2,3p a/y.txt", [("a/y.txt", 2, "bar"), ("a/y.txt", 3, "foo")]),
    ("tail -1 a/y.txt", [("a/y.txt", 3, "foo")]),
])
def test_shell_lines(spark, command, want):
    got = shell.run_command(spark.createDataFrame(FILES, "path string, text string"), command).select("path", "i", "line")
    assert sorted(map(tuple, got.collect())) == want


def test_shell_pipes_and_declines(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    assert [r.line for r in shell.run_command(files, "cat a/y.txt | sort -r | head -2").collect()] == ["foo", "foo"]
    assert [r.line.split() for r in shell.run_command(files, "cat a/y.txt | sort | uniq -c").collect()] == [["1", "bar"], ["2", "foo"]]
    assert sorted(r.line for r in shell.run_command(files, "find . -name '*.py'").collect()) == ["a/x.py", "b/z.py"]
    assert shell.run_command(files, "grep -rc foo a").where("path = 'a/y.txt'").first().n == 2
    for bad in ("rm -rf /", "grep x a && ls", "awk '{print}' a", "cat a/y.txt | uniq -c"):
        with pytest.raises(shell.Declined):
            shell.run_command(files, bad)


def test_shell_counts_and_literals(spark):
    files = spark.createDataFrame([*FILES, ("s.txt", "a^b\n$x\n")], "path string, text string")
    assert [tuple(r) for r in shell.run_command(files, "wc -l a/y.txt").collect()] == [("a/y.txt", 3)]
    assert sorted(map(tuple, shell.run_command(files, "wc -lw a/x.py a/y.txt").collect()), key=str) == [("a/x.py", 3, 6), ("a/y.txt", 3, 3), (None, 6, 9)]
    assert [r.line for r in shell.run_command(files, "grep 'a^b' s.txt").collect()] == ["a^b"]
    assert [r.line for r in shell.run_command(files, "grep '$x' s.txt").collect()] == ["$x"]
    for bad in ("grep -o x a", "grep -q x a", "grep -H x a", "find . -name x -o -name y"):
        with pytest.raises(shell.Declined):
            shell.run_command(files, bad)


def test_positions(spark):
    from millrace.functions.positions import positions

    rows = spark.sql("SELECT id, CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 = 7 THEN NULL ELSE 'b' END AS k FROM range(5000) UNION ALL SELECT NULL, 'b'")
    for r in positions(rows, "k", "id", buckets=16).groupBy("k").agg(F.sort_array(F.collect_list("position")).alias("p"), F.sort_array(F.collect_list(F.struct("position", "id"))).alias("o")).collect():
        assert r.p == list(range(len(r.p)))
        ids = [x.id for x in r.o if x.id is not None]
        assert ids == sorted(ids)
    assert positions(rows.limit(0), "k", "id").count() == 0


def test_nearest_scopes(spark):
    from millrace.operators.vectors import nearest

    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist(), i % 3, i % 7) for i in range(120)] + [(500, rng.standard_normal(6).tolist(), 0, 0)]
    rows += [(200 + i, rows[i][1], 1, 1) for i in range(5)]
    bank = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, block int").repartition(4)
    queries = bank.where("vec_id % 20 = 0")

    def brute(keep):
        return sorted((q[0], b[0], k + 1) for q in rows if q[0] % 20 == 0 for k, b in enumerate(sorted((b for b in rows if b[0] != q[0] and keep(q, b)), key=lambda b: (float(np.sqrt(((np.array(q[1]) - b[1]) ** 2).sum())), b[0]))[:4]))

    got = lambda **kw: sorted((r.q_id, r.vec_id, r.rank) for r in nearest(queries, bank, 4, **kw).collect())
    assert got() == brute(lambda q, b: True)
    assert got(scope="own") == brute(lambda q, b: q[2] == b[2]) and got(scope="others") == brute(lambda q, b: q[2] != b[2])
    assert got(guard="block") == brute(lambda q, b: b[3] < q[3])
    assert got(exclude=spark.createDataFrame([(1,), (2,), (200,)], "vec_id long")) == brute(lambda q, b: b[0] not in (1, 2, 200))
    assert nearest(queries.limit(0), bank, 4).isEmpty()


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, dml.upsert(old, new, ["k"]).collect())) == [(1, "a", False), (2, "c", False), (3, "d", True)]
    assert sorted(map(tuple, dml.upsert(old, new, ["k"], ("v",)).collect())) == [(1, "a", False), (2, "b", False), (3, "d", True)]
    assert sorted(map(tuple, dml.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, dml.replace_rows(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
