"""Imports, row groups, requests and answers, linkage: each against a plain version."""

from __future__ import annotations

import ast
import random
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions.linear import average_linkage
from millrace.operators import imports as I
from millrace.sources import row_groups as G
from millrace.streaming import requests as Q


def test_module_names():
    code = "import a, b.c as d\nfrom e.f import g, h as i\nfrom . import j\nfrom .k import l\ndef m():\n    import n\nfrom e.f import g"
    assert I.module_names(code) == ["a", "b.c", "e.f", "e.f.g", "e.f.h", "n"] and I.module_names("import (") == [] and I.module_names("x = '\x00'") == []


FILES = {
    "main.py": "import util\nfrom pkg import deep", "util.py": "import third\nimport util", "src/pkg/__init__.py": "", "src/pkg/deep.py": "import side\nimport util", "src/pkg/side.py": "import last",
    "third.py": "import fourth", "fourth.py": "", "src/pkg/last.py": "", "broken.py": "import (",
}


def plain_imports(code, folder, levels):
    found, now = {}, [(code, folder)]
    for level in range(1, levels + 1):
        following = []
        for text, where in now:
            for name in I.module_names(text):
                for root in ("", "src", where):
                    for end in (".py", "/__init__.py"):
                        path = (root + "/" if root else "") + name.replace(".", "/") + end
                        if path in FILES and path not in found:
                            found[path] = level
                            following.append((FILES[path], path.rpartition("/")[0]))
        now = following
    return found


def test_imports_two_levels_deep(spark):
    files = spark.createDataFrame([("t", p, c) for p, c in FILES.items()] + [("other", "util.py", "import main")], "tree string, path string, text string")
    codes = {1: (FILES["main.py"], ""), 2: ("import util\nimport third", "src/pkg"), 3: ("import side", "src/pkg"), 4: (None, ""), 5: ("import broken, fourth", None)}
    sources = spark.createDataFrame([(i, "t", c, f) for i, (c, f) in codes.items()] + [(9, "other", "import util, main", "")], "id int, tree string, code string, folder string")
    for levels in (1, 2, 3):
        got = {(r.id, r.path): r.level for r in I.imported_files(sources, files, levels).collect()}
        want = {(i, p): n for i, (c, f) in codes.items() for p, n in plain_imports(c or "", f or "", levels).items()}
        assert got == want | {(9, "util.py"): 1}
    assert ast.parse(FILES["main.py"])


def rows_of_joins(plan) -> int:
    """Rows that the joins of a plan put out, as it ran."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return rows_of_joins(plan.executedPlan())
    below = [plan.plan()] if "QueryStage" in plan.getClass().getSimpleName() else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return own + sum(map(rows_of_joins, below))


def test_files_and_sources_of_one_path_are_followed_together(spark, monkeypatch):
    monkeypatch.setattr(I, "PART", 7, raising=False)  # parts of hot keys
    many = [("t", "hub.py", f"import leaf{i % 5}, leaf{i % 7}\nx = {i}") for i in range(300)]
    files = spark.createDataFrame([*many, *(("t", f"leaf{i}.py", "import hub, leaf6") for i in range(7))], "tree string, path string, text string")
    sources = spark.createDataFrame([(i, "t", "import hub" if i % 3 else "import leaf1", "") for i in range(200)], "id int, tree string, code string, folder string")
    got = I.imported_files(sources, files)
    rows = {(r.id, r.path): r.level for r in got.collect()}
    hub = {"hub.py": 1} | {f"leaf{i}.py": 2 for i in range(7)}
    assert rows == {(i, p): n for i in range(200) for p, n in (hub if i % 3 else {"leaf1.py": 1, "hub.py": 2, "leaf6.py": 2}).items()}
    assert rows_of_joins(got._jdf.queryExecution().executedPlan()) < 10_000


@pytest.fixture
def keyed(spark, tmp_path):
    made = {}
    for k in range(3):
        table = pa.table({"key": [f"k{v:04d}" for v in range(k * 100, k * 100 + 100)], "number": list(range(k * 100, k * 100 + 100)), "text": ["x" * 50] * 100})
        pq.write_table(table, tmp_path / f"{k}.parquet", row_group_size=10)
        made[f"{tmp_path}/{k}.parquet"] = table
    return made, spark.createDataFrame([(f,) for f in made], "file string").repartition(3)


@pytest.mark.parametrize(("key", "whole", "wanted"), [("key", False, ["k0005", "k0123", "k0299", "nowhere", None, "k0005"]), ("number", True, [5, 123, 299, -1, None, 5])])
def test_only_row_groups_that_may_hold_a_key_are_read(spark, keyed, monkeypatch, key, whole, wanted):
    made, files = keyed
    index = G.row_group_index(files, key)
    assert index.count() == 30 and index.agg(F.sum("n_rows")).first()[0] == 300
    keys = spark.createDataFrame([(w,) for w in wanted], f"{key} {'bigint' if whole else 'string'}")
    got = G.rows_of_keys(index, keys, key, "key string, number bigint", whole)
    assert got.columns == ["key", "number", "file", "row"]
    assert sorted((r.number, r.row, r.file[-9:]) for r in got.collect()) == [(5, 5, "0.parquet"), (123, 23, "1.parquet"), (299, 99, "2.parquet")]
    assert index.where(" OR ".join(f"'{w}' BETWEEN low AND high" for w in wanted[:3])).count() == 3 or whole


def test_one_row_by_place(spark, keyed):
    made, files = keyed
    index = G.row_group_index(files, "key")
    file = sorted(made)[1]
    assert G.row_at(spark, index, file, 37, "key string, number bigint").to_dict("list") == {"key": ["k0137"], "number": [137]}
    for row in (-1, 100):
        with pytest.raises(IndexError):
            G.row_at(spark, index, file, row, "key string")


ZERO = datetime(2024, 1, 1)


def test_requests_and_answers(spark, tmp_path):
    rng = random.Random(2)
    asked = [(f"r{i}", ZERO + timedelta(seconds=10 * i), f"q{i}") for i in range(60)]
    told = []
    for i, (key, at, _) in enumerate(asked):
        if i % 3:
            told.append((key, at + timedelta(seconds=[20, 30, 31, -5][i % 4]), f"a{i}"))
    asked, told = asked + [asked[5]] + [("end", ZERO + timedelta(hours=3), "z")], told + [told[1], ("nobody", ZERO, "x"), (None, ZERO, "y"), ("end", ZERO + timedelta(hours=3), "last")]
    want = {k: (q, None) for k, _, q in asked}
    for key, at, a in told:
        when = next((t for k, t, _ in asked if k == key), None)
        if when is not None and timedelta(0) <= at - when <= timedelta(seconds=30):
            want[key] = (want[key][0], a)
    kinds = {"ask": "id string, asked_at timestamp, request string", "tell": "id string, answered_at timestamp, answer string"}
    for name, rows in (("ask", asked), ("tell", told)):
        rows = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randint(0, 40)))
        for k in range(3):
            spark.createDataFrame(rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3], kinds[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
    streams = [spark.readStream.schema(kinds[n]).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{n}") for n in kinds]
    out = Q.correlated(*streams, "30 seconds", "10 minutes")
    query = out.writeStream.format("memory").queryName("correlated").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = [(r.id, (r.request, r.answer)) for r in spark.table("correlated").collect()]
    assert len(got) == len(dict(got)) and dict(got) == want
    assert sum(a is None for _, a in want.values()) > 20 and any(a for _, a in want.values())


def test_calls_of_a_key_fly_once(spark, tmp_path):
    rows = [("a", ZERO, 1), ("b", ZERO, 2), ("a", ZERO + timedelta(seconds=5), 3), (None, ZERO, 4)]
    spark.createDataFrame(rows, "key string, at timestamp, n int").coalesce(1).write.parquet(f"{tmp_path}/in")
    calls = Q.single_flight(spark.readStream.schema("key string, at timestamp, n int").parquet(f"{tmp_path}/in"))
    calls.writeStream.format("memory").queryName("flights").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.key for r in spark.table("flights").collect()) == ["a", "b"]


def plain_linkage(vectors, cut):
    """All pairs of clusters looked at in every round."""
    x = np.asarray(vectors, float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    cosine = (x / np.where(norm == 0, 1, norm)) @ (x / np.where(norm == 0, 1, norm)).T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = max((float(cosine[np.ix_(a, b)].mean()), i, j) for (i, a), (j, b) in combinations(enumerate(groups), 2))
        if best[0] < cut:
            break
        groups[best[1]] += groups.pop(best[2])
    out = {i: k for k, g in enumerate(sorted(groups, key=min)) for i in g}
    return [out[i] for i in range(len(x))]


def test_linkage_equals_looking_at_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n, d = int(rng.integers(0, 25)), int(rng.integers(1, 5))
        x = rng.standard_normal((n, d))
        cut = float(rng.choice([0.55, 0.2, 0.9]))
        assert average_linkage(x.tolist(), cut) == (plain_linkage(x, cut) if n else [])
    for x in ([[1, 0]] * 6, [[0, 0], [1, 0], [1, 0], [0, 1], [0, 1]], [[1.0], [2.0], [-1.0]]):
        assert average_linkage(x, 0.55) == plain_linkage(x, 0.55)


def test_linkage_of_many(spark):
    x = np.random.default_rng(0).standard_normal((1500, 8))
    labels = average_linkage(x.tolist(), 0.55)
    assert len(labels) == 1500 and isinstance(pd.Series(labels).nunique(), int)
