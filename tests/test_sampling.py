"""Sampling against plain scans of the whole pool."""

from __future__ import annotations

import hashlib
from collections import Counter
from types import SimpleNamespace

import pytest

from millrace.operators import sampling


def shares(spark, *names_and_weights):
    return spark.createDataFrame(list(names_and_weights), "name string, weight int")


def rows(spark, *names_and_weights):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(names_and_weights)], "place int, name string, weight int")


def test_places(spark):
    got = {r.name: r.want for r in sampling.places(shares(spark, ("a", 1), ("b", 1), ("c", 1)), 10).collect()}
    assert got == {"a": 4, "b": 3, "c": 3}


def test_both_margins_of_a_grid_are_exact(spark):
    a, b = rows(spark, ("x", 35), ("y", 33), ("z", 32)), shares(spark, ("p", 61), ("q", 20), ("r", 19))
    for count in (1, 7, 20, 100):
        cells = sampling.grid(a, b, count).collect()
        for side, plan in (("row", sampling.places(a, count)), ("name", sampling.places(b, count))):
            sums = Counter()
            for c in cells:
                sums[c[side]] += c.want
            assert {k: v for k, v in sums.items() if v} == {r.name: r.want for r in plan.collect() if r.want}


def md5(*x):
    return hashlib.md5(":".join(map(str, x)).encode()).hexdigest()


def scan(pool, wanted, seed, total):
    """The draw by one scan of the whole order for each stratum."""
    best = {}
    for r in pool:
        h = (md5(seed, r.instance, r.id), r.id)
        if r.instance not in best or h < best[r.instance][0]:
            best[r.instance] = (h, r)
    order = sorted((r for _, r in best.values()), key=lambda r: (md5(seed, r.id), r.id))
    out, used, repos, foreign = [], set(), Counter(), 0
    for w in sorted(wanted, key=lambda w: w.stratum):
        got = 0
        for r in order:
            if w.phase == "cold":
                size, turn = 0, int(md5(seed, r.id)[-1], 16) % 2 + 1
            else:
                size = r.chars_at if w.phase == "at_edit" else r.chars_pre
                turn = 1 if r.first_edit <= 0 else max(1, r.first_edit - 2) if w.phase == "pre_edit" else r.first_edit
            other = r.language != "python"
            fits = r.family == w.family and size <= sampling.MAX_PREFIX and r.turns > turn
            if got < w.want and fits and r.id not in used and repos[r.repo] < sampling.REPO_CAP and (not other or foreign < (total * 30 + 50) // 100):
                got += 1
                used.add(r.id)
                repos[r.repo] += 1
                foreign += other
                out.append((r.id, turn))
        if got < w.want:
            return None
    return out


@pytest.mark.parametrize("seed", ["block:1", "block:2", "x"])
@pytest.mark.parametrize("count", [12, 60])
def test_draw_equals_a_scan_of_the_whole_pool(spark, sf, seed, count):
    phases, families = rows(spark, ("cold", 50), ("pre_edit", 30), ("at_edit", 20)), shares(spark, ("pr", 40), ("lm", 40), ("mechanical", 20))
    pool = sampling.document_pool(spark, sf)
    cells = sorted(sampling.grid(phases, families, count).collect(), key=lambda r: (r.place, r.name))
    wanted = [SimpleNamespace(phase=c["row"], family=c["name"], want=c.want, stratum=i) for i, c in enumerate(cells)]
    want = scan(pool.collect(), wanted, seed, count)
    if want is None:
        with pytest.raises(ValueError, match="can't be filled"):
            sampling.sample(pool, phases, families, count, seed)
    else:
        assert [(r.id, r.turn) for r in sampling.sample(pool, phases, families, count, seed)] == want


def test_limits_of_a_draw(spark):
    kinds = "id string, instance string, family string, repo string, language string, turns int, first_edit int, chars_at int, chars_pre int"
    pool = spark.createDataFrame([(str(i), f"i{i}", "pr", f"r{i % 3}", "python" if i % 2 else "go", 9, 3, 1, 1) for i in range(30)], kinds)
    cold, pr = rows(spark, ("cold", 1)), shares(spark, ("pr", 1))
    got = sampling.sample(pool, cold, pr, 5, "s")
    assert len({r.id for r in got}) == 5 and max(Counter(r.repo for r in got).values()) <= 2 and sum(r.language == "go" for r in got) <= 2
    with pytest.raises(ValueError):  # three repositories give at most six
        sampling.sample(pool, cold, pr, 7, "s")
    with pytest.raises(ValueError):  # too long before every turn
        sampling.sample(pool.selectExpr("*").withColumn("chars_pre", sampling.F.lit(60_000)), rows(spark, ("pre_edit", 1)), pr, 1, "s")


def test_share_kept_on_few_rows(spark):
    for n in (0, 1, 3, 7, 50):
        got = sampling.kept_original(spark.range(n).withColumnRenamed("id", "k"), "k", 15, "s").collect()
        assert len(got) == n and sum(r.kept for r in got) == (n * 15 + 50) // 100
