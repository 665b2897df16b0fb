"""Leases: the batch and the stream against a plain replay of the events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming import leases as L

ZERO = datetime(2024, 1, 1)
KIND = "item string, attempt bigint, kind string, at timestamp, lease double"


def plain(events, until, cap=3):
    """One event after another, in order, with the clock run up to each."""
    seen, out, count = {}, [], {}
    order = sorted({e for e in events if None not in e[:2] and e[3] is not None and (e[2] == "done" or e[4] is not None)}, key=lambda e: (e[3], {"done": 0, "claim": 1}.get(e[2], 2)))

    def run_to(t):
        for ends, item, attempt in sorted((v, *k) for k, v in seen.items() if v is not None and v < t):
            seen[item, attempt] = None
            count[item] = count.get(item, 0) + 1
            out.append((item, attempt, ends, count[item], "TERMINAL" if count[item] >= cap else "RETRYABLE"))

    for item, attempt, kind, at, lease in order:
        run_to(at)
        k = item, attempt
        if kind == "done" and k in seen:
            seen[k] = None
        elif (kind == "claim" and k not in seen) or (kind != "done" and seen.get(k) is not None):
            seen[k] = at + timedelta(seconds=lease)
    run_to(until)
    return sorted(out)


def made(rng, items=12):
    """Attempts of an item one after another, with beats, ends, gaps, and events that come too late to count."""
    events = []
    for i in range(items):
        t = ZERO + timedelta(seconds=rng.randint(0, 600))
        for a in range(rng.randint(1, 6)):
            events.append((f"i{i}", a, "claim", t, 60.0))
            for _ in range(rng.randint(0, 6)):
                t += timedelta(seconds=rng.choice([20, 40, 59, 60, 61, 90]), microseconds=rng.choice([0, 1, 999]))
                events.append((f"i{i}", a, "beat", t, rng.choice([60.0, 30.5])))
            if rng.random() < 0.5:
                t += timedelta(seconds=rng.choice([10, 59, 70]))
                events.append((f"i{i}", a, "done", t, None))
            t += timedelta(seconds=rng.choice([61, 130]))
    return events + [("i0", 90, "beat", ZERO, 60.0), ("i1", 91, "done", ZERO, None), ("i1", None, "claim", ZERO, 1.0), ("i2", 92, "claim", ZERO, None), (None, 1, "claim", ZERO, 5.0)] + events[:5]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batch_equals_a_plain_replay(spark):
    rng = random.Random(1)
    for _ in range(3):
        events = made(rng)
        end = max(e[3] for e in events) + timedelta(seconds=rng.choice([-200, 0, 500]))
        want = plain([e for e in events if e[3] < end], end)
        frame = spark.createDataFrame(events, KIND).repartition(4)
        assert rows(L.abandoned(frame.where(frame["at"] < end), end)) == want and want
    assert rows(L.abandoned(frame.limit(0), end)) == []


def test_stream_equals_the_batch_out_of_order(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = random.Random(7)
        events = made(rng, 8)
        end = max(e[3] for e in events) + timedelta(days=1)
        events.append(("last", 0, "done", end + timedelta(hours=1), None))
        shuffled = sorted(events, key=lambda e: (e[3] + timedelta(seconds=rng.randint(0, 500)), str(e)))
        source, n = tmp_path / "in", 0
        for k in range(4):
            part = shuffled[k * len(events) // 4 : (k + 1) * len(events) // 4]
            spark.createDataFrame(part, KIND).coalesce(1).write.parquet(f"{source}/{k}")
            n += len(part)
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
        query = L.abandoned_stream(stream, "600 seconds").writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        got = rows(spark.table("leases"))
        assert got == plain(events, end) and len(got) > 5
        assert {r[4] for r in got} == {"TERMINAL", "RETRYABLE"} and n == len(events)
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize(("cap", "states"), [(1, {"TERMINAL"}), (99, {"RETRYABLE"})])
def test_cap(spark, cap, states):
    events = made(random.Random(3))
    got = L.abandoned(spark.createDataFrame(events, KIND), ZERO + timedelta(days=9), cap)
    assert {r.state for r in got.collect()} == states
