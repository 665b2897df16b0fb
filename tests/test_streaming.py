from __future__ import annotations

from pyspark.sql import functions as F

from millrace.streaming import usage


def drained(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, sf, tmp_path):
    folder = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.parquet(folder)
    return usage.events_stream(spark, folder), spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def test_rollup_equals_batch(spark, sf, tmp_path):
    stream, batch = source(spark, sf, tmp_path)
    got = drained(usage.usage_rollup(stream), "append", tmp_path, "rollup")
    newest = batch.agg(F.max("ts")).first()[0]
    want = batch.groupBy(F.window("ts", "4 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).where(F.col("w.end") <= F.lit(newest) - F.expr("INTERVAL 3 DAYS"))
    assert got.count() == want.count() and got.agg(F.sum("n")).first()[0] == want.agg(F.sum("n")).first()[0]


def test_dedup_and_state(spark, sf, tmp_path):
    stream, batch = source(spark, sf, tmp_path)
    twice = stream.union(stream)
    assert drained(usage.delivered_once(twice), "append", tmp_path, "once").count() == batch.count()
    got = drained(usage.run_state(stream), "complete", tmp_path, "state")
    assert sorted(map(tuple, got.select("user_id", "n").collect())) == sorted((r.user_id, r["count"]) for r in batch.groupBy("user_id").count().collect())


def test_rate_limit_equals_batch(spark, sf, tmp_path):
    from millrace.operators.usage import sql_query  # noqa: F401
    from millrace.plans.registry import QUERIES

    stream, _ = source(spark, sf, tmp_path)
    got = drained(usage.rate_limited(stream), "append", tmp_path, "limits")
    want = QUERIES["rate_limit_60s"](spark, sf)
    assert got.select("event_id", "n").exceptAll(want.select("event_id", "n")).isEmpty() and got.count() == want.count()


def test_entries_expire(spark, tmp_path):
    kinds = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = [(1, "2024-01-01 00:00:00", 1, "put"), (2, "2024-01-01 01:00:00", 2, "put"), (3, "2024-01-01 02:00:00", 2, "take"), (4, "2024-01-02 00:00:00", 3, "put"), (5, "2024-01-03 00:00:00", 4, "take")]
    for i, r in enumerate(rows):
        spark.sql(f"SELECT {r[0]}L AS event_id, TIMESTAMP_NTZ'{r[1]}' AS ts, {r[2]}L AS user_id, '{r[3]}' AS event_type, 0D AS value, '' AS props").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = drained(usage.kept_for(stream), "append", tmp_path, "kept")
    assert sorted(r.user_id for r in got.collect()) == [1, 3]


def test_sinks(spark, tmp_path):
    target = str(tmp_path / "target")
    write = usage.upsert_sink(target, ["k"], 4)
    batch = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    write(batch(*((i, "a") for i in range(20))), 0)
    for _ in range(2):
        write(batch((3, "b"), (30, "b")), 1)
    got = dict(spark.read.parquet(target).select("k", "v").collect())
    assert len(got) == 21 and got[3] == got[30] == "b" and got[4] == "a"
    seen = usage.ingest(str(tmp_path / "ingest"), "k", lambda: batch((9, "z"), (1, "z")), lambda: False)
    seen(batch((1, "a"), (1, "a"), (2, "a")), 0)
    usage.ingest(str(tmp_path / "ingest"), "k", lambda: batch((9, "z"), (1, "z")), lambda: True)(batch((2, "b"), (3, "b")), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "ingest")).select("k", "v").collect())) == [(1, "a"), (2, "a"), (3, "b"), (9, "z")]


def test_rates_and_memo(spark):
    rows = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP'2024-01-01 00:00:00', 1L, 2D), (2L, TIMESTAMP'2024-01-01 00:00:10', 1L, 7D), (3L, TIMESTAMP'2024-01-01 00:00:10', 2L, 7D) AS t(event_id, ts, user_id, value)")
    assert {r.user_id: r.rate for r in usage.live_rate(rows).collect()} == {1: 0.5, 2: None}
    entries = spark.createDataFrame([("a", 1), ("b", 2), ("a", 9), ("c", 3)], "key string, at int")
    assert {r.key for r in usage.newest_entries(entries, 2).collect()} == {"b", "c"}


def test_follow_restarts_at_the_offset(spark, sf, tmp_path):
    stream, batch = source(spark, sf, tmp_path)
    broken = [True, True]

    def sink(rows, epoch):
        if broken:
            broken.pop()
            raise RuntimeError("lost")
        rows.select("event_id").write.mode("overwrite").parquet(str(tmp_path / "out" / f"e={epoch}"))

    start = lambda: stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "follow")).trigger(availableNow=True).start()
    assert usage.followed(start) == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
