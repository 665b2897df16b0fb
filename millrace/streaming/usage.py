"""Streaming twins of the usage and event operators, on Structured Streaming.

Each takes a streaming DataFrame of events (event_id, ts TIMESTAMP, user_id, event_type, value) and
gives one; with availableNow triggers each equals its batch form over the same events.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events from Parquet files as they arrive."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def usage_rollup(events: DataFrame, window: str = "4 hours", late: str = "3 days") -> DataFrame:
    """Closed windows by service; events up to `late` behind still count, later ones don't."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("bucket"), F.col("event_type").alias("service"), "n", "total")
    )


def delivered_once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without repeated deliveries inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_state(events: DataFrame) -> DataFrame:
    """State of each run, with counters that only grow."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"), F.max("value").alias("progress"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


def lease_sessions(events: DataFrame, lease: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Heartbeats of a holder that are less than a lease apart; a session's end is the lease's expiry."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", lease).alias("s"), "user_id").agg(F.count("*").alias("beats")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("expires"), "beats")


def rate_limited(events: DataFrame, seconds: int = 60, most: int = 5, late: str = "1 day") -> DataFrame:
    """Whether each event exceeds `most` in the last `seconds` of its account.

    The state holds an account's times of the last `seconds` before the watermark and later, so events that come late or out of
    order across batches still count for those after them; an account without events since is dropped when the watermark passes.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        span = seconds * 10**9
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        new = rows["ts"].astype("datetime64[ns]").astype("int64").to_numpy()
        times = np.sort(np.concatenate((np.array(state.get[0], np.int64) if state.exists else np.zeros(0, np.int64), new)))
        # of equal times, those up to the event itself, as a window over rows in order counts them
        nth = pd.Series(new).groupby(new).cumcount().to_numpy() + 1
        n = np.searchsorted(times, new, "left") - np.searchsorted(times, new - span, "left") + nth
        kept = times[times >= max(state.getCurrentWatermarkMs() * 10**6, 0) - span]
        state.update((kept.tolist(),))
        state.setTimeoutTimestamp(int(max(kept.max() if len(kept) else 0, times.max()) // 10**6 + seconds * 1000 + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "n": n, "limited": n > most})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(run, "event_id bigint, n bigint, limited boolean", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def kept_for(events: DataFrame, hours: int = 4, late: str = "1 hour") -> DataFrame:
    """Entries of a key that were put and never taken within `hours`: one row when the watermark passes their end.

    Events of type `put` start an entry or renew it, those of type `take` end it; the state is one time of each open key.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at = state.get[0]
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "put_at": [pd.Timestamp(at, unit="ms", tz="UTC")]})
            return
        last = pd.concat(list(batches)).sort_values(["ts", "event_id"]).iloc[-1]
        if last["event_type"] == "put":
            at = int(last["ts"].timestamp() * 1000)
            state.update((at,))
            state.setTimeoutTimestamp(max(at + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(run, "user_id bigint, put_at timestamp", "at bigint", "append", GroupStateTimeout.EventTimeTimeout)


def live_rate(readings: DataFrame) -> DataFrame:
    """Growth a second of each counter between its first and newest reading (user_id, ts, value), null with one."""
    at = lambda pick, c: pick(c, F.struct("ts", "event_id"))
    ends = readings.groupBy("user_id").agg(*(at(f, c).alias(f"{n}_{c}") for f, n in ((F.min_by, "a"), (F.max_by, "z")) for c in ("ts", "value")))
    seconds = F.unix_micros("z_ts") - F.unix_micros("a_ts")
    return ends.select("user_id", F.when(seconds > 0, (F.col("z_value") - F.col("a_value")) * 1_000_000 / seconds).alias("rate"))


def newest_entries(entries: DataFrame, most: int = 8192) -> DataFrame:
    """What a memo of `most` entries with first-in-first-out eviction still holds of entries (key, at): the first time of a key counts."""
    return entries.groupBy("key").agg(F.min("at").alias("at")).orderBy(F.desc("at"), F.desc("key")).limit(most)


def followed(start: Callable[[], StreamingQuery], errors: int = 5, wait: float = 0.0) -> int:
    """Run a checkpointed query until it ends, restarting it after a failure, at most `errors` in a row without progress.

    The checkpoint holds the offset, so a restart neither loses events nor hands them on twice to an idempotent sink. Returns the number of restarts.
    """
    failed = restarts = 0
    seen = -1
    while True:
        query = start()
        try:
            query.awaitTermination()
            return restarts
        except StreamingQueryException:
            done = query.lastProgress["batchId"] if query.lastProgress else -1
            failed = 1 if done > seen else failed + 1
            seen = max(seen, done)
            if failed > errors:
                raise
            restarts += 1
            time.sleep(wait)


def ingest(target: str, key: str, fallback: Callable[[], DataFrame], stalled: Callable[[], bool]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows of keys not processed before, one folder of each epoch, and takes the rows of `fallback` where the source has stalled."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.unionByName(fallback()) if stalled() else batch
        rows = rows.dropDuplicates([key])
        if epoch:
            done = spark.read.schema(rows.schema).parquet(*(f"{target}/epoch={e}" for e in range(epoch))) if epoch < 1000 else spark.read.parquet(target).where(F.col("epoch") < epoch).drop("epoch")
            rows = rows.join(done.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return write


def completed_pairs(left: DataFrame, right: DataFrame, within: str = "1 day") -> DataFrame:
    """Pairs of one key as soon as both sides have arrived: a stream-stream join with bounded state."""
    a = left.withWatermark("ts", within).select("event_id", F.col("ts").alias("a_ts"), F.col("value").alias("a_value"))
    b = right.withWatermark("ts", within).select(F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"), F.col("value").alias("b_value"))
    span = F.expr(f"b_ts BETWEEN a_ts - INTERVAL {within} AND a_ts + INTERVAL {within}")
    return a.join(b, (F.col("event_id") == F.col("b_id")) & span).select("event_id", "a_value", "b_value")


def upsert_sink(target: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that replaces rows of `target` by key.

    The target is partitioned by a hash of the keys; a batch reads and rewrites only the buckets its keys fall in. Writing an epoch
    again after a retry changes nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if touched and folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            old = spark.read.schema(new.schema).parquet(target).where(F.col("bucket").isin(touched))
            new = old.join(new.select(*keys), keys, "left_anti").unionByName(new)
        new.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(target)

    return write
