"""Leases on attempts: claims, heartbeats and ends, and what is abandoned when a lease runs out.

Events are (item, attempt, kind, at, lease): kind is claim, beat or done, lease the seconds that a claim or beat
buys. A lease that runs out before the attempt's next beat or end abandons the attempt at that moment; later
events of it count for nothing. An item's attempts are tried again until `cap` of them were abandoned. The
same rule stands twice: as a batch over all events (`abandoned`), and as a stream with timers (`Leases`), which
gives the same rows whatever the order of arrival within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CAP = 3
OUT = "item string, attempt bigint, abandoned_at timestamp, retries int, state string"


def abandoned(events: DataFrame, until: str | datetime, cap: int = CAP) -> DataFrame:
    """(item, attempt, abandoned_at, retries, state) of every attempt whose lease ran out before `until` (SURVEY ST06,
    ST07, ST08): retries counts the item's abandoned attempts up to it, state is RETRYABLE, or TERMINAL from the
    cap-th on.

    Repeated events count once; of equal times an end comes first, then beats. Events of an attempt that was never
    claimed, or before its claim, count for nothing; null fields make an event void. No events give no rows.
    """
    order = F.when(F.col("kind") == "done", 0).when(F.col("kind") == "claim", 1).otherwise(2)
    known = events.where("item IS NOT NULL AND attempt IS NOT NULL AND at IS NOT NULL AND (kind = 'done' OR lease IS NOT NULL)").dropDuplicates(["item", "attempt", "kind", "at"])
    of = Window.partitionBy("item", "attempt")
    own = known.withColumn("__claimed", F.min(F.when(F.col("kind") == "claim", F.col("at"))).over(of)).where("at >= __claimed")
    own = own.withColumn("__next", F.lead("at").over(of.orderBy("at", order)))
    ends = own.groupBy("item", "attempt").agg(
        F.min(F.when(F.col("kind") == "done", F.col("at"))).alias("done"),
        F.min(F.when((F.col("kind") != "done") & (F.col("__next").isNull() | (F.col("__next") > F.col("at") + F.make_dt_interval(secs=F.col("lease")))), F.col("at") + F.make_dt_interval(secs=F.col("lease")))).alias("abandoned_at"))
    lost = ends.where((F.col("abandoned_at") < F.lit(until).cast("timestamp")) & (F.col("done").isNull() | (F.col("done") > F.col("abandoned_at"))))
    retries = F.row_number().over(Window.partitionBy("item").orderBy("abandoned_at", "attempt"))
    lost = lost.withColumn("retries", retries)
    return lost.select("item", "attempt", "abandoned_at", "retries", F.when(F.col("retries") >= cap, "TERMINAL").otherwise("RETRYABLE").alias("state"))


class Leases(StatefulProcessor):
    """The stream of `abandoned`, for transformWithStateInPandas over events grouped by item, in event time.

    Events wait in a list until the watermark has passed them, then they are read in order; a timer stands at the
    earliest waiting event and at the end of each live lease. An attempt's lease goes with its end; what
    an item keeps is its live leases and a count.
    """

    def __init__(self, cap: int = CAP):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "attempt bigint, kind string, at bigint, lease double")
        self.live = handle.getMapState("live", "attempt bigint", "ends bigint")
        self.closed = handle.getMapState("closed", "attempt bigint", "at bigint")
        self.retries = handle.getValueState("retries", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = []
        for b in rows:
            for attempt, kind, at, lease in zip(b["attempt"], b["kind"], b["at"], b["lease"], strict=True):
                if pd.isna(attempt) or pd.isna(at) or (kind != "done" and pd.isna(lease)):
                    continue
                new.append((int(attempt), kind, int(at.value // 1000), None if pd.isna(lease) else float(lease)))
        if new:
            self.waiting.appendList(new)
            due = {-(-at // 1000) for _, _, at, _ in new}
            for ms in due:
                self.handle.registerTimer(max(ms, passed + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted({r for r in rows if r[2] <= now}, key=lambda r: (r[2], {"done": 0, "claim": 1}.get(r[1], 2)))
        self.waiting.clear()
        later = [r for r in rows if r[2] > now]
        if later:
            self.waiting.put(later)
        out: list[tuple] = []
        for attempt, kind, at, lease in due:
            self._expire(key, at - 1, out)
            ends = self.live.getValue((attempt,)) if self.live.containsKey((attempt,)) else None
            if kind == "done" and ends is not None:
                self.live.removeKey((attempt,))
                self.closed.updateValue((attempt,), (at,))
            elif (kind == "claim" and not self.closed.containsKey((attempt,))) or (kind != "done" and ends is not None):
                self.live.updateValue((attempt,), (at + round(lease * 1e6),))
        self._expire(key, now, out)
        for (ends,) in (self.live.values() if self.live.exists() else []):
            self.handle.registerTimer(-(-ends // 1000) + 1)
        made = [(key[0], a, datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=at), n, "TERMINAL" if n >= self.cap else "RETRYABLE") for a, at, n in out]
        if made:
            frame = pd.DataFrame(made, columns=["item", "attempt", "abandoned_at", "retries", "state"])
            frame["abandoned_at"] = frame["abandoned_at"].dt.tz_localize(None).astype("datetime64[us]")
            yield frame.astype({"retries": "int32"})
        else:
            yield pd.DataFrame()

    def _expire(self, key, until: int, out: list[tuple]) -> None:
        """Abandon every attempt whose lease ended at or before `until`, the earliest first."""
        over = sorted((ends[0], a[0]) for a, ends in (self.live.iterator() if self.live.exists() else []) if ends[0] <= until)
        for ends, attempt in over:
            n = (self.retries.get()[0] if self.retries.exists() else 0) + 1
            self.retries.update((n,))
            self.live.removeKey((attempt,))
            self.closed.updateValue((attempt,), (ends,))
            out.append((attempt, ends, n))

    def close(self) -> None:
        return None


def abandoned_stream(events: DataFrame, late: str = "10 minutes", cap: int = CAP) -> DataFrame:
    """`abandoned` of a stream of events: rows come out when the watermark, `late` behind the newest event, has passed
    the end of their lease. The state store must be RocksDB."""
    timed = events.where("item IS NOT NULL").withWatermark("at", late)
    return timed.groupBy("item").transformWithStateInPandas(Leases(cap), OUT, "append", "EventTime")
