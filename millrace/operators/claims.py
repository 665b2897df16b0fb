"""Queues of work: who is next, which runs to look after, what a retry clears, and attempts whose lease ran out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import table, views
from millrace.streaming.leases import abandoned

#: States.
PRE_EVAL_WAITING, VALIDATION_WAITING = ("HIPPIUS_VALIDATED", "PRE_EVAL_RETRYABLE"), ("SUBMITTED", "HIPPIUS_RETRYABLE")
RUN_ACTIVE = ("DISPATCHED", "GENERATING", "SCORING", "VERDICT_READY")


def _head(rows: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    """The first row of each queue by the order, ties by id, nulls last; no task sorts a queue."""
    keys = F.struct(*(x for c in (*order, "id") for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))))
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), keys).alias("r")).where("r IS NOT NULL").select("r.*")


def next_pre_eval(submissions: DataFrame, commits: DataFrame, cap: int, by: Sequence[str] = ()) -> DataFrame:
    """The submission to be pre-evaluated next, in each queue named by `by`: of those that wait, were tried
    fewer than cap times and whose commit has a block's hash, the first by priority, then age.

    submissions: (id, commit_id, state, retry_count, priority, created_at); commits: (commit_id, block_hash).
    """
    ready = commits.where("block_hash IS NOT NULL").select("commit_id", "block_hash")
    waiting = submissions.where(F.col("state").isin(*PRE_EVAL_WAITING) & (F.col("retry_count") < cap))
    return _head(waiting.join(ready, "commit_id"), by, "priority", "created_at")


def next_validation(submissions: DataFrame, commits: DataFrame, miners: DataFrame, now: str, patience: str = "5 minutes", by: Sequence[str] = ()) -> DataFrame:
    """The submission to be validated next, by block, priority and age. One whose owner's key isn't known
    yet waits for it, no longer than `patience`. miners: (hotkey, coldkey); commits: (commit_id, block_number)."""
    waiting = submissions.where(F.col("state").isin(*VALIDATION_WAITING)).join(commits.select("commit_id", "block_number"), "commit_id").join(miners, "hotkey", "left")
    old = F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {patience}")
    return _head(waiting.where(F.col("coldkey").isNotNull() | old), by, "block_number", "priority", "created_at")


def reconcilable(runs: DataFrame, attempts: DataFrame, submissions: DataFrame, hosts: DataFrame, now: str, most: int = 10) -> DataFrame:
    """The `most` oldest runs to look after: under way on a host, their attempt running but its lease over.
    runs: (run_id, remote_id, attempt_id, submission_id, host_id, state, started_at)."""
    live = runs.where(F.col("remote_id").isNotNull() & F.col("state").isin(*RUN_ACTIVE))
    late = attempts.where((F.col("state") == "RUNNING") & (F.col("lease_ends") < F.lit(now).cast("timestamp"))).select("attempt_id")
    evaluated = submissions.where("state = 'EVAL_RUNNING'").select(F.col("id").alias("submission_id"))
    found = live.join(late, "attempt_id").join(evaluated, "submission_id").join(hosts, "host_id")
    return found.orderBy("started_at", "run_id").limit(most)


def reset_for_retry(registrations: DataFrame, commits: DataFrame) -> DataFrame:
    """Registrations whose last attempt failed, open for another one: active from the newest block on, never
    earlier than before, and everything that belonged to the attempt cleared. Without commits the block stays."""
    cleared = ("parent_token", "credential_ends", "model_prefix", "ready_block", "manifest", "digest", "submission_id", "fault")
    newest = commits.agg(F.max("block_number").alias("__newest"))  # one row
    own = registrations.crossJoin(F.broadcast(newest))
    kinds = dict(registrations.dtypes)
    return own.withColumn("activation_block", F.greatest("activation_block", F.coalesce("__newest", "activation_block"))).drop("__newest").withColumns(
        {c: F.lit(None).cast(kinds[c]) for c in cleared if c in kinds})


_QUEUE = """
SELECT o_orderkey AS id, o_custkey AS commit_id, o_custkey AS hotkey, CASE o_orderstatus WHEN 'F' THEN '{a}' WHEN 'O' THEN '{b}' ELSE 'OTHER' END AS state,
    (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS retry_count,
    CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE CAST(substring(o_orderpriority, 1, 1) AS int) END AS priority, o_orderdate AS created_at,
    CAST(month(o_orderdate) AS int) AS queue FROM orders"""
_COMMITS = "SELECT c_custkey AS commit_id, c_custkey * 7 % 1001 AS block_number, CASE WHEN c_acctbal < 2000 THEN NULL ELSE c_name END AS block_hash FROM customer"
_MINERS = "SELECT c_custkey AS hotkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS coldkey FROM customer"


@query(f"""
WITH s AS ({_QUEUE.format(a=PRE_EVAL_WAITING[0], b=PRE_EVAL_WAITING[1])}), c AS ({_COMMITS})
SELECT queue, id, priority, retry_count, block_hash FROM s JOIN c USING (commit_id) WHERE state <> 'OTHER' AND retry_count < 2 AND block_hash IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY queue ORDER BY priority NULLS LAST, created_at, id) = 1""")
def pre_eval_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA29: the head of each month's queue of orders."""
    views(spark, sf_dir, "orders", "lineitem", "customer")
    got = next_pre_eval(spark.sql(_QUEUE.format(a=PRE_EVAL_WAITING[0], b=PRE_EVAL_WAITING[1])), spark.sql(_COMMITS), 2, ["queue"])
    return got.select("queue", "id", "priority", "retry_count", "block_hash")


@query(f"""
WITH s AS ({_QUEUE.format(a=VALIDATION_WAITING[0], b=VALIDATION_WAITING[1])}), c AS ({_COMMITS}), m AS ({_MINERS})
SELECT queue, id, block_number, coldkey FROM s JOIN c USING (commit_id) LEFT JOIN m USING (hotkey)
WHERE state <> 'OTHER' AND (coldkey IS NOT NULL OR created_at < TIMESTAMP '1995-06-15 00:00:00' - INTERVAL 5 MINUTE)
QUALIFY row_number() OVER (PARTITION BY queue ORDER BY block_number NULLS LAST, priority NULLS LAST, created_at, id) = 1""")
def validation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA31: the head of each month's queue, by block; owners without a key wait."""
    views(spark, sf_dir, "orders", "lineitem", "customer")
    queue = spark.sql(_QUEUE.format(a=VALIDATION_WAITING[0], b=VALIDATION_WAITING[1]))
    return next_validation(queue, spark.sql(_COMMITS), spark.sql(_MINERS), "1995-06-15", by=["queue"]).select("queue", "id", "block_number", "coldkey")


_RUNS = """
SELECT l_orderkey * 10 + l_linenumber AS run_id, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_partkey END AS remote_id, l_orderkey AS submission_id, l_orderkey * 10 + l_linenumber AS attempt_id, l_suppkey AS host_id,
    CASE l_linenumber WHEN 1 THEN 'DISPATCHED' WHEN 2 THEN 'GENERATING' WHEN 3 THEN 'SCORING' WHEN 4 THEN 'VERDICT_READY' ELSE 'SUCCEEDED' END AS state, l_shipdate AS started_at FROM lineitem"""
_ATTEMPTS = "SELECT l_orderkey * 10 + l_linenumber AS attempt_id, CASE l_returnflag WHEN 'A' THEN 'ABANDONED' ELSE 'RUNNING' END AS state, {ends} AS lease_ends FROM lineitem"
_EVALUATED = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'EVAL_RUNNING' ELSE 'EVAL_DONE' END AS state FROM orders"


@query(f"""
WITH r AS ({_RUNS}), a AS ({_ATTEMPTS.format(ends="l_shipdate + to_days(CAST(l_quantity AS int))")}), s AS ({_EVALUATED})
SELECT run_id, host_id, s_name AS host FROM r JOIN a USING (attempt_id) JOIN s ON s.id = r.submission_id JOIN supplier ON s_suppkey = host_id
WHERE remote_id IS NOT NULL AND r.state <> 'SUCCEEDED' AND a.state = 'RUNNING' AND lease_ends < TIMESTAMP '1998-01-01' AND s.state = 'EVAL_RUNNING' ORDER BY started_at, run_id LIMIT 25""")
def reconcilable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA35: the oldest runs whose lease is over."""
    views(spark, sf_dir, "orders", "lineitem")
    attempts = spark.sql(_ATTEMPTS.format(ends="l_shipdate + make_dt_interval(CAST(l_quantity AS int))"))
    hosts = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS host_id", "s_name AS host")
    return reconcilable(spark.sql(_RUNS), attempts, spark.sql(_EVALUATED), hosts, "1998-01-01", 25).select("run_id", "host_id", "host")


@query(f"""
WITH c AS ({_COMMITS})
SELECT o_orderkey AS id, greatest(o_custkey * 3, (SELECT max(block_number) FROM c)) AS activation_block, CAST(NULL AS varchar) AS model_prefix, CAST(NULL AS bigint) AS submission_id, o_orderpriority AS owner FROM orders""")
def retries_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY DM12: orders as registrations, cleared for another attempt."""
    views(spark, sf_dir, "orders", "customer")
    rows = spark.sql("SELECT o_orderkey AS id, o_custkey * 3 AS activation_block, o_orderstatus AS model_prefix, o_custkey AS submission_id, o_orderpriority AS owner FROM orders")
    return reset_for_retry(rows, spark.sql(_COMMITS))


_LEASED = """
SELECT CAST(user_id AS {text}) AS item, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS attempt,
    CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'done' ELSE 'beat' END AS kind, ts AS {at}, CASE WHEN event_type = 'error' THEN NULL ELSE round(value * 1800, 2) END AS lease FROM events"""


@query(f"""
WITH e AS (SELECT * FROM ({_LEASED.format(text='varchar', at='moment')}) WHERE attempt > 0 AND (kind = 'done' OR lease IS NOT NULL)),
n AS (SELECT *, lead(moment) OVER (PARTITION BY item, attempt ORDER BY moment) AS next, moment + to_microseconds(CAST(round(lease * 1000000) AS bigint)) AS ends FROM e),
x AS (SELECT item, attempt, min(CASE WHEN kind = 'done' THEN moment END) AS done, min(CASE WHEN kind <> 'done' AND (next IS NULL OR next > ends) THEN ends END) AS abandoned_at FROM n GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY abandoned_at, attempt) AS k FROM x WHERE abandoned_at < TIMESTAMP '2024-02-01' AND (done IS NULL OR done > abandoned_at))
SELECT item, attempt, epoch_us(abandoned_at) AS abandoned_at, CAST(k AS int) AS retries, CASE WHEN k >= 3 THEN 'TERMINAL' ELSE 'RETRYABLE' END AS state FROM l""")
def leases_abandoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY ST06, ST07, ST08: each account's sign-ups as attempts, its other events as beats that buy time, a purchase as the end."""
    table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).createOrReplaceTempView("events")
    return abandoned(spark.sql(_LEASED.format(text="string", at="at")), "2024-02-01").withColumn("abandoned_at", F.unix_micros("abandoned_at"))
