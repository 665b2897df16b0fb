"""Window operators: numbering, latest rows, runs, deltas, ranks, splits, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.positions import positions
from millrace.operators.sqltools import sql_query
from millrace.plans.registry import query
from millrace.session import table

sql_query("regnal_row_number", "orders", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS reign,
  sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS crowned
FROM orders""", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS reign,
  CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS bigint) AS crowned
FROM orders""", doc="Numbers from 0, and a counter that skips one state.")

sql_query("distinct_on_latest", "orders", """
SELECT o_custkey, last.o_orderkey AS o_orderkey, last.o_orderstatus AS o_orderstatus FROM (
  SELECT o_custkey, max_by(struct(o_orderkey, o_orderstatus), struct(o_orderdate, o_orderkey)) AS last FROM orders GROUP BY o_custkey)""", """
SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC""", doc="Latest row of each key as an aggregation with partial maxima.")

_ISLANDS = """
WITH marked AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
island AS (SELECT user_id, event_type, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM marked),
runs AS (SELECT user_id, event_type, g, count(*) AS n FROM island GROUP BY 1, 2, 3)
"""
sql_query("loop_islands", "events", _ISLANDS + """
SELECT user_id, sum(n) AS n_cmds, max(n) AS max_run, round(1 - count(DISTINCT event_type) / sum(n), 6) AS dup_ratio,
  (1 - count(DISTINCT event_type) / sum(n) >= 0.61 OR max(n) >= 5) AS looped FROM runs GROUP BY user_id""", _ISLANDS + """
SELECT user_id, CAST(sum(n) AS bigint) AS n_cmds, max(n) AS max_run, round(1 - count(DISTINCT event_type) / sum(n), 6) AS dup_ratio,
  (1 - count(DISTINCT event_type) / sum(n) >= 0.61 OR max(n) >= 5) AS looped FROM runs GROUP BY user_id""", doc="Longest run of equal values and the loop verdict.")

sql_query("longest_run_per_value", "events", _ISLANDS + "SELECT user_id, event_type, max(n) AS longest, sum(n) AS count_all FROM runs GROUP BY 1, 2", _ISLANDS + "SELECT user_id, event_type, max(n) AS longest, CAST(sum(n) AS bigint) AS count_all FROM runs GROUP BY 1, 2")

sql_query("looping_commands_top5", "events", _ISLANDS + """
SELECT user_id, event_type, longest, count_all, rk FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY longest DESC, count_all DESC, event_type) AS rk FROM (
    SELECT user_id, event_type, max(n) AS longest, sum(n) AS count_all FROM runs GROUP BY 1, 2) WHERE count_all >= 2 OR longest >= 5) WHERE rk <= 5""", _ISLANDS + """
SELECT user_id, event_type, longest, count_all, rk FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY longest DESC, count_all DESC, event_type) AS rk FROM (
    SELECT user_id, event_type, max(n) AS longest, CAST(sum(n) AS bigint) AS count_all FROM runs GROUP BY 1, 2) WHERE count_all >= 2 OR longest >= 5) WHERE rk <= 5""", doc="Looping commands by run, count and name; five of each are the report.")

sql_query("row_meta_running_chars", "conversations", """
SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chars_at,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars_pre,
  sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asst FROM conversations""", """
SELECT conv_id, turn, role, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bigint) AS chars_at,
  CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS chars_pre,
  CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bigint) AS asst FROM conversations""", doc="Running characters and assistant turns.")

sql_query("baseline_delta", "lineitem", """
WITH s AS (SELECT l_suppkey, l_returnflag AS suite, avg(l_discount) AS score, count(*) AS passes, max(l_shipdate) AS latest FROM lineitem GROUP BY 1, 2),
base AS (SELECT suite, score FROM s WHERE l_suppkey = 1)
SELECT s.l_suppkey, s.suite, passes, round(s.score - base.score, 6) AS delta,
  round(s.score - last_value(s.score) IGNORE NULLS OVER (PARTITION BY s.suite ORDER BY s.l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS versus_previous
FROM s JOIN base ON s.suite = base.suite""", """
WITH s AS (SELECT l_suppkey, l_returnflag AS suite, avg(l_discount) AS score, count(*) AS passes, max(l_shipdate) AS latest FROM lineitem GROUP BY 1, 2),
base AS (SELECT suite, score FROM s WHERE l_suppkey = 1)
SELECT s.l_suppkey, s.suite, passes, round(s.score - base.score, 6) AS delta,
  round(s.score - last_value(s.score IGNORE NULLS) OVER (PARTITION BY s.suite ORDER BY s.l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS versus_previous
FROM s JOIN base ON s.suite = base.suite""", doc="Deltas to a baseline and to the entry before.")

sql_query("reign_plan", "customer", """
SELECT c_nationkey, c_custkey, slot, floor(10000 / n) + CASE WHEN slot <= 10000 % n THEN 1 ELSE 0 END AS bps FROM (
  SELECT c_nationkey, c_custkey, slot, least(5, count(*) OVER (PARTITION BY c_nationkey)) AS n FROM (
    SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS slot FROM customer)) WHERE slot <= 5""", """
SELECT c_nationkey, c_custkey, slot, CAST(floor(10000 / n) + CASE WHEN slot <= 10000 % n THEN 1 ELSE 0 END AS bigint) AS bps FROM (
  SELECT c_nationkey, c_custkey, slot, least(5, count(*) OVER (PARTITION BY c_nationkey)) AS n FROM (
    SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS slot FROM customer)) WHERE slot <= 5""", doc="Five slots per realm, 10,000 basis points split evenly, the remainder to the first.")

sql_query("approach_windows", "events", """
WITH landed AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, step, coalesce(lag(step) OVER (PARTITION BY user_id ORDER BY step), greatest(step - 5, 0)) AS from_step FROM landed WHERE event_type = 'purchase'""", doc="Steps since the milestone before, four back for the first.")

@query("SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 2 = 0 THEN 12 ELSE 16 END AS horizon FROM documents")
def horizon_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY WN13: alternating horizons within a phase; phases are few and large, so places come from counts by range."""
    placed = positions(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return placed.select("doc_id", F.when(F.col("position") % 2 == 0, 12).otherwise(16).alias("horizon"))


sql_query("renumber_cap_topup", "lineitem", """
SELECT l_orderkey, l_linenumber, concat('q_', lpad(cast(rn AS string), 2, '0')) AS qid, rn FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END, l_linenumber) AS rn,
    sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS kept FROM lineitem) WHERE rn <= least(6, greatest(kept, 2))""", """
SELECT l_orderkey, l_linenumber, concat('q_', lpad(rn::varchar, 2, '0')) AS qid, rn FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END, l_linenumber) AS rn,
    sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS kept FROM lineitem) WHERE rn <= least(6, greatest(kept, 2))""", doc="Contiguous numbers per group, at most six, at least two topped up from the spare ones.")

sql_query("host_choice_nulls_first", "supplier", """
SELECT s_nationkey, max_by(s_suppkey, struct(free IS NULL, free, s_suppkey)) AS host FROM (SELECT *, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS free FROM supplier) x GROUP BY s_nationkey""", """
SELECT s_nationkey, s_suppkey AS host FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END DESC NULLS FIRST, s_suppkey DESC) AS k FROM supplier) WHERE k = 1""", doc="SURVEY SL04: the host with the most free, unknown counts first as the original's DESC has them; every seventh is unknown here.")

sql_query("ranked_merge_topn", "orders", """
SELECT * FROM (SELECT o_orderkey, o_orderdate, 'run' AS kind FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25)
UNION ALL SELECT o_orderkey, o_orderdate, 'upload' FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25))
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25""", doc="Failure feed: two ranked lists merged, the newest 25 are the report.")

sql_query("model_sort_keys", "supplier", """
SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey = 1 THEN 1 ELSE 0 END, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END DESC, s_name, s_suppkey) AS place FROM supplier""", doc="Baseline last, champions first, then by name.")

sql_query("live_candidates", "orders", """
SELECT o_custkey, o_orderkey, rk FROM (
  SELECT o.o_custkey, o_orderkey, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rk FROM orders o
  JOIN (SELECT o_custkey, max(o_orderdate) AS scored FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) s ON s.o_custkey = o.o_custkey AND o.o_orderdate > s.scored) WHERE rk <= 6""", doc="Runs newer than the newest scored one, six of each.")
