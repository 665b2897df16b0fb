"""Scoring and reporting aggregations: weighted means, votes, shares, verdicts, roll-ups, state maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.sqltools import sql_query
from millrace.plans.registry import query
from millrace.session import table

WIN_MARGIN = 0.025


def weighted_rate(score, weight):
    """Mean of the scores that exist, by weight; the plain mean where the weights sum to 0."""
    used = F.when(score.isNotNull(), weight)
    return F.round(F.coalesce(F.sum(score * weight) / F.nullif(F.sum(used), F.lit(0.0)), F.avg(score)), 10)


_RATES = """
WITH s AS (SELECT l_orderkey AS rec, l_suppkey % 4 AS judge, l_linenumber AS q, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END AS v, CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE l_quantity END AS w FROM lineitem),
r AS (SELECT rec, judge, round(coalesce(sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), avg(v)), 10) AS rate FROM s GROUP BY 1, 2)
"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("rec"), (F.col("l_suppkey") % 4).alias("judge"),
        F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("v"), F.when(F.col("l_linestatus") == "O", 0.0).otherwise(F.col("l_quantity")).alias("w"),
    )
    return li.groupBy("rec", "judge").agg(weighted_rate(F.col("v"), F.col("w")).alias("rate"))


@query(_RATES + "SELECT rec, judge, rate FROM r")
def weighted_mean_by_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir)


@query(_RATES + "SELECT rec, round(avg(rate), 8) AS score, count(rate) AS judges FROM r GROUP BY rec")
def response_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the judges that gave a rate."""
    return _rates(spark, sf_dir).groupBy("rec").agg(F.round(F.avg("rate"), 8).alias("score"), F.count("rate").alias("judges"))


@query(_RATES + """
SELECT count(*) AS total, count(rate) AS valid, round(avg(CASE WHEN judge % 2 = 0 THEN rate END), 5) AS king, round(avg(CASE WHEN judge % 2 = 1 THEN rate END), 5) AS challenger,
  CASE WHEN count(rate) / count(*) < 0.8 THEN 'failed' ELSE 'succeeded' END AS state,
  CASE WHEN count(rate) / count(*) >= 0.8 THEN round(avg(CASE WHEN judge % 2 = 1 THEN rate END), 5) - round(avg(CASE WHEN judge % 2 = 0 THEN rate END), 5) >= 0.025 END AS challenger_won FROM r""")
def sample_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate on the valid share, means of both sides, and the margin test."""
    side = lambda k: F.round(F.avg(F.when(F.col("judge") % 2 == k, F.col("rate"))), 5)
    got = _rates(spark, sf_dir).agg(F.count("*").alias("total"), F.count("rate").alias("valid"), side(0).alias("king"), side(1).alias("challenger"))
    enough = F.col("valid") / F.col("total") >= 0.8
    return got.select("*", F.when(enough, "succeeded").otherwise("failed").alias("state"), F.when(enough, F.col("challenger") - F.col("king") >= WIN_MARGIN).alias("challenger_won"))


@query("""
SELECT user_id, event_type AS answer, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1""")
def majority_vote_first_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most common answer of each user; on a tie the one seen first."""
    each = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    best = F.max_by(F.struct("event_type", "n"), F.struct("n", -F.col("first"))).alias("b")
    return each.groupBy("user_id").agg(best).select("user_id", F.col("b.event_type").alias("answer"), F.col("b.n").alias("n"))


sql_query("mean_over_repeats", "lineitem", """
SELECT l_partkey, count(l_discount) AS repeats, round(avg(l_discount), 5) AS score FROM lineitem GROUP BY l_partkey""", doc="Per-question mean over repeats.")

sql_query("score_shares", "lineitem", """
WITH t AS (SELECT l_orderkey, l_returnflag AS tag, sum(l_quantity * l_discount) AS part FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_orderkey, tag, part / nullif(sum(part) OVER (PARTITION BY l_orderkey), 0) AS share FROM t)
SELECT tag, round(avg(share), 5) AS mean_share, round(max(share), 5) AS max_share, round(max(share) - avg(share), 5) AS diff FROM s GROUP BY tag""", doc="Shares of a record's score by tag.")

sql_query("king_by_judge", "lineitem", """
SELECT l_suppkey AS judge, round(avg(l_discount), 5) AS rate FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F' GROUP BY l_suppkey""")

sql_query("source_stats", "documents labels", """
SELECT source, count(*) AS rows_, count(DISTINCT text) AS instances, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS blocked, bool_or(coalesce(quality, 0) = 1) AS any_good, min(lang) AS first_lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""", """
SELECT source, count(*) AS rows_, count(DISTINCT text) AS instances, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bigint) AS blocked, bool_or(coalesce(quality, 0) = 1) AS any_good, min(lang) AS first_lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""", doc="Per-source statistics.")

sql_query("language_histogram", "documents", """
SELECT source, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY source, lang""")

sql_query("state_buckets", "orders", """
SELECT stage, bucket, count(*) AS n, min(o_orderkey) AS first_key FROM orders JOIN (VALUES ('O', 'queue', 'waiting'), ('F', 'done', 'scored'), ('P', 'run', 'active')) AS m(state, stage, bucket) ON o_orderstatus = m.state GROUP BY stage, bucket""", doc="States mapped to stages and buckets by a small table.")

sql_query("change_signature", "orders customer lineitem", """
SELECT (SELECT count(*) FROM orders) AS runs, (SELECT max(o_orderdate) FROM orders) AS newest, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 25) AS scored""", doc="Four global aggregates in one row.")

sql_query("suite_scores", "lineitem", """
SELECT l_suppkey, l_returnflag, round(avg(l_discount), 5) AS score, count(*) AS passes, max_by(l_orderkey, struct(l_shipdate, l_orderkey, l_linenumber)) AS latest FROM lineitem GROUP BY 1, 2""", """
SELECT l_suppkey, l_returnflag, round(avg(l_discount), 5) AS score, count(*) AS passes, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS latest FROM lineitem GROUP BY 1, 2""", doc="Mean over passes with the attributes of the latest.")

sql_query("best_scores", "lineitem", """
SELECT l_returnflag, max(s) AS best FROM (SELECT l_returnflag, l_suppkey, round(avg(l_discount), 5) AS s FROM lineitem WHERE l_suppkey <> 1 GROUP BY 1, 2) GROUP BY l_returnflag""")

sql_query("collapse_passes", "orders", """
SELECT o_custkey, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS newest, count(*) AS passes FROM orders GROUP BY o_custkey""", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, count(*) AS passes FROM orders GROUP BY o_custkey""")

sql_query("report_states", "orders", """
SELECT o_custkey, min_by(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS state FROM orders GROUP BY o_custkey""", """
SELECT o_custkey, arg_min(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS state FROM orders GROUP BY o_custkey""", doc="First state in a list of priorities.")

sql_query("distinct_submissions", "orders lineitem", """
SELECT l_returnflag, count(DISTINCT o_custkey) AS submitters FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_returnflag""")

sql_query("gate_precedence", "lineitem", """
SELECT l_orderkey, CASE max(CASE WHEN l_quantity > 48 THEN 3 WHEN l_discount > 0.09 THEN 2 WHEN l_tax > 0.07 THEN 1 ELSE 0 END) WHEN 3 THEN 'injection' WHEN 2 THEN 'infra' WHEN 1 THEN 'failed' ELSE 'pass' END AS verdict FROM lineitem GROUP BY l_orderkey""", doc="Worst reason of a group decides.")

sql_query("next_attempt", "orders", "SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_attempt FROM orders GROUP BY o_custkey")

sql_query("strike_count", "customer orders", """
SELECT c_custkey, sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN 1 ELSE 0 END) AS strikes FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""", """
SELECT c_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN 1 ELSE 0 END) AS bigint) AS strikes FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")

sql_query("progress_counters", "orders", """
SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS done,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM orders""")

sql_query("weight_payload", "customer", """
SELECT c_nationkey, CAST(sum(CAST(floor(greatest(c_acctbal, 0)) AS decimal(18, 0))) AS double) AS weight, count(*) AS members,
  CASE WHEN count(*) > 0 AND min(greatest(c_acctbal, 0)) >= 0 THEN true ELSE false END AS ok FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_nationkey""", doc="Decimal weights by member, and their validation.")

sql_query("moments_rollup", "lineitem", """
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 5) AS mean, round(stddev_pop(l_quantity) / avg(l_quantity), 5) AS cv, round(median(l_quantity), 5) AS mid, round(sum(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END) / count(*), 5) AS changed FROM lineitem GROUP BY l_returnflag""")

sql_query("files_per_run", "documents", """
SELECT source AS run, max(doc_id) AS newest, sum(n_chars) AS bytes_, count(*) AS files, (sum(n_chars) > 250000 OR count(*) > 60) AS over_quota FROM documents GROUP BY source""", """
SELECT source AS run, max(doc_id) AS newest, CAST(sum(n_chars) AS bigint) AS bytes_, count(*) AS files, (sum(n_chars) > 250000 OR count(*) > 60) AS over_quota FROM documents GROUP BY source""", doc="Listing grouped by run, with the quota predicate.")
