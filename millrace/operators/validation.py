"""Validation by set algebra over inventories: digests, full outer comparisons, allow-lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.sqltools import sql_query
from millrace.plans.registry import query
from millrace.session import table


@query("""
SELECT source, sha256(string_agg(h, chr(10) ORDER BY h)) AS tensors_hash, substring(sha256(string_agg(doc_id || ':' || n_chars, chr(10) ORDER BY doc_id || ':' || n_chars)), 1, 12) AS arch_key FROM (SELECT source, doc_id, n_chars, sha256(text) h FROM documents) GROUP BY 1""")
def inventory_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests over sorted parts. Parts go to one row per inventory, as the digest is defined over all of them in order."""
    parts = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).alias("shape"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    return parts.groupBy("source").agg(joined("h").alias("tensors_hash"), F.substring(joined("shape"), 1, 12).alias("arch_key"))


sql_query("inventory_diff_full_outer", "part lineitem", """
SELECT coalesce(p_partkey, l_partkey) AS k, CASE WHEN l_partkey IS NULL THEN 'missing' WHEN p_partkey IS NULL THEN 'unexpected' WHEN p_size <> n THEN 'differs' ELSE 'equal' END AS status
FROM part FULL OUTER JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity < 40 GROUP BY l_partkey) l ON p_partkey = l_partkey""", doc="Two inventories compared in one full outer join.")

sql_query("allow_list_check", "lineitem", """
SELECT l_orderkey, sum(CASE WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 1 ELSE 0 END) AS unexpected, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) > 0 AS required_present FROM lineitem GROUP BY l_orderkey""", """
SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 1 ELSE 0 END) AS bigint) AS unexpected, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) > 0 AS required_present FROM lineitem GROUP BY l_orderkey""")

sql_query("weight_validation", "customer", """
SELECT c_nationkey, round(sum(w), 6) AS total, min(w) > 0 AS positive, abs(sum(w) - 1) <= 0.000000001 AS sums_to_one FROM (
  SELECT c_nationkey, 1.0E0 / count(*) OVER (PARTITION BY c_nationkey) AS w FROM customer) GROUP BY c_nationkey""", """
SELECT c_nationkey, round(sum(w), 6) AS total, min(w) > 0 AS positive, abs(sum(w) - 1) <= 0.000000001 AS sums_to_one FROM (
  SELECT c_nationkey, 1.0::double / count(*) OVER (PARTITION BY c_nationkey) AS w FROM customer) GROUP BY c_nationkey""")

sql_query("set_difference_runs", "orders lineitem", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 30""", doc="Runs not yet processed.")

sql_query("shared_targets", "lineitem", """
SELECT l_partkey FROM (SELECT l_partkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_partkey) WHERE n = 3""", doc="Targets that every run has.")

sql_query("union_all_limited", "orders customer", """
SELECT o_custkey AS k, 'run' AS kind FROM orders WHERE o_orderstatus = 'P' UNION ALL (SELECT c_custkey, 'latest' FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)""")

sql_query("retention_decision", "orders", """
SELECT o_custkey, CASE WHEN n = 1 THEN 'keep:single' WHEN open_ > 0 THEN 'keep:active' WHEN newest >= timestamp_ntz '1998-06-01 00:00:00' THEN 'keep:grace' WHEN lost > 3 THEN 'drop:lost' ELSE 'drop:old' END AS decision FROM (
  SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS open_, max(o_orderdate) AS newest, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS lost FROM orders GROUP BY o_custkey)""", """
SELECT o_custkey, CASE WHEN n = 1 THEN 'keep:single' WHEN open_ > 0 THEN 'keep:active' WHEN newest >= timestamp '1998-06-01 00:00:00' THEN 'keep:grace' WHEN lost > 3 THEN 'drop:lost' ELSE 'drop:old' END AS decision FROM (
  SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS open_, max(o_orderdate) AS newest, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS lost FROM orders GROUP BY o_custkey)""", doc="Ordered rules over aggregated states.")

sql_query("tri_state_filters", "orders", """
SELECT o_orderkey, o_orderstatus IS DISTINCT FROM lag_status AS changed FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS lag_status FROM orders)
WHERE o_orderstatus IN ('O', 'P') AND (lag_status <> 'F' OR lag_status IS NULL)""")

sql_query("like_and_ilike", "part", """
SELECT p_partkey, p_type ILIKE '%steel%' AS steel, p_name LIKE 'a%' AS a_name, coalesce(nullif(p_brand, 'Brand#1'), 'none') AS brand FROM part WHERE p_type ILIKE '%e%' OR p_name LIKE '%z%'""")
