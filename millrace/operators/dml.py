"""Writes of the lifecycle as table-to-table steps: claims, upserts, latches, retry splits, promotion.

Spark has no row locks. A claim is the next row by the queue's order; everything else is a join of the
old table with the changes whose result replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.sqltools import sql_query


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of old with those of new put over them by key; columns in keep_old stay where they are set.
    `inserted` tells rows that are only in new."""
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = old.alias("o").join(new.alias("n"), on, "full_outer")
    key = keys[0]
    cols = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in keys or c in keep_old else F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return both.select(*cols, F.col(f"o.{key}").isNull().alias("inserted"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with those rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of the runs in new replaced by them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Last write of each key wins."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), by).alias("r")).select("r.*")


_NEW = "SELECT p_partkey AS k, round(max(CASE WHEN p_size > 25 THEN p_retailprice END), 2) AS total FROM part GROUP BY p_partkey"
sql_query("upsert_keep_old", "customer part", f"""
SELECT coalesce(c_custkey, k) AS k, coalesce(c_name, 'new') AS name, coalesce(total, c_acctbal) AS amount, c_custkey IS NULL AS inserted FROM customer c FULL OUTER JOIN ({_NEW}) n ON c_custkey = k""", f"""
SELECT c_custkey AS k, c_name AS name, CASE WHEN total IS NULL THEN c_acctbal ELSE total END AS amount, false AS inserted FROM customer LEFT JOIN ({_NEW}) n ON k = c_custkey
UNION ALL SELECT k, 'new', total, true FROM ({_NEW}) n WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)""", doc="SURVEY DM02: upsert of part prices into balances, old values kept where a new one is missing, with an inserted flag.")

sql_query("insert_if_absent", "customer part", """
SELECT c_custkey AS k, 'old' AS origin FROM customer UNION ALL SELECT DISTINCT p_partkey, 'new' FROM part WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey)""", """
SELECT k, min(o) AS origin FROM (SELECT c_custkey AS k, 'old' AS o FROM customer UNION ALL SELECT DISTINCT p_partkey, 'part' FROM part) GROUP BY k HAVING min(o) = 'old'
UNION ALL SELECT p_partkey, 'new' FROM part LEFT JOIN customer ON c_custkey = p_partkey WHERE c_custkey IS NULL""", doc="SURVEY DM03, DM05: keys of parts inserted where no customer has them.")

sql_query("retry_cap_split", "orders", """
SELECT o_orderkey, attempts, CASE WHEN attempts >= 12 THEN 'TERMINAL' ELSE 'REQUEUED' END AS state, CASE WHEN wins = 1 THEN 0 ELSE 5 END AS priority FROM (
  SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS attempts, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS wins FROM orders)""", doc="Retry cap, and the first win's priority.")

sql_query("latch_fold", "orders", """
SELECT o_custkey, max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) AS level, count(DISTINCT o_orderstatus) AS seen FROM orders GROUP BY o_custkey""", doc="A guarded state only moves forward: a maximum over the event log.")

sql_query("promotion_supersede", "orders", """
SELECT o_custkey, o_orderkey, CASE WHEN rk = 1 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS state, CASE WHEN rk = 1 THEN NULL WHEN o_orderstatus = 'F' THEN 'replaced' ELSE 'withdrawn' END AS reason FROM (
  SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rk FROM orders)""", doc="Newest version active, the others superseded with a reason.")

sql_query("epoch_latest_wins", "lineitem", """
SELECT l_partkey, floor(l_orderkey / 1000) AS window_, max(l_orderkey) AS epoch FROM lineitem GROUP BY 1, 2""", """
SELECT l_partkey, CAST(floor(l_orderkey / 1000) AS bigint) AS window_, max(l_orderkey) AS epoch FROM lineitem GROUP BY 1, 2""")

sql_query("retired_members", "customer", """
SELECT a.c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) a WHERE NOT EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey = a.c_custkey AND b.c_mktsegment = 'BUILDING')""")
