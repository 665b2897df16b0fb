"""Relational joins of the lifecycle and dashboard queries, on stand-in tables.

Customers stand for submitters, orders for their evaluation runs, line items for the parts of a run.
Order of nulls is always explicit, and every top-1 has a tie-breaking key.
"""

from __future__ import annotations

from millrace.operators.sqltools import sql_query

sql_query("queue_head", "orders customer", """
SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'O' AND c_acctbal > 0
ORDER BY o_orderpriority ASC NULLS LAST, o_orderdate ASC NULLS LAST, o_orderkey LIMIT 1""", doc="Inner join, filter, head of the queue by three keys.")

sql_query("four_way_join", "orders customer nation region", """
SELECT o_orderkey, c_custkey, n_name, r_name FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F' AND o_totalprice > 200000""", doc="Chain of inner joins with a filter on the large side.")

sql_query("star_slot_join", "orders lineitem part supplier", """
SELECT l_orderkey, p_name, s_name FROM lineitem
JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE p_size >= 45""", doc="Star join whose slot predicate stands in the ON clause.")

sql_query("left_joins_defaults", "customer orders", """
SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(total, 0.0) AS total FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) x ON o_custkey = c_custkey""", doc="Left outer join with defaults for the missing side.")

sql_query("lateral_latest", "customer orders", """
SELECT c_custkey, o_orderkey, o_totalprice FROM (
  SELECT c_custkey, max_by(struct(o_orderkey, o_totalprice), struct(o_orderdate, o_orderkey)) AS last
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
LATERAL VIEW inline(array(last)) AS o_orderkey, o_totalprice""", """
SELECT c_custkey, o_orderkey, o_totalprice FROM customer
LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true""", doc="Latest run of each submitter: one aggregation instead of a top-1 per row.")

sql_query("prior_wins_count", "customer orders", """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 150000) AS prior_wins FROM customer""", doc="Correlated count, decorrelated to an outer join.")

sql_query("correlated_top1", "customer orders", """
SELECT c_custkey, max_by(o_orderpriority, struct(o_totalprice, o_orderkey)) AS best_priority
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""", """
SELECT c_custkey, (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1) AS best_priority FROM customer""")

sql_query("ordered_pass_margins", "orders", """
SELECT o_custkey, array_join(transform(array_sort(collect_list(struct(o_orderdate, o_orderkey))), x -> cast(x.o_orderkey AS string)), ',') AS passes, count(*) AS n
FROM orders GROUP BY o_custkey""", """
SELECT o_custkey, string_agg(o_orderkey::varchar, ',' ORDER BY o_orderdate, o_orderkey) AS passes, count(*) AS n FROM orders GROUP BY o_custkey""", doc="Ordered list of passes per submission.")

sql_query("requeue_not_exists", "customer orders", """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""", doc="Left anti join.")

sql_query("validated_exists", "customer orders", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""", doc="Left semi join.")

sql_query("theta_reregistration", "orders lineitem", """
SELECT o_orderkey, count(*) AS late, max(CASE WHEN l_shipdate IS NULL OR l_shipdate >= o_orderdate + INTERVAL '60' DAY THEN 1 ELSE 0 END) AS very_late
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate GROUP BY o_orderkey""", doc="Equi join with a theta residual.")

sql_query("json_key_join", "events customer", """
SELECT c_custkey, count(*) AS n FROM events JOIN customer ON cast(get_json_object(props, '$.k') AS bigint) = c_custkey GROUP BY c_custkey""", """
SELECT c_custkey, count(*) AS n FROM events JOIN customer ON CAST(props->>'$.k' AS bigint) = c_custkey GROUP BY c_custkey""", doc="Join on a key inside JSON.")

sql_query("unnest_update", "customer", """
SELECT c_custkey, coalesce(block, c_nationkey) AS block FROM customer
LEFT JOIN (SELECT inline(array(named_struct('k', 1L, 'block', 101), named_struct('k', 2L, 'block', 102), named_struct('k', 3L, 'block', 103), named_struct('k', 5L, 'block', 105)))) u ON u.k = c_custkey""", """
SELECT c_custkey, coalesce(block, c_nationkey) AS block FROM customer
LEFT JOIN (SELECT unnest([1, 2, 3, 5]) AS k, unnest([101, 102, 103, 105]) AS block) u ON u.k = c_custkey""", doc="Update from a literal relation.")

sql_query("snapshot_swaps", "orders", """
SELECT o_orderkey, o_custkey, before FROM (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, lag(o_orderstatus) OVER w AS before, lag(o_orderpriority) OVER w AS kind, o_orderpriority FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) x
WHERE before IS NOT NULL AND before <> o_orderstatus AND kind = o_orderpriority""", doc="Neighbouring snapshots that differ in one column and agree in another.")

sql_query("pair_validity", "lineitem", """
SELECT count(*) AS pairs, sum(CASE WHEN a.l_returnflag <> 'R' AND b.l_returnflag <> 'R' THEN 1 ELSE 0 END) AS valid,
  sum(CASE WHEN a.l_returnflag <> 'R' AND b.l_returnflag = 'R' AND b.l_linestatus = 'F' THEN 1 ELSE 0 END) AS challenger_failed
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2""", doc="Pairs of two sides joined by sample, and how many are valid.")

sql_query("merge_scores_by_suite", "lineitem orders", """
WITH pulled AS (SELECT l_orderkey AS k, l_returnflag AS suite, round(avg(l_discount), 6) AS score FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
own AS (SELECT l_orderkey AS k, l_returnflag AS suite, round(avg(l_tax), 6) AS score FROM lineitem WHERE l_linenumber = 2 GROUP BY 1, 2)
SELECT k, suite, score, 'pulled' AS origin FROM pulled
UNION ALL SELECT o.k, o.suite, o.score, 'own' FROM own o WHERE NOT EXISTS (SELECT 1 FROM pulled p WHERE p.k = o.k AND p.suite = o.suite)""", doc="Pulled scores replace those of the same suite; the rest stays.")

sql_query("combinations_within_group", "lineitem", """
SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_returnflag <> b.l_returnflag""", doc="Unordered pairs of a small group, one category excluded; an order has at most seven lines.")

sql_query("lag_opponent", "orders", """
SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS opponent FROM orders WHERE o_orderstatus = 'F'""", doc="Each winner's opponent is the winner before.")

sql_query("adjacent_turns", "conversations", """
SELECT conv_id, turn, role, next_role, next_len FROM (
  SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(length(text)) OVER w AS next_len FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) x WHERE role = 'assistant'""", doc="Assistant turns with what follows them.")

sql_query("uri_key_join", "pages documents", """
SELECT p.page_id, coalesce(a.doc_id, b.doc_id) AS doc_id FROM (SELECT page_id, try_cast(regexp_extract(url, '/([0-9]+)(?:[/.?]|$)', 1) AS bigint) AS k FROM pages) p
LEFT JOIN documents a ON a.doc_id = p.k LEFT JOIN documents b ON b.doc_id = p.page_id""", """
SELECT p.page_id, coalesce(a.doc_id, b.doc_id) AS doc_id FROM (SELECT page_id, try_cast(regexp_extract(url, '/([0-9]+)(?:[/.?]|$)', 1) AS bigint) AS k FROM pages) p
LEFT JOIN documents a ON a.doc_id = p.k LEFT JOIN documents b ON b.doc_id = p.page_id""", doc="Key taken from a URI, with a fallback key.")

sql_query("latest_version_per_slot", "orders customer", """
SELECT c_nationkey, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""", """
SELECT c_nationkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""", doc="One aggregation instead of a lookup per row.")

sql_query("distinct_two_table", "orders lineitem", """
SELECT DISTINCT o_custkey, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45""")

sql_query("composite_key_enrich", "lineitem", """
SELECT a.l_orderkey, a.l_linenumber, b.l_extendedprice FROM lineitem a LEFT JOIN (
  SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC) AS rn FROM lineitem WHERE l_linenumber > 2) b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND b.rn = 1""", doc="Enrichment by a composite key, last build wins.")

sql_query("anti_equality_holder", "lineitem", """
SELECT a.l_partkey, min(a.l_suppkey) AS first_holder, count(DISTINCT a.l_suppkey) AS holders FROM lineitem a GROUP BY a.l_partkey HAVING count(DISTINCT a.l_suppkey) > 1""", doc="Holders of the same content other than oneself.")

sql_query("protected_left_join", "customer orders", """
SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS state FROM orders GROUP BY o_custkey) s ON o_custkey = c_custkey
WHERE coalesce(state, '') NOT IN ('P', 'O')""", doc="Left join, default, and membership in none of a list.")
