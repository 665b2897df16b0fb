"""Lifecycle reports: expectations over verdicts, histories, guards, expiries and lookups.

Stand-in tables as in `joins`: customers are submitters, orders their runs, line items parts of a run.
Windows are partitioned by a key of high cardinality, and first or latest rows are plain aggregates.
"""

from __future__ import annotations

from millrace.operators.sqltools import sql_query

sql_query("verdict_expectation", "lineitem", """
SELECT l_orderkey, round(sum(l_discount * l_tax) / sum(l_discount), 9) AS score, round(sum(l_discount), 4) AS mass
FROM lineitem WHERE l_discount >= 0.001 GROUP BY l_orderkey""", doc="Expectation over renormalised probabilities; tiny ones are left out.")

sql_query("uri_text_join", "pages", """
SELECT p.page_id, f.first_page FROM pages p JOIN (SELECT url, min(page_id) AS first_page FROM pages GROUP BY url) f ON p.url = f.url""", doc="Join on URI text.")

sql_query("cross_group_pairs", "lineitem", """
SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'N'""", doc="Pairs across two groups of one order, which has at most seven lines.")

sql_query("queue_minus_current", "orders", """
SELECT o_orderkey, o_custkey FROM orders q WHERE o_orderstatus = 'O'
AND NOT EXISTS (SELECT 1 FROM orders c WHERE c.o_custkey = q.o_custkey AND c.o_orderstatus = 'P')""", doc="Waiting runs of submitters with none active.")

sql_query("crowning_history", "orders", """
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bigint) AS reign FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM orders) x
WHERE best IS NULL OR o_totalprice > best""", doc="Runs that beat all before them, numbered in order.")

sql_query("duplicate_event_guard", "events", """
SELECT event_id, first_id FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, props) AS first_id FROM events) x WHERE event_id <> first_id""", doc="Events whose user, type and data occurred before.")

sql_query("expected_minus_present", "lineitem", """
WITH present AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10)
SELECT l_orderkey, CAST(n AS bigint) AS n FROM (SELECT l_orderkey, explode(sequence(1, max(l_linenumber))) AS n FROM present GROUP BY l_orderkey) e
WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.l_orderkey = e.l_orderkey AND p.l_linenumber = e.n)""", """
WITH present AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10)
SELECT l_orderkey, n FROM (SELECT l_orderkey, unnest(generate_series(1, max(l_linenumber))) AS n FROM present GROUP BY l_orderkey) e
WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.l_orderkey = e.l_orderkey AND p.l_linenumber = e.n)""", doc="Expected parts that are missing.")

sql_query("reason_set_inclusion", "lineitem", """
SELECT l_orderkey, bool_and(l_returnflag IN ('A', 'N')) AS only_allowed, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'N') AS has_all FROM lineitem GROUP BY l_orderkey""", doc="Inclusion tests between sets of reasons, without building the sets.")

sql_query("upload_expiry", "orders lineitem", """
SELECT o_orderkey, CASE WHEN max(l_shipdate) > o_orderdate + INTERVAL '30' DAY THEN 'EXPIRED' ELSE 'OPEN' END AS state FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate""", doc="Windows closed by a deadline.")

sql_query("last_successful_block", "lineitem", """
SELECT l_suppkey, max(CASE WHEN l_linestatus = 'F' THEN l_orderkey END) AS block, count(*) AS tries FROM lineitem GROUP BY l_suppkey""", doc="Newest success of each member, null without one.")

sql_query("key_reuse_rejection", "orders", """
SELECT o_orderkey, prior FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS prior FROM orders) x WHERE prior IS NOT NULL""", doc="Reused keys with the record before.")

sql_query("tier_override_lookup", "customer nation region", """
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS tier
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", doc="A key's own tier wins over its group's, that over the default.")

sql_query("first_unusable_reason", "documents labels", """
SELECT d.doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 50 THEN 'short' WHEN coalesce(toxic, 0) = 1 THEN 'toxic' WHEN coalesce(quality, 1) = 0 THEN 'quality' WHEN lang IS NULL THEN 'lang' END AS reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""", doc="First reason that applies; null where a document is usable.")

sql_query("architecture_key", "lineitem", """
SELECT l_orderkey, substr(sha2(array_join(array_sort(collect_list(concat(CAST(l_linenumber AS string), ':', CAST(l_partkey AS string)))), ','), 256), 1, 12) AS arch FROM lineitem GROUP BY l_orderkey""", """
SELECT l_orderkey, substr(sha256(string_agg(x, ',' ORDER BY x)), 1, 12) AS arch FROM (SELECT l_orderkey, l_linenumber::varchar || ':' || l_partkey::varchar AS x FROM lineitem) GROUP BY l_orderkey""", doc="Digest of the sorted names and shapes of one model.")

sql_query("pair_completion_batches", "lineitem", """
SELECT l_orderkey, side, CAST(floor((row_number() OVER (PARTITION BY side ORDER BY done, l_orderkey) - 1) / 32) AS bigint) AS batch FROM (
  SELECT l_orderkey, min(l_suppkey) AS side, max(l_shipdate) AS done FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 2) x""", doc="Pairs whose two sides are done, in batches of 32 by time.")

sql_query("notification_window", "events", """
SELECT user_id, event_type, CAST(date_trunc('hour', ts) AS string) AS hour_, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY user_id, event_type, date_trunc('hour', ts)""", doc="One notice for each kind and hour.")

sql_query("yes_rate_by_run", "documents labels", """
SELECT source AS run, count(*) AS scored, round(avg(quality), 9) AS yes_rate FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL GROUP BY source""", doc="Rate of good answers among the scored ones of a run.")
