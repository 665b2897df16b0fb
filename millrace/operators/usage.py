"""Usage metering and event operators in batch form; streaming twins are in millrace.streaming."""

from __future__ import annotations

from millrace.operators.sqltools import sql_query

_SEC, _SEC_D = "unix_timestamp(cast(ts AS timestamp))", "CAST(floor(epoch(ts)) AS bigint)"

sql_query("usage_tumbling_4h", "events", f"""
SELECT floor({_SEC} / 14400) * 14400 AS bucket, event_type AS service, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1, 2""", f"""
SELECT CAST(floor({_SEC_D} / 14400) * 14400 AS bigint) AS bucket, event_type AS service, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1, 2""", doc="Tumbling buckets by service.")

sql_query("usage_closed_windows", "events", f"""
WITH now AS (SELECT max({_SEC}) AS t FROM events)
SELECT floor({_SEC} / 14400) * 14400 AS bucket, count(*) AS n FROM events CROSS JOIN now WHERE floor({_SEC} / 14400) < floor(t / 14400) AND {_SEC} >= t - 3 * 86400 GROUP BY 1""", f"""
WITH now AS (SELECT max({_SEC_D}) AS t FROM events)
SELECT CAST(floor({_SEC_D} / 14400) * 14400 AS bigint) AS bucket, count(*) AS n FROM events CROSS JOIN now WHERE floor({_SEC_D} / 14400) < floor(t / 14400) AND {_SEC_D} >= t - 3 * 86400 GROUP BY 1""", doc="Closed windows of the last three days; `now` is one row.")

_KINDS = ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}_" for k in ("click", "view", "purchase", "error", "signup"))
sql_query("usage_pivot", "events", f"""
SELECT day, {_KINDS}, count(*) AS total FROM (SELECT floor({_SEC} / 86400) AS day, event_type FROM events) x GROUP BY ROLLUP (day)""", f"""
SELECT day, {_KINDS}, count(*) AS total FROM (SELECT CAST(floor({_SEC_D} / 86400) AS bigint) AS day, event_type FROM events) x GROUP BY day
UNION ALL SELECT NULL, {_KINDS}, count(*) FROM events""", doc="SURVEY AG15: services as columns, with totals and a grand total row.")

sql_query("usage_by_dimension", "events", f"""
SELECT event_type, day, count(*) AS n, round(sum(value), 2) AS total, min(event_id) AS first_id, round(avg(value), 4) AS mean, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) AS errors
FROM (SELECT *, floor({_SEC} / 86400) AS day FROM events) GROUP BY GROUPING SETS ((event_type), (day), ())""", f"""
SELECT event_type, day, count(*) AS n, round(sum(value), 2) AS total, min(event_id) AS first_id, round(avg(value), 4) AS mean, CAST(sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) AS bigint) AS errors
FROM (SELECT *, CAST(floor({_SEC_D} / 86400) AS bigint) AS day FROM events) GROUP BY GROUPING SETS ((event_type), (day), ())""", doc="One report over several dimensions in one pass.")

sql_query("rate_limit_60s", "events", """
SELECT event_id, n > 5 AS limited, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY unix_micros(cast(ts AS timestamp)) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n FROM events)""", """
SELECT event_id, n > 5 AS limited, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n FROM events)""", doc="Sliding count of the last minute per account.")

sql_query("event_dedup_fold", "events", """
SELECT user_id, count(*) AS n, max(event_id) AS newest, max_by(event_type, struct(ts, event_id)) AS state, round(max(value), 4) AS progress FROM (
  SELECT DISTINCT event_id, user_id, ts, event_type, value FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0)) GROUP BY user_id""", """
SELECT user_id, count(*) AS n, max(event_id) AS newest, arg_max(event_type, (ts, event_id)) AS state, round(max(value), 4) AS progress FROM (
  SELECT DISTINCT event_id, user_id, ts, event_type, value FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0)) GROUP BY user_id""", doc="Repeated deliveries dropped, then folded to a run state with monotone counters.")

sql_query("lease_timeout_gaps", "events", f"""
SELECT user_id, count(*) AS expired, max(gap) AS longest FROM (SELECT user_id, {_SEC} - lag({_SEC}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap > 21600 GROUP BY user_id""", f"""
SELECT user_id, count(*) AS expired, max(gap) AS longest FROM (SELECT user_id, {_SEC_D} - lag({_SEC_D}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap > 21600 GROUP BY user_id""", doc="Heartbeats further apart than a lease.")

sql_query("period_filters", "events", f"""
WITH now AS (SELECT max({_SEC}) AS t FROM events)
SELECT period, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT value, explode(filter(array(CASE WHEN t - s <= 86400 THEN '24h' END, CASE WHEN t - s <= 604800 THEN '7d' END, CASE WHEN t - s <= 2592000 THEN '30d' END), x -> x IS NOT NULL)) AS period FROM (SELECT value, {_SEC} AS s, t FROM events CROSS JOIN now)) GROUP BY period""", f"""
WITH now AS (SELECT max({_SEC_D}) AS t FROM events)
SELECT period, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT value, unnest(['24h', '7d', '30d']) AS period, unnest([86400, 604800, 2592000]) AS span, {_SEC_D} AS s, t FROM events CROSS JOIN now) WHERE t - s <= span GROUP BY period""", doc="Trailing periods in one pass.")

sql_query("key_usage_since", "events", """
SELECT user_id, count(*) AS requests, round(sum(value), 2) AS tokens, max(ts) AS last_used FROM events WHERE ts >= timestamp_ntz '2024-01-10 00:00:00' GROUP BY user_id""", """
SELECT user_id, count(*) AS requests, round(sum(value), 2) AS tokens, max(ts) AS last_used FROM events WHERE ts >= timestamp '2024-01-10 00:00:00' GROUP BY user_id""")

sql_query("json_paths", "events", """
SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k, get_json_object(props, '$.missing') AS missing FROM events""", """
SELECT event_id, CAST(props->>'$.k' AS bigint) AS k, props->>'$.missing' AS missing FROM events""", doc="JSON projections, null where the key is missing.")

sql_query("sessions_by_gap", "events", f"""
SELECT user_id, session, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT user_id, event_id, ts, CASE WHEN {_SEC} - lag({_SEC}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2""", f"""
SELECT user_id, CAST(session AS bigint) AS session, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT user_id, event_id, ts, CASE WHEN {_SEC_D} - lag({_SEC_D}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2""", doc="Uploads told apart by idle time.")

sql_query("daily_salted_hash", "events", """
SELECT event_id, substring(sha2(concat(cast(cast(ts AS date) AS string), ':', cast(user_id AS string)), 256), 1, 16) AS client FROM events""", """
SELECT event_id, substring(sha256(concat(CAST(CAST(ts AS date) AS varchar), ':', CAST(user_id AS varchar))), 1, 16) AS client FROM events""")
