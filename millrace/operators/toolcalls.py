"""Queries on conversations with tool calls, made of the turns of `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import toolcalls as T
from millrace.plans.registry import query
from millrace.session import table

_TURN = "SELECT conv_id, turn, role AS own, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, coalesce(nullif(regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1), ''), 'x') AS w FROM conversations"
#: Turns with calls; a user's turn is a result of the turn before, but for the first and one in four.
_CALLS = """CASE n % 6 WHEN 0 THEN '[]'
    WHEN 1 THEN concat('[{"function": {"name": "bash", "arguments": ', to_json(named_struct('command', concat(' cat ', w, ' '))), '}}]')
    WHEN 2 THEN concat('[{"name": "think", "arguments": {"thought": "', w, '"}}, {"function": {"name": "shell", "arguments": "{\\\\"cmd\\\\": \\\\"sed -i s/', w, '// f\\\\"}"}}]')
    WHEN 3 THEN concat('[{"function": {"name": "execute_bash", "arguments": {"command": "ls ', w, '"}}}, {"function": {"name": "bash", "arguments": {"command": "echo ', w, ' > out"}}}]')
    WHEN 4 THEN concat('[{"function": {"name": "odd", "arguments": {}}}, {"function": {"name": "file_editor", "arguments": {"command": "view", "path": "', w, '", "view_range": [1, ', n, ']}}}]')
    ELSE '[{"function": {"name": "finish", "arguments": "no json"}}]' END"""


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages): every conversation as JSON text of its turns, in order."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    rows = spark.sql(f"""SELECT conv_id, turn, CASE WHEN own = 'user' AND turn > 0 AND n % 4 <> 0 THEN 'tool' ELSE own END AS role,
        CASE WHEN own = 'assistant' AND n % 5 = 0 THEN '' ELSE text END AS content, CASE WHEN own = 'assistant' THEN {_CALLS} END AS calls FROM ({_TURN})""")
    turn = F.concat(F.expr("substring(to_json(struct(role, content)), 1, length(to_json(struct(role, content))) - 1)"), F.coalesce(F.concat(F.lit(', "tool_calls": '), "calls"), F.lit("")), F.lit("}"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"])
    return rows.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]")).alias("messages"))


_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"""
WITH t AS (SELECT *, CASE WHEN own = 'user' AND turn > 0 AND n % 4 <> 0 THEN 'tool' ELSE own END AS role FROM ({_TURN})),
h AS (SELECT *, max(CASE WHEN role <> 'tool' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM t),
s AS (SELECT h.*, p.own AS head_role, p.n % 6 AS head_kind, row_number() OVER (PARTITION BY h.conv_id, h.head, h.role = 'tool' ORDER BY h.turn) - 1 AS k FROM h LEFT JOIN t p ON p.conv_id = h.conv_id AND p.turn = h.head),
e AS (
    SELECT conv_id, turn, -1 AS k, 0 AS sub, CASE WHEN role = 'assistant' THEN 'thought' ELSE role END AS kind, CASE WHEN role = 'assistant' AND n % 5 = 0 THEN '' ELSE {_STRIP.format('text')} END AS text, false AS edit FROM s WHERE role <> 'tool'
    UNION ALL SELECT conv_id, coalesce(head, -1), k, 1, 'result', {_STRIP.format('text')}, false FROM s WHERE role = 'tool' AND NOT (head_role IS NOT DISTINCT FROM 'assistant' AND head_kind = 2 AND k = 0)
    UNION ALL SELECT conv_id, turn, 0, 0, 'thought', w, false FROM t WHERE own = 'assistant' AND n % 6 = 2
    UNION ALL SELECT conv_id, turn, i, 0, 'assistant', '```bash' || chr(10) || x || chr(10) || '```', edit FROM (
        SELECT conv_id, turn, 0 AS i, 'cat ' || w AS x, false AS edit FROM t WHERE own = 'assistant' AND n % 6 = 1
        UNION ALL SELECT conv_id, turn, 1, 'sed -i s/' || w || '// f', true FROM t WHERE own = 'assistant' AND n % 6 = 2
        UNION ALL SELECT conv_id, turn, 0, 'ls ' || w, false FROM t WHERE own = 'assistant' AND n % 6 = 3
        UNION ALL SELECT conv_id, turn, 1, 'echo ' || w || ' > out', true FROM t WHERE own = 'assistant' AND n % 6 = 3
        UNION ALL SELECT conv_id, turn, 1, 'sed -n ''1,' || n || 'p'' ' || w || ' | cat -n', false FROM t WHERE own = 'assistant' AND n % 6 = 4
        UNION ALL SELECT conv_id, turn, 0, '{T.FINISHED}', false FROM t WHERE own = 'assistant' AND n % 6 = 5)),
g AS (SELECT *, coalesce(count(CASE WHEN kind = 'assistant' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn, k, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e WHERE text <> ''),
j AS (SELECT *, string_agg(CASE WHEN kind = 'thought' THEN text END, chr(10) || chr(10)) OVER (PARTITION BY conv_id, g ORDER BY turn, k, sub ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS thoughts FROM g),
o AS (SELECT conv_id, turn, k, sub, g, kind, edit, CASE kind WHEN 'result' THEN 'user' ELSE kind END || ':' || CASE WHEN kind = 'assistant' AND thoughts IS NOT NULL THEN 'THOUGHT: ' || thoughts || chr(10) || chr(10) || text ELSE text END AS line FROM j WHERE kind <> 'thought')
SELECT conv_id, count(*) AS n_turns, md5(string_agg(line, chr(10) ORDER BY turn, k, sub)) AS turns, coalesce(min(CASE WHEN kind = 'assistant' AND edit THEN g + 1 END), 0)::bigint AS first_edit FROM o GROUP BY 1""")
def tool_call_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA01, XA02, XA03, FS33, FM11: conversations with calls of several tools, as plain turns."""
    rows = _trajectories(spark, sf_dir)
    got = rows.select("conv_id", T.rendered(T.turns_of(rows)).alias("r"))
    lines = F.transform("r.turns", lambda t: F.concat(t["role"], F.lit(":"), t["content"]))
    return got.select("conv_id", F.size("r.turns").cast("bigint").alias("n_turns"), F.md5(F.array_join(lines, "\n")).alias("turns"), "r.first_edit").where("n_turns > 0")


@query(f"""
WITH t AS ({_TURN}), c AS (SELECT *, CASE WHEN own = 'assistant' AND n % 5 = 0 THEN '' ELSE text END AS content, '```bash' || chr(10) AS a, chr(10) || '```' AS z FROM t)
SELECT conv_id, turn, md5(CASE WHEN own <> 'assistant' OR n % 6 = 0 THEN content ELSE array_to_string(list_filter([{_STRIP.format('content')}, CASE n % 6
    WHEN 1 THEN a || 'cat ' || w || z WHEN 2 THEN w || chr(10) || chr(10) || '[shell cmd=''sed -i s/' || w || '// f'']' WHEN 3 THEN a || 'ls ' || w || z || chr(10) || chr(10) || a || 'echo ' || w || ' > out' || z
    WHEN 4 THEN '[odd]' || chr(10) || chr(10) || '[file_editor command=''view'' path=''' || w || ''']' ELSE '[finish]' END], lambda x: x <> ''), chr(10) || chr(10)) END) AS text FROM c""")
def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FM12: each turn's text with its calls behind it."""
    rows = _trajectories(spark, sf_dir)
    each = rows.select("conv_id", F.posexplode(T.turns_of(rows)).alias("nth", "t"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1")).alias("nth"))
    return each.join(turns, ["conv_id", "nth"]).select("conv_id", "turn", F.md5(T.turn_text(F.col("t"))).alias("text"))
