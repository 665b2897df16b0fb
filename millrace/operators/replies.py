"""Queries that read replies: answers of judges, flags of gates, replies brought into a shape.

The replies are written from the words of each document, in the forms in which models write them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import replies as R
from millrace.functions.text import letter_value
from millrace.plans.registry import query
from millrace.session import table

#: Six words of each text (padded where it has fewer) and a number for the form of the reply; both engines read it.
_WORDS = """
SELECT doc_id, {slice}({concat}(regexp_extract_all(coalesce(text, ''), '([A-Za-z]+)', 1), {pad}), 1, 6) AS w,
    length(coalesce(text, '')) AS n FROM documents"""
WORDS = _WORDS.format(slice="slice", concat="concat", pad="array('aa', 'bee', 'cat', 'Tea', 'u', 'z')")
DUCK_WORDS = _WORDS.format(slice="list_slice", concat="list_concat", pad="['aa', 'bee', 'cat', 'Tea', 'u', 'z']")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(WORDS)


@query(f"""
WITH d AS ({DUCK_WORDS}),
said AS (
    SELECT doc_id, n % 6 AS k, [w[1], w[2], w[3]] AS q, list_filter([
        {{'i': 1, 'q': w[1], 'v': upper(w[4][1]), 'r': w[5]}},
        {{'i': 2, 'q': w[2], 'v': upper(w[6][1]), 'r': w[1]}},
        {{'i': 3, 'q': w[3], 'v': upper(CASE WHEN n % 2 = 0 THEN w[5][1] ELSE w[5][1:2] END), 'r': '{{ "' || w[6]}}
    ], lambda x: length(x.v) = 1 AND x.v BETWEEN 'A' AND 'T' AND CASE WHEN n % 6 = 2 THEN x.i < 3 WHEN n % 6 = 4 THEN false WHEN n % 6 = 5 THEN x.i = 2 ELSE true END) AS a
    FROM d),
each AS (SELECT doc_id, a, q, generate_subscripts(q, 1) AS nth, unnest(q) AS question FROM said),
found AS (SELECT doc_id, nth, question, list_filter(a, lambda x: x.q = question)[-1] AS x FROM each),
worth AS (SELECT *, ascii(x.v) - 65 AS p FROM found)
SELECT doc_id, CAST(nth AS int) AS nth, question, x.v AS letter, coalesce(x.r, '') AS reason, CAST(round(CASE
    WHEN p <= 4 THEN p * 0.15 / 4 WHEN p <= 9 THEN 0.15 + (p - 4) * 0.2 / 5
    WHEN p <= 14 THEN 0.35 + (p - 9) * 0.35 / 5 ELSE 0.7 + (p - 14) * 0.3 / 5 END, 6) AS double) AS score,
    bool_and(x IS NOT NULL) OVER (PARTITION BY doc_id) AS complete
FROM worth""")
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FM10, XA27, FM05: the letter, reason and score that a judge's reply gives each question. Fenced, in prose with
    braces, after a draft, as a bare list, cut off, and with a key said twice."""
    made = _words(spark, sf_dir).selectExpr(
        "doc_id", "slice(w, 1, 3) AS questions", "n % 6 AS k", "w",
        "to_json(struct(w[0] AS asked, left(w[3], 1) AS verdict, w[4] AS reason)) AS first",
        "to_json(struct(w[1] AS id, concat(' ', lower(left(w[5], 1)), ' ') AS answer, w[0] AS explanation)) AS second",
        "to_json(struct(w[2] AS asked, left(w[4], IF(n % 2 = 0, 1, 2)) AS verdict, concat('{ \"', w[5]) AS reason)) AS third",
    ).selectExpr("doc_id", "questions", r"""CASE k
        WHEN 0 THEN concat('Here: ```json\n{"answers": [', concat_ws(',', first, second, third), ']}\n``` done {')
        WHEN 1 THEN concat(w[0], ' {', w[1], '} said "', w[2], ' {"answers": [', concat_ws(',', first, second, third), ']} and so on ]')
        WHEN 2 THEN concat('{"answers": [', third, ']} then {"answers": [', concat_ws(', ', first, second), ']}')
        WHEN 3 THEN concat('[', concat_ws(',', first, second, third), ']')
        WHEN 4 THEN concat('{"answers": [', concat_ws(',', first, second))
        ELSE concat('{"answers": [', concat_ws(',', first, second, third), '], "answers": [', second, ']}') END AS reply""")
    read = made.select("doc_id", R.answers(F.col("reply"), F.col("questions")).alias("r"))
    each = read.select("doc_id", "r.complete", F.posexplode("r.answers").alias("nth", "a"))
    return each.select("doc_id", (F.col("nth") + 1).alias("nth"), "a.question", "a.letter", "a.reason", letter_value(F.col("a.letter")).alias("score"), "complete")


@query(f"""
WITH d AS ({DUCK_WORDS}), f AS (SELECT doc_id, w, n, n % 13 AS k, lower(w[1]) < lower(w[2]) AS first FROM d),
t AS (SELECT *, CASE WHEN k = 8 THEN NULL WHEN k IN (9, 10, 11) THEN NULL ELSE first END AS flag FROM f)
SELECT doc_id, flag, CASE WHEN flag IS NULL THEN '' WHEN k = 7 THEN '["' || w[3] || '",' || length(w[4]) || ']' ELSE left(repeat(w[3] || ' "' || w[4] || '" ', 40), 300) END AS note FROM t""")
def gate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA28: what a gate's reply says, and its note. The flag is said as a boolean, a number or a word, alone or in
    prose; it is no flag where the word is another one, where it is null or missing, or where nothing can be read."""
    made = _words(spark, sf_dir).selectExpr("doc_id", "w", "n % 13 AS k", "lower(w[0]) < lower(w[1]) AS yes").selectExpr(
        "doc_id", "k", "w", """CASE WHEN k = 0 THEN IF(yes, '1', '0') WHEN k = 1 THEN IF(yes, '"Yes "', '" NO"') WHEN k = 2 THEN IF(yes, '"y"', '"n"')
            WHEN k = 3 THEN IF(yes, '0.5', '0.0') WHEN k = 4 THEN IF(yes, '"TRUE"', '"False"') WHEN k = 8 THEN concat('"', w[0], ' perhaps"')
            WHEN k = 9 THEN 'null' ELSE CAST(yes AS STRING) END AS said""",
        "IF(k = 7, concat('[\"', w[2], '\", ', length(w[3]), ']'), to_json(array(repeat(concat(w[2], ' \"', w[3], '\" '), 40)))) AS noted",
    ).selectExpr("doc_id", "k", "w", "IF(k = 10, '{\"viable\": true}', concat('{\"injection\": ', said, ', \"evidence\": ', IF(k = 7, noted, substring(noted, 2, length(noted) - 2)), '}')) AS own")
    reply = F.expr("""CASE WHEN k = 11 THEN concat(w[0], ' says {', w[1]) WHEN k = 5 THEN concat(w[0], ' {', w[1], ' ', own, ' ', w[2], ' }')
        WHEN k = 6 THEN concat('{"injection": null, "evidence": "draft"} ', own, ' {"other": 1}') WHEN k = 12 THEN concat('[', own, ']') ELSE concat(' ', own, '\\n') END""")
    return made.select("doc_id", R.flag(reply, "injection", "evidence").alias("f")).select("doc_id", "f.flag", "f.note")


SHAPE = {"properties": {"title": {"type": "string", "maxLength": 36}, "description": {"type": "string"}}, "required": ["title", "description"]}


@query(r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) % 4 AS k, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, k, list_filter(list_transform(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(x, '```')),
    lambda x: regexp_replace(trim(x), '^[#*\-\d.)\s]+', '')), lambda x: x <> '') AS l FROM d),
p AS (SELECT doc_id, k, coalesce(l[1], 'Task') AS first, array_to_string(l[2:], ' ') AS rest FROM l),
v AS (SELECT doc_id, k, first, CASE WHEN rest = '' THEN first ELSE rest END AS rest FROM p)
SELECT doc_id, CASE WHEN k <> 3 AND length(first) > 36 THEN rtrim(left(first, 35)) || '…' ELSE first END AS title, md5(rest) AS description FROM v""")
def replies_in_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY RP07: each document as a reply to a schema of title and description: prose as it stands, with marks and
    labels before its lines, and after thinking; one reply in four is an object already, fenced, with another key."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "length(coalesce(text, '')) % 4 AS k", "coalesce(text, '') AS t")
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")
    lines = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"^[#*\-\d.)\s]+", "")), lambda x: x != "")
    parts = rows.select("doc_id", "k", "t", lines.alias("l")).selectExpr(
        "doc_id", "k", "t", "l", "coalesce(try_element_at(l, 1), 'Task') AS first", "array_join(slice(l, 2, greatest(size(l), 1)), ' ') AS rest")
    ready = F.concat(F.lit("Sure.\n```json\n"), F.to_json(F.struct(F.lit(1).alias("extra"), F.when(F.col("rest") == "", F.col("first")).otherwise(F.col("rest")).alias("description"), F.col("first").alias("title"))), F.lit("\n```"))
    marked = F.concat(F.lit("## 1. **title**: "), F.array_join("l", "\n - "))
    reply = F.when((F.col("k") == 1) & (F.size("l") > 0), marked).when(F.col("k") == 2, F.concat(F.lit("<think>{\n x</think>\n"), "t")).when(F.col("k") == 3, ready).otherwise(F.col("t"))
    shaped = parts.select("doc_id", F.from_json(R.in_shape(reply, SHAPE), "title string, description string").alias("s"))
    return shaped.select("doc_id", "s.title", F.md5("s.description").alias("description"))
