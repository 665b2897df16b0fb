"""Observations and commands: formats, bodies, return codes, expectations and checks.

The driver's tables hold no shell sessions, so `SESSIONS` makes one exchange out of each document, in
SQL that both engines read alike; the operators are the Column builders of `functions.observations`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import observations as O
from millrace.plans.registry import query
from millrace.session import views

SESSIONS = """
SELECT doc_id, CASE doc_id % 20
  WHEN 0 THEN 'cat src/a.py' WHEN 1 THEN 'cd /repo && grep -rn foo . | head -5' WHEN 2 THEN 'sed -n ' || chr(39) || '3,7p' || chr(39) || ' src/a.py'
  WHEN 3 THEN 'echo hello > out.txt' WHEN 4 THEN 'python -m pytest tests' WHEN 5 THEN 'ls -la && cat missing.txt' WHEN 6 THEN 'git status'
  WHEN 7 THEN 'pip install requests' WHEN 8 THEN 'tail -n 3 src/b.py' WHEN 9 THEN 'rm -rf build && mkdir build' WHEN 10 THEN 'cat src/a.py | grep -v x'
  WHEN 11 THEN 'find . -name ' || chr(39) || '*.py' || chr(39) WHEN 12 THEN 'echo DONE; ls' WHEN 13 THEN 'sed -i ' || chr(39) || 's/a/b/' || chr(39) || ' src/a.py'
  WHEN 14 THEN 'python run.py' WHEN 15 THEN 'cat -n src/c.py' WHEN 16 THEN '' WHEN 17 THEN 'cd src && python -m tools.lint' WHEN 18 THEN 'bash: foo: command not found' ELSE 'head -2 src/a.py' END AS command,
CASE doc_id % 9
  WHEN 0 THEN '<returncode>0</returncode>' || chr(10) || '<output>' || chr(10) || text || chr(10) || '</output>'
  WHEN 1 THEN 'OBSERVATION:' || chr(10) || text
  WHEN 2 THEN text || chr(10) || '[The command completed with exit code 0.]' || chr(10) || '[Current working directory: /repo]' || chr(10) || '[Command finished with exit code 0]'
  WHEN 3 THEN '<returncode>0</returncode>' || chr(10) || '<output>' || chr(10) || 'bash: foo: command not found' || chr(10) || '</output>'
  WHEN 4 THEN ''
  WHEN 5 THEN '<returncode>0</returncode>' || chr(10) || '<output>' || chr(10) || text || chr(10) || 'cat: missing.txt: No such file or directory' || chr(10) || '</output>'
  WHEN 6 THEN 'THOUGHT: now' || chr(10) || text
  WHEN 7 THEN 'Let me look at it.' || chr(10) || text
  ELSE '<returncode>1</returncode>' || chr(10) || '<output>' || chr(10) || '</output>' END AS raw
FROM documents"""

_TRIM = r"regexp_replace({0}, '^\s+|\s+\z', '', 'g')"
_BODY = rf"""
s AS ({SESSIONS}),
f AS (SELECT *, CASE WHEN starts_with(ltrim(raw, ' ' || chr(9) || chr(10) || chr(13)), '<returncode>') THEN 'returncode' WHEN starts_with(ltrim(raw, ' ' || chr(9) || chr(10) || chr(13)), 'OBSERVATION:') THEN 'swe_agent' ELSE 'openhands' END AS fmt,
  regexp_replace(regexp_replace(raw, '\s+\z', ''), '^\n+', '') AS outer_, {_TRIM.format('raw')} AS bare FROM s),
b AS (SELECT *, CASE fmt
  WHEN 'returncode' THEN regexp_replace(regexp_extract(outer_, '(?s)<output>\n(.*)</output>', 1), '\n\z', '')
  WHEN 'swe_agent' THEN trim(substr(outer_, 13), chr(10))
  ELSE trim(array_to_string(list_filter(string_split(outer_, chr(10)), lambda x: NOT regexp_matches(x, '^\s*\[(?:The command (?:completed|finished|timed out)|Current working directory|Python interpreter|Command finished)\b.*\]\s*\z')), chr(10)), chr(10)) END AS body FROM f),
g AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS filled,
  coalesce(try_cast(nullif(regexp_extract(raw, '<returncode>\s*(-?\d+)\s*</returncode>', 1), '') AS int), try_cast(nullif(regexp_extract(raw, '\[Command finished with exit code (-?\d+)\]', 1), '') AS int)) AS rc,
  regexp_replace({_TRIM.format('command')}, '^\s*cd\s+\S+\s*&&\s*', '') AS own FROM b)
"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, command, raw, fmt, body) of the stand-in exchanges."""
    views(spark, sf_dir, "documents")
    made = spark.sql(SESSIONS).withColumn("fmt", O.classify(F.col("raw")))
    return made.withColumn("body", O.body(F.col("raw"), F.col("fmt")))


@query(rf"""
WITH {_BODY}
SELECT doc_id, fmt, CASE fmt WHEN 'returncode' THEN bare LIKE '<returncode>%' AND contains(bare, '</returncode>') AND contains(bare, '<output>' || chr(10)) AND ends_with(bare, chr(10) || '</output>')
  WHEN 'swe_agent' THEN true ELSE bare <> '' END AS valid, md5(body) AS body, rc FROM g""")
def observation_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS19, FS21, FS22, FS24: format, validity, body and status of each observation."""
    c = F.col
    return sessions(spark, sf_dir).select("doc_id", "fmt", O.valid_output(c("raw"), c("fmt")).alias("valid"), F.md5("body").alias("body"), O.returncode(c("raw")).alias("rc"))


@query(r"""
WITH t AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS m FROM conversations WHERE role IS NOT NULL GROUP BY 1),
f AS (SELECT conv_id, m, list_position(list_transform(m, lambda x: x.role), 'assistant') AS a FROM t),
n AS (SELECT conv_id, CASE WHEN a > 0 THEN list_filter(m, lambda x, i: i > a AND x.role IN ('user', 'tool') AND trim(coalesce(x.text, '')) <> '')[1] END AS first FROM f)
SELECT conv_id, CASE WHEN first IS NULL THEN CASE WHEN conv_id % 2 = 0 THEN 'returncode' ELSE 'openhands' END WHEN ltrim(first.text) LIKE '<returncode>%' THEN 'returncode' WHEN ltrim(first.text) LIKE 'OBSERVATION:%' THEN 'swe_agent' ELSE 'openhands' END AS fmt FROM n""")
def conversation_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS20: format of a conversation by its first environment turn, else by its id."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role IS NOT NULL")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    name = F.when(F.col("conv_id") % 2 == 0, "Mini-Coder-1").otherwise("other-1")
    return rows.groupBy("conv_id").agg(turns.alias("m")).select("conv_id", O.detect_format(name, F.col("m")).alias("fmt"))


@query(rf"""
WITH {_BODY},
k AS (SELECT *, CASE WHEN regexp_matches({_TRIM.format("list_last(string_split_regex(own, '&&|;'))")}, '\|\s*(?:head|tail)\b[^|&;]*\z') THEN 0
  WHEN list_contains(list_transform(regexp_extract_all(command, '[\w./-]+'), lambda w: list_last(string_split(w, '/'))), 'cat') AND regexp_matches(coalesce(list_last(filled), ''), '^cat: .*?No such file or directory\z') THEN 1 END AS code FROM g)
SELECT doc_id, md5(CASE WHEN fmt = 'returncode' AND code IS NOT NULL AND code <> rc THEN regexp_replace(raw, '<returncode>-?\d+</returncode>', '<returncode>' || code || '</returncode>') ELSE raw END) AS corrected,
  fmt = 'returncode' AND rc = 0 AND NOT regexp_matches({_TRIM.format("list_last(string_split_regex(own, '&&|;'))")}, '\|\s*(?:head|tail)\b[^|&;]*\z') AND coalesce(filled[1], '') LIKE 'bash: %command not found%' AS impossible FROM k""")
def return_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS25, FS26: statuses that the shell can't have given, put right, and errors beside success."""
    c, args = F.col, (F.col("raw"), F.col("fmt"), F.col("command"))
    return sessions(spark, sf_dir).select("doc_id", F.md5(O.correct_returncode(*args)).alias("corrected"), O.impossible_success(*args).alias("impossible"))


@query(rf"""
WITH {_BODY},
p AS (SELECT *, list_filter(list_transform(string_split_regex(own, '&&|\|\||;|\n'), lambda s: {_TRIM.format('s')}), lambda s: s <> '') AS parts, regexp_replace(own, '''[^'']*''', '''''', 'g') AS plain FROM g)
SELECT doc_id, CASE WHEN own = '' OR regexp_matches(own, '(?:^|[^0-9<>])>>?[ \t]*\S') OR regexp_matches(own, '\|[ \t]*(?:grep|rg|awk|find|comm|diff|uniq)\b') THEN 'may_be_silent'
  WHEN regexp_matches(own, '^(?:git\s+(?:log|show|status|branch)|ls|pwd|tree)\b|^echo\s+\S') OR len(list_filter(parts, lambda s: regexp_matches(s, '^(?:cat|nl|head|tail|less|more|sed\s+-n)\b') AND regexp_matches(s, '[\w./-]*[./][\w./-]+'))) > 0 THEN 'must_print'
  WHEN regexp_matches(own, '^(?:sed\s+-i|rm|mkdir|grep|find)\b') THEN 'may_be_silent' ELSE 'not_derivable' END AS expected,
  len(parts) > 0 AND len(list_filter(parts, lambda s: NOT regexp_matches(s, '^(?:cd|rm|mkdir|sed\s+-i)\b') AND NOT contains(s, '>'))) = 0 AS quiet,
  CASE WHEN own LIKE 'grep -rn foo . | head -5' THEN 5 WHEN own LIKE 'tail -n 3%' THEN 3 WHEN own LIKE 'head -2%' THEN 2 WHEN own LIKE 'sed -n%3,7p%' THEN 5 END AS most,
  CASE WHEN contains(command, 'pip install') THEN 'requests' WHEN contains(command, '-m pytest') THEN 'pytest' WHEN contains(command, '-m tools.lint') THEN 'tools.lint' END AS absent FROM p""")
def command_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS27, FS28, FS31: what a command must print, whether it stays quiet, its cap of lines, the module it lacks."""
    c = F.col("command")
    return sessions(spark, sf_dir).select("doc_id", O.output_expectation(c).alias("expected"), O.prints_nothing(O.without_cd(c)).alias("quiet"), O.line_cap(c)["most"].cast("int").alias("most"), O.absent_tool(c).alias("absent"))


@query(rf"""
WITH {_BODY},
l AS (SELECT *, CASE WHEN body = '' THEN [] ELSE string_split(regexp_replace(body, '\n\z', ''), chr(10)) END AS lines,
  CASE WHEN own LIKE 'grep -rn foo . | head -5' THEN 5 WHEN own LIKE 'tail -n 3%' THEN 3 WHEN own LIKE 'head -2%' THEN 2 WHEN own LIKE 'sed -n%3,7p%' THEN 5 END AS most,
  regexp_matches(raw, '(?i)<warning>|<output_head>|<response clipped>|output of your last command was too long') AS cut FROM g)
SELECT doc_id, CASE WHEN NOT cut AND len(lines) > most THEN 'too_many_lines:' || len(lines) || '>' || most END AS breach,
  md5(CASE WHEN cut OR most IS NULL THEN body WHEN own LIKE 'tail%' THEN array_to_string(lines[-most:], chr(10)) ELSE array_to_string(lines[:most], chr(10)) END) AS kept,
  regexp_matches(coalesce(filled[1], ''), '^(?:I''ll |I will |I need to |Let me |Let''s )') AS narrated, {_TRIM.format('body')} <> '' AND {_TRIM.format('body')} = {_TRIM.format('command')} AS echoed,
  bare LIKE 'THOUGHT:%' AS leaked, {_TRIM.format('body')} = '' AS silent, CASE WHEN rc = 0 AND NOT cut AND command = 'echo DONE; ls' AND NOT contains(body, 'DONE') THEN 'DONE' END AS missing FROM l""")
def observation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS28, FS31: breaches of a cap and their repair; narrated, echoed, leaked and silent output; text that must be there."""
    raw, fmt, command = F.col("raw"), F.col("fmt"), F.col("command")
    return sessions(spark, sf_dir).select(
        "doc_id", O.too_many_lines(raw, fmt, command).alias("breach"), F.md5(O.capped_body(raw, fmt, command)).alias("kept"), O.narrated(raw, fmt).alias("narrated"),
        O.echoed(command, raw).alias("echoed"), O.leaked_turn(raw).alias("leaked"), O.silent(raw).alias("silent"), O.missing_echo(command, raw).alias("missing"),
    )
