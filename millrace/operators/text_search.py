"""Line-oriented search over a table of files: grep, context, word counts, uniq, ranges, heads.

`documents` stands for the file tree: one row is a file, its lines are exploded with their numbers.
Plans made from shell commands are in millrace.plans.shell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.sqltools import sql_query
from millrace.plans.registry import query
from millrace.plans.shell import run_command
from millrace.session import table

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents"


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("i"), "line")


@query(f"SELECT doc_id, i, line FROM ({_LINES}) WHERE regexp_matches(line, 'thin[a-z]+ed')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).where(F.col("line").rlike("thin[a-z]+ed"))


@query(f"SELECT doc_id, count(*) AS n FROM ({_LINES}) WHERE contains(lower(line), 'stupid') GROUP BY 1")
def grep_count_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).where(F.lower("line").contains("stupid")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, i, line, hit FROM (SELECT doc_id, i, line, hit, max(hit::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) near FROM (
  SELECT *, regexp_matches(line, 'disgusting|worthless') hit FROM (""" + _LINES + """))) WHERE near = 1""")
def line_grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching lines with one line of context on each side."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("disgusting|worthless"))
    hit = F.col("line").rlike("disgusting|worthless")
    near = Window.partitionBy("doc_id").orderBy("i").rowsBetween(-1, 1)
    return lines(docs).withColumn("hit", hit).withColumn("near", F.max(F.col("hit").cast("int")).over(near)).where("near = 1").drop("near")


@query(r"""
SELECT doc_id, CAST(sum(nl) AS bigint) AS newlines, CAST(sum(w) AS bigint) AS words, CAST(sum(b) AS bigint) AS bytes_ FROM (
  SELECT doc_id, length(text) - length(replace(text, chr(10), '')) nl, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) w, strlen(text) b FROM documents) GROUP BY ROLLUP (doc_id)""")
def wc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each file and a total row."""
    each = table(spark, sf_dir, "documents").select(
        "doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint").alias("nl"),
        F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("bigint").alias("w"), F.octet_length("text").cast("bigint").alias("b"),
    )
    return each.rollup("doc_id").agg(F.sum("nl").alias("newlines"), F.sum("w").alias("words"), F.sum("b").alias("bytes_"))


sql_query("uniq_c", "events", """
WITH marked AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events)
SELECT user_id, g, min(event_type) AS line, count(*) AS n FROM (SELECT user_id, event_type, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM marked) GROUP BY 1, 2""", """
WITH marked AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events)
SELECT user_id, CAST(g AS bigint) AS g, min(event_type) AS line, count(*) AS n FROM (SELECT user_id, event_type, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM marked) GROUP BY 1, 2""", doc="Consecutive equal lines counted.")


@query(f"SELECT doc_id, i, line FROM ({_LINES}) WHERE i BETWEEN 2 AND 4")
def read_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sed -n 2,4p` of every file: the range is cut from the array before it is exploded."""
    part = F.slice(F.split("text", "\n"), 2, 3)
    got = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(part).alias("p", "line"))
    return got.select("doc_id", (F.col("p") + 2).cast("bigint").alias("i"), "line")


@query(f"SELECT doc_id, i, line FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) n FROM ({_LINES})) WHERE i > n - 2")
def read_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    last = F.slice("l", F.greatest(F.size("l") - 1, F.lit(1)), 2)
    got = got.select("doc_id", F.size("l").alias("n"), F.posexplode(last).alias("p", "line"))
    return got.select("doc_id", (F.greatest(F.col("n") - 2, F.lit(0)) + F.col("p") + 1).cast("bigint").alias("i"), "line")


@query("SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/([^/?]+)', 1) AS dir, count(*) OVER (PARTITION BY regexp_extract(url, '^https?://[^/]+/([^/?]+)', 1)) AS n FROM pages WHERE url LIKE '%.html'")
def find_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`find -name '*.html'` grouped by top directory."""
    top = F.regexp_extract("url", "^https?://[^/]+/([^/?]+)", 1)
    return table(spark, sf_dir, "pages").where(F.col("url").endswith(".html")).groupBy(top.alias("dir")).agg(F.count("*").alias("n"))


@query("""
SELECT path, n FROM (SELECT 'd/' || source || '/' || doc_id || '.txt' AS path, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'idiot|moron'))) AS n FROM documents) WHERE n > 0""")
def shell_grep_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shell command planned and run as a DataFrame: `grep -rcE 'idiot|moron' d`, files with hits."""
    path = F.concat(F.lit("d/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    files = table(spark, sf_dir, "documents").select(path.alias("path"), "text")
    got = run_command(files, "grep -rcE 'idiot|moron' d")
    return got.where("n > 0").select("path", F.col("n").cast("bigint").alias("n"))
