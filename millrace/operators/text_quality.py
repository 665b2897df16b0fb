"""Text checks and text functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.sqltools import sql_query
from millrace.plans.registry import query
from millrace.session import table

_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"


@query(f"""
WITH t AS (SELECT doc_id, text, {_WORDS.format('text')} w, {_WORDS.format('lower(text)')} lw FROM documents),
d AS (SELECT doc_id, text, len(w) n, len(lw) nl, len(list_distinct(lw)) dl, len(w) - 2 AS tri, len(list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], chr(1))))) AS dt,
  length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS high FROM t)
SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '^[[:space:]]*$') THEN 'empty' WHEN n < 5 THEN 'short' WHEN tri >= 1 AND dt / tri < 0.15 THEN 'repetitive' WHEN length(text) > 20 AND high / length(text) > 0.6 THEN 'encoding' WHEN nl >= 8 AND dl / nl < 0.3 THEN 'vocabulary' END AS reason FROM d""")
def text_quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.quality_reason(F.col("text")).alias("reason"))


sql_query("collapsed_sets", "documents", """
SELECT source, count(*) AS n, (count(*) >= 2 AND count(DISTINCT substring(trim(text), 1, 100)) = 1) AS collapsed, (count(*) >= 2 AND count(DISTINCT n_chars) = 1) AS uniform,
  bool_or(lower(text) LIKE '%return%' OR lower(text) LIKE '%import%') AS code_present FROM documents GROUP BY source""", doc="Set-level checks.")


@query("""
SELECT doc_id, CASE WHEN n >= 10 THEN round(top3 / n, 6) END AS top3_share, (n >= 10 AND top3 / n >= 0.8) AS degenerate FROM (
  SELECT doc_id, sum(c) n, sum(CASE WHEN rk <= 3 THEN c ELSE 0 END) top3 FROM (
    SELECT doc_id, line, count(*) c, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, line) rk FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents) GROUP BY 1, 2) GROUP BY 1)""")
def degenerate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the three commonest lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    each = docs.select("doc_id", F.explode("l").alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("c"))
    top = each.groupBy("doc_id").agg(F.sum("c").alias("n"), F.slice(F.reverse(F.array_sort(F.collect_list("c"))), 1, 3).alias("best"))
    share = F.aggregate("best", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.col("n")
    return top.select("doc_id", F.when(F.col("n") >= 10, F.round(share, 6)).alias("top3_share"), ((F.col("n") >= 10) & (share >= 0.8)).alias("degenerate"))


@query("""
WITH l AS (SELECT doc_id, i, line, lag(line, 1) OVER w a, lag(line, 2) OVER w b, lag(line, 3) OVER w c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS stutters FROM l WHERE line <> '' AND ((line = a AND a = b) OR (line = a AND b = c AND a <> b)) GROUP BY 1""")
def stutter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three equal lines in a row, or A A B B; neighbours are compared inside the row, so nothing is shuffled."""
    n = F.size("l")
    at = lambda i, k: F.try_element_at(F.col("l"), i - k)

    def bad(i):
        x, a, b, c = at(i, 0), at(i, 1), F.when(i > 2, at(i, F.least(F.lit(2), i - 1))), F.when(i > 3, at(i, F.least(F.lit(3), i - 1)))
        return F.coalesce((x != "") & (x == a) & ((a == b) | ((b == c) & (a != b))), F.lit(False))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    hits = F.size(F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), bad))
    return docs.where(n >= 3).select("doc_id", hits.cast("bigint").alias("stutters")).where("stutters > 0")


@query("""
SELECT doc_id, string_agg(p, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, i, p FROM (SELECT doc_id, i, p, row_number() OVER (PARTITION BY doc_id, p ORDER BY i) rn FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) p, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents)) WHERE rn = 1 OR p = '') GROUP BY 1""")
def paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs dropped, the first of each kept in place; all inside the row."""
    p = F.split("text", "\n")
    kept = F.filter(F.col("p"), lambda x, i: (x == "") | (F.array_position(F.col("p"), x) == i + 1))
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("p")).select("doc_id", F.array_join(kept, "\n").alias("text"))


@query("""
SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS asst, min(turn) FILTER (role = 'assistant') AS first_asst, arg_min(left(text, 40), turn) FILTER (role = 'user') AS first_user FROM conversations GROUP BY 1""")
def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as an array, and facts read off it with higher-order functions."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")
    asst = F.filter("m", lambda x: x["role"] == "assistant")
    user = F.filter("m", lambda x: x["role"] == "user")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns).select(
        "conv_id", F.size("m").cast("bigint").alias("turns"), F.size(asst).cast("bigint").alias("asst"), F.try_element_at(asst, F.lit(1))["turn"].alias("first_asst"), F.substring(F.try_element_at(user, F.lit(1))["text"], 1, 40).alias("first_user")
    )


@query("""
WITH m AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) k FROM conversations),
t AS (SELECT conv_id, min(turn) target FROM m WHERE k = 2 GROUP BY 1)
SELECT conv_id, target, count(*) FILTER (turn < target) AS prefix_turns, CAST(coalesce(sum(length(text)) FILTER (turn < target), 0) AS bigint) AS prefix_chars FROM conversations JOIN t USING (conv_id) GROUP BY 1, 2""")
def prefix_slice_nth_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes before the second assistant turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("bigint").alias("n")))).alias("m")
    target = F.try_element_at(F.filter("m", lambda x: x["role"] == "assistant"), F.lit(2))["turn"]
    got = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns).withColumn("target", target).where("target IS NOT NULL")
    before = F.filter("m", lambda x: x["turn"] < F.col("target"))
    return got.select("conv_id", "target", F.size(before).cast("bigint").alias("prefix_turns"), F.aggregate(before, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("prefix_chars"))


@query(r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page_no FROM pages""")
def url_and_id_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part(r"^https?://([^/]+)").alias("host"), part(r"^https?://[^/]+(/[^?#]*)").alias("path"), part(r"[?&]page=([0-9]+)").alias("page_no"))


@query(r"""
SELECT doc_id, CASE WHEN iid LIKE '%\_interface' ESCAPE '\' THEN left(iid, length(iid) - 10) ELSE iid END AS norm, trim(regexp_replace(iid, '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  CASE doc_id % 4 WHEN 0 THEN 'Own.Er/' || source WHEN 1 THEN NULL ELSE 'own/' || source END AS repo, CASE doc_id % 4 WHEN 0 THEN doc_id WHEN 2 THEN doc_id WHEN 3 THEN doc_id END AS number FROM (
  SELECT doc_id, source, lower(trim(CASE doc_id % 4 WHEN 0 THEN 'Own.Er__' || source || '-' || doc_id WHEN 1 THEN 'no id ' || doc_id || '_interface' WHEN 2 THEN 'own__' || source || '.1234abcd.pr_' || doc_id ELSE 'own__' || source || '-' || doc_id || '_x' END)) iid FROM documents)""")
def identifier_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in three grammars: normal form, slug, repository and number."""
    doc, src = F.col("doc_id"), F.col("source")
    raw = (
        F.when(doc % 4 == 0, F.concat(F.lit("Own.Er__"), src, F.lit("-"), doc)).when(doc % 4 == 1, F.concat(F.lit("no id "), doc, F.lit("_interface")))
        .when(doc % 4 == 2, F.concat(F.lit("own__"), src, F.lit(".1234abcd.pr_"), doc)).otherwise(F.concat(F.lit("own__"), src, F.lit("-"), doc, F.lit("_x")))
    )
    got = table(spark, sf_dir, "documents").select("doc_id", raw.alias("iid"))
    slug = F.regexp_replace(F.regexp_replace(F.lower("iid"), "[^a-z0-9]+", "-"), "^-|-$", "")
    parsed = T.parse_id(F.col("iid"))
    return got.select("doc_id", T.norm_id(F.col("iid")).alias("norm"), slug.alias("slug"), parsed["repo"].alias("repo"), parsed["number"].alias("number"))


@query("SELECT doc_id, sha1(concat('blob ', strlen(text), chr(0), text)) AS blob, sha256(text) AS content FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.blob_sha1(F.col("text")).alias("blob"), F.sha2("text", 256).alias("content"))


@query(r"""
SELECT doc_id, CAST(length(text) - length(replace(text, ' ', '')) AS bigint) AS spaces, len(regexp_extract_all(text, '[.!?](?:\s|$)')) AS sentences, starts_with(lower(text), 'the ') AS preamble, replace(left(text, 30), chr(10), ' ') AS head FROM documents""")
def preamble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("bigint").alias("spaces"), F.regexp_count("text", F.lit(r"[.!?](?:\s|$)")).cast("bigint").alias("sentences"),
        F.lower("text").startswith("the ").alias("preamble"), F.replace(F.substring("text", 1, 30), F.lit("\n"), F.lit(" ")).alias("head"),
    )
