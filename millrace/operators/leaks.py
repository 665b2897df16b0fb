"""Benchmark leaks: containment by word shingles, identifier keys, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.registry import query
from millrace.session import table

MAX_DF, FLOOR, CEILING, SHARE, HALF = 2, 8, 20, 0.8, 0.5
#: Shingles of all items up to this number are broadcast (16 bytes each); beyond it they are joined.
BROADCAST = 2_000_000


def hashed_shingles(rows: DataFrame, key: str, k: int = 8) -> DataFrame:
    """(key, s): a 64-bit hash of every run of k words, repeated runs too. Words are hashed once, runs over the hashes, so no run is ever a string."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")

    def runs(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
        return F.when(F.size(h) >= k, each).otherwise(F.array().cast("array<bigint>"))

    return rows.select(key, F.explode(T.let(F.transform(words, lambda w: F.xxhash64(w)), runs)).alias("s"))


def containment(docs: DataFrame, items: DataFrame, group: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n, size): items of which a document holds enough 8-word shingles.

    Shingles that more than MAX_DF groups of items share are boilerplate and dropped. The items are few beside the documents: their shingles
    are counted, and broadcast where the number allows, so that the documents' shingles meet them where they are made and only hits are shuffled.
    """
    own = hashed_shingles(items, "item_id").distinct()
    if group != "item_id":
        own = own.join(items.select("item_id", group), "item_id")
    rare = own.groupBy("s").agg(F.count_distinct(group).alias("df")).where(F.col("df") <= MAX_DF).select("s")
    own = own.select("item_id", "s").join(rare, "s")
    size = own.groupBy("item_id").agg(F.count("*").alias("size"))
    seen = hashed_shingles(docs, "doc_id")
    hits = seen.join(F.broadcast(own) if own.count() <= BROADCAST else own, "s").groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("n"))
    enough = F.greatest(F.lit(float(FLOOR)), F.least(F.lit(float(CEILING)), F.col("size") * SHARE))
    return hits.join(size, "item_id").where((F.col("n") >= enough) & (F.col("n") / F.col("size") >= HALF)).select("doc_id", "item_id", "n", "size")


def keyed_hits(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, match_key): rows that name an item by its normalised id, by a pull request, or by a repository that the item blocks whole.

    rows: (doc_id, iid, keys array<pull request key>, repo); items: (item_id, iid, keys, repo; null where only the item itself is blocked). One
    equality join of each kind, united; the items' side has one row of a key.
    """
    def joined(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        return left.where("k IS NOT NULL").join(right.where("k IS NOT NULL").distinct(), "k").select("doc_id", "item_id", F.lit(name).alias("match_key"))

    by_id = joined(rows.select("doc_id", T.norm_id(F.col("iid")).alias("k")), items.select("item_id", T.norm_id(F.col("iid")).alias("k")), "id")
    by_pr = joined(rows.select("doc_id", F.explode("keys").alias("k")), items.select("item_id", F.explode("keys").alias("k")), "pr")
    by_repo = joined(rows.select("doc_id", T.repo_slug(F.col("repo")).alias("k")), items.select("item_id", T.repo_slug(F.col("repo")).alias("k")), "repo")
    return by_id.unionByName(by_pr).unionByName(by_repo).distinct()


_CONTAINED = """
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') s FROM tok, LATERAL (SELECT unnest(range(1, len(w) - 6)) i) WHERE len(w) >= 8),
bt AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') s FROM bt, LATERAL (SELECT unnest(range(1, len(w) - 6)) i) WHERE len(w) >= 8),
kept AS (SELECT * FROM bs WHERE s IN (SELECT s FROM bs GROUP BY s HAVING count(*) <= 2)),
size AS (SELECT item_id, count(*) size FROM kept GROUP BY 1),
hits AS (SELECT doc_id, item_id, count(DISTINCT s) n FROM ds JOIN kept USING (s) GROUP BY 1, 2),
found AS (SELECT doc_id, item_id, n, size FROM hits JOIN size USING (item_id)
  WHERE n >= greatest(8.0, least(20.0, size * 0.8)) AND n / size >= 0.5)
"""


@query(_CONTAINED + "SELECT doc_id, item_id, n, size FROM found")
def leak_text_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def multi_key(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, match_key): one join per key, united, instead of a disjunction in one join."""
    by_id = docs.join(items, docs.doc_id == items.item_id).select("doc_id", "item_id", F.lit("id").alias("match_key"))
    exact_d = docs.select("doc_id", F.sha2(T.norm_text(F.col("text")), 256).alias("k"))
    exact_i = items.select("item_id", F.sha2(T.norm_text(F.col("text")), 256).alias("k"))
    by_hash = exact_d.join(exact_i, "k").select("doc_id", "item_id", F.lit("hash").alias("match_key"))
    by_text = containment(docs, items).select("doc_id", "item_id", F.lit("text").alias("match_key"))
    return by_id.unionByName(by_hash).unionByName(by_text).distinct()


_MULTI = _CONTAINED + """, hits3 AS (
SELECT doc_id, item_id, 'id' match_key FROM documents d JOIN benchmark b ON d.doc_id = b.item_id
UNION SELECT d.doc_id, b.item_id, 'hash' FROM documents d JOIN benchmark b ON array_to_string(regexp_extract_all(lower(d.text), '[a-z0-9]+'), ' ') = array_to_string(regexp_extract_all(lower(b.text), '[a-z0-9]+'), ' ')
UNION SELECT doc_id, item_id, 'text' FROM found)
"""


@query(_MULTI + "SELECT * FROM hits3")
def leak_multi_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_key(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(_MULTI + "SELECT item_id, match_key, count(DISTINCT doc_id) docs FROM hits3 GROUP BY GROUPING SETS ((item_id), (item_id, match_key), ())")
def leak_report_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    multi_key(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).createOrReplaceTempView("leak_hits")
    return spark.sql("SELECT item_id, match_key, count(DISTINCT doc_id) AS docs FROM leak_hits GROUP BY GROUPING SETS ((item_id), (item_id, match_key), ())")


@query(_MULTI + "SELECT doc_id, string_agg(item_id || ':' || match_key, ',' ORDER BY item_id, match_key) AS hits FROM hits3 GROUP BY doc_id")
def leak_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leaked document with its sorted hits, as the report file holds them."""
    hits = multi_key(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    own = F.array_sort(F.collect_set(F.struct("item_id", "match_key")))
    return hits.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["match_key"])), ",").alias("hits"))


@query("""
WITH d AS (SELECT doc_id, lower(trim('Own__' || source || '-' || doc_id)) AS i, 'own-' || source || '#' || doc_id AS p, 'own-' || source AS r FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, 'own__src' || item_id % 20 || '-' || item_id AS i, 'own-src' || item_id % 20 || '#' || item_id + 1 AS p, CASE WHEN item_id % 9 = 0 THEN 'own-src' || item_id % 20 END AS r FROM benchmark)
SELECT doc_id, item_id, 'id' AS match_key FROM d JOIN b ON d.i = b.i UNION SELECT doc_id, item_id, 'pr' FROM d JOIN b ON d.p = b.p UNION SELECT doc_id, item_id, 'repo' FROM d JOIN b ON d.r = b.r""")
def leak_pr_and_id_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY JN16, JN17: hits by normalised id, pull request or blocked repository."""
    doc, item = F.col("doc_id").cast("string"), F.col("item_id")
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.concat(F.lit(" Own__"), "source", F.lit("-"), doc, F.lit("_interface")).alias("iid"), F.array(T.pr_key(F.concat(F.lit("Own/"), "source"), F.col("doc_id"))).alias("keys"), F.concat(F.lit("own/"), "source").alias("repo"))
    repo = F.concat(F.lit("own/src"), (item % 20).cast("string"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("own__src"), (item % 20).cast("string"), F.lit("-"), item.cast("string")).alias("iid"), F.array(T.pr_key(repo, item + 1)).alias("keys"), F.when(item % 9 == 0, repo).alias("repo"))
    return keyed_hits(d, b)


@query("""
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') s FROM tok, LATERAL (SELECT unnest(range(1, len(w) - 6)) i) WHERE len(w) >= 8),
bt AS (SELECT item_id * 10 + k AS item_id, item_id AS g, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM benchmark, (SELECT unnest([0, 1, 2]) AS k)),
bs AS (SELECT DISTINCT item_id, g, array_to_string(w[i:i+7], ' ') s FROM bt, LATERAL (SELECT unnest(range(1, len(w) - 6)) i) WHERE len(w) >= 8),
kept AS (SELECT * FROM bs WHERE s IN (SELECT s FROM bs GROUP BY s HAVING count(DISTINCT g) <= 2)),
size AS (SELECT item_id, count(*) size FROM kept GROUP BY 1),
hits AS (SELECT doc_id, item_id, count(DISTINCT s) n FROM ds JOIN kept USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n, size FROM hits JOIN size USING (item_id) WHERE n >= greatest(8.0, least(20.0, size * 0.8)) AND n / size >= 0.5""")
def leak_containment_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY JN18: containment where items come in groups, here three copies of each; what one group shares isn't boilerplate."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("g"), "text", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k")).select((F.col("g") * 10 + F.col("k")).alias("item_id"), "g", "text")
    return containment(table(spark, sf_dir, "documents"), items, "g")
