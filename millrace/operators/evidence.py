"""Milestones projected for a writer of questions, and results of other places merged into models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.observations import stripped, text_of
from millrace.functions.turns import spans_agree
from millrace.plans.registry import query
from millrace.session import table, views

SHOWN = 3


def distinct_spans(spans: Column, most: int = SHOWN) -> Column:
    """The first `most` filled spans, in order, that agree with none kept before them."""

    def step(kept: Column, span: Column) -> Column:
        known = F.exists(kept, lambda k: spans_agree(F.array(span, k)))
        return F.when((stripped(span) == "") | (F.size(kept) >= most) | known, kept).otherwise(F.array_append(kept, span))

    return F.aggregate(F.coalesce(spans, F.array().cast("array<string>")), F.array().cast("array<string>"), step)


def projected(milestones: DataFrame) -> DataFrame:
    """(task, place, id, earlier, agreed, spans, text) of each milestone: the statements it depends on, in its
    own order, whether all its spans point at the same code, the first spans that differ, and all of it written out.

    milestones: (task, place, id, category, statement, reason, depends_on array, spans array). A milestone may depend on
    several; those that its task lacks, or that state nothing, go. Statements are joined by task and id.
    """
    needs = milestones.select("task", F.col("id").alias("of"), F.posexplode("depends_on").alias("nth", "id"))
    stated = milestones.where("statement <> ''").select("task", "id", "statement")
    earlier = needs.join(stated, ["task", "id"]).groupBy("task", "of").agg(F.array_sort(F.collect_list(F.struct("nth", "statement"))).alias("e"))
    own = milestones.join(earlier.withColumnRenamed("of", "id"), ["task", "id"], "left")
    own = own.withColumn("earlier", F.coalesce(F.transform("e", lambda x: x["statement"]), F.array().cast("array<string>")))
    own = own.withColumn("agreed", spans_agree(F.coalesce("spans", F.array().cast("array<string>")))).withColumn("shown", distinct_spans(F.col("spans")))
    routes = F.when(F.col("agreed"), "the same code").otherwise("DIFFERENT code — name none of it")
    lines = F.concat(
        F.array(
            F.concat(F.lit("MILESTONE "), F.col("place").cast("string"), F.lit(" (id "), F.col("id").cast("string"), F.lit(")")),
            F.concat(F.lit("  CATEGORY: "), text_of(F.col("category"))), F.concat(F.lit("  ACHIEVED: "), text_of(F.col("statement")))),
        F.when(text_of(F.col("reason")) != "", F.array(F.concat(F.lit("  WHY IT IS REQUIRED: "), "reason"))).otherwise(F.array().cast("array<string>")),
        F.transform("earlier", lambda s: F.concat(F.lit("  ALREADY REACHED BEFORE THIS ONE: "), s)),
        F.array(F.concat(F.lit("  ROUTES: the agents reached this through "), routes)),
        F.transform("shown", lambda s: F.concat(F.lit("  WHAT THEY HAD IN FRONT OF THEM:\n"), F.regexp_replace(s, r"(?m)^", "    "))))
    return own.select("task", "place", "id", "earlier", "agreed", F.col("shown").alias("spans"), F.array_join(lines, "\n").alias("text"))


def merged_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """(model, reference, suite, score) of all models: a model's runs, those of a suite that results have for it
    replaced by theirs; and reference models, which results alone name.

    runs: (model, suite, score), model `genesis` or a repository; results: (suite, enabled, reign, model_key, model_repo, score).
    A result of reign 0 is of genesis, one without a reign and a king's key is of a reference, named by its key; of
    a reference that also has results without net only these count. Results of suites that are off, or without key or
    repository, go; those of models without runs too.
    """
    live = results.where("enabled AND model_key <> '' AND model_repo <> ''")
    outside = F.col("reign").isNull() & ~F.col("model_key").startswith("king-")
    bare = F.col("model_key").endswith("-nonet")
    nonet = results.where(outside & bare).select("model_repo", F.lit(True).alias("has_bare")).distinct()
    references = live.where(outside).join(nonet, "model_repo", "left").where(bare | F.col("has_bare").isNull())
    new = live.where(~outside).select(F.when(F.col("reign") == 0, "genesis").otherwise(F.col("model_repo")).alias("model"), "suite", "score")
    known = runs.select("model").distinct()
    kept = runs.join(new.select("model", "suite").distinct(), ["model", "suite"], "left_anti").select("model", "suite", "score")
    models = kept.unionByName(new.join(known, "model", "left_semi")).withColumn("reference", F.lit(False))
    return models.unionByName(references.select(F.col("model_key").alias("model"), "suite", "score").withColumn("reference", F.lit(True))).select("model", "reference", "suite", "score")


def in_sample_order(records: DataFrame, samples: DataFrame) -> DataFrame:
    """records (sample_id, ...) with `position`, that of their sample (sample_id, position), in its order; records of other
    samples go, several records of a sample stay together."""
    return records.join(samples.select("sample_id", "position"), "sample_id").orderBy("position", "sample_id")


_MILESTONES = """
SELECT source AS task, doc_id AS place, doc_id AS id, lang AS category, CASE WHEN n_chars % 5 = 0 THEN '' ELSE {first} END AS statement,
    CASE WHEN n_chars % 3 = 0 THEN {first} END AS reason, {depends} AS depends_on, {spans} AS spans FROM documents"""


@query(f"""
WITH m AS ({_MILESTONES.format(first="regexp_extract(coalesce(text, ''), '(\\w+)', 1)", depends="[doc_id - 1, doc_id - 7, doc_id - n_chars % 50]", spans="list_transform(string_split(coalesce(text, ''), chr(10))[1:6], lambda l: left(l, 60))")}),
s AS (SELECT task, id, nth, span, list_distinct(regexp_extract_all(lower(span), '[a-z_][a-z0-9_]{{2,}}')) AS t FROM (SELECT task, id, generate_subscripts(spans, 1) AS nth, unnest(spans) AS span FROM m) WHERE trim(span, ' ' || chr(9) || chr(13)) <> ''),
j AS (SELECT a.task, a.id, a.nth AS i, b.nth AS j, len(list_intersect(a.t, b.t)) >= 0.6 * greatest(1, len(list_distinct(list_concat(a.t, b.t)))) AS near FROM s a JOIN s b ON a.task = b.task AND a.id = b.id AND a.nth < b.nth),
g AS (SELECT task, id, count(*) >= 2 AS some FROM s GROUP BY ALL),
f AS (SELECT task, id, bool_and(near) AS near FROM j WHERE i = (SELECT min(nth) FROM s WHERE s.task = j.task AND s.id = j.id) GROUP BY ALL),
k0 AS (SELECT task, id, list(nth ORDER BY nth) AS all_, coalesce((SELECT list([i, j]) FROM j WHERE near AND j.task = s.task AND j.id = s.id), []) AS pairs FROM s GROUP BY task, id),
k AS (SELECT task, id, list_reduce(all_, lambda kept, x: CASE WHEN len(kept) > 3 OR len(list_filter(kept, lambda y: list_contains(pairs, [y, x]))) > 0 THEN kept ELSE list_append(kept, x) END, [CAST(-1 AS bigint)]) AS kept FROM k0),
e AS (SELECT n.task, n.of, string_agg(o.statement, '|' ORDER BY n.nth) AS earlier FROM (SELECT task, id AS of, unnest(depends_on) AS id, generate_subscripts(depends_on, 1) AS nth FROM m) n JOIN m o ON o.task = n.task AND o.id = n.id AND o.statement <> '' GROUP BY ALL)
SELECT m.task, m.place, m.id, coalesce(e.earlier, '') AS earlier, coalesce(g.some AND f.near, false) AS agreed, CAST(coalesce(len(k.kept) - 1, 0) AS int) AS n_spans,
    md5(coalesce(array_to_string(list_transform(k.kept[2:], lambda x: m.spans[x]), '|'), '')) AS spans
FROM m LEFT JOIN e ON e.task = m.task AND e.of = m.id LEFT JOIN g ON g.task = m.task AND g.id = m.id LEFT JOIN f ON f.task = m.task AND f.id = m.id LEFT JOIN k ON k.task = m.task AND k.id = m.id""")
def projected_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA11: documents as milestones of their source; their first lines are the spans."""
    views(spark, sf_dir, "documents")
    rows = spark.sql(_MILESTONES.format(first=r"regexp_extract(coalesce(text, ''), '(\\w+)', 1)", depends="array(doc_id - 1, doc_id - 7, doc_id - n_chars % 50)", spans="transform(slice(split(coalesce(text, ''), '\\n'), 1, 6), l -> left(l, 60))"))
    return projected(rows).select("task", "place", "id", F.array_join("earlier", "|").alias("earlier"), "agreed", F.size("spans").alias("n_spans"), F.md5(F.array_join("spans", "|")).alias("spans"))


_RUNS = "SELECT CASE WHEN o_custkey % 97 = 1 THEN 'genesis' ELSE 'repo/' || o_custkey END AS model, o_orderpriority AS suite, round(max(o_totalprice), 2) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2"
_RESULTS = """
SELECT o_orderpriority AS suite, o_orderpriority <> '5-LOW' AS enabled, CASE WHEN o_custkey % 97 = 1 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 7 END AS reign,
    CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 20 THEN c_name || CASE WHEN c_nationkey % 3 = 0 AND o_orderstatus = 'O' THEN '-nonet' ELSE '' END ELSE 'king-' || o_custkey END AS model_key, 'repo/' || o_custkey AS model_repo, round(min(o_totalprice), 2) AS score
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' GROUP BY ALL"""


@query(f"""
WITH r AS ({_RUNS}), d AS ({_RESULTS}), x AS (SELECT *, reign IS NULL AND model_key NOT LIKE 'king-%' AS outside, CASE WHEN reign = 0 THEN 'genesis' ELSE model_repo END AS model FROM d)
SELECT model, false AS reference, suite, score FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.enabled AND NOT x.outside AND x.model = r.model AND x.suite = r.suite)
UNION ALL SELECT model, false, suite, score FROM x WHERE enabled AND NOT outside AND model IN (SELECT model FROM r)
UNION ALL SELECT model_key, true, suite, score FROM x WHERE enabled AND outside AND (model_key LIKE '%-nonet' OR model_repo NOT IN (SELECT model_repo FROM x WHERE outside AND model_key LIKE '%-nonet'))""")
def distributed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY JN24: customers as models, their finished orders as runs, the others as results from elsewhere."""
    views(spark, sf_dir, "orders", "customer")
    return merged_results(spark.sql(_RUNS), spark.sql(_RESULTS))


@query("""
SELECT d.doc_id AS sample_id, l.quality, CAST('0x' || substring(md5(d.doc_id::varchar), 1, 12) AS bigint) AS position FROM documents d JOIN labels l USING (doc_id)""")
def records_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SL11: labels in the order of a sample, which a hash of the ids gives."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), "quality")
    drawn = table(spark, sf_dir, "documents").join(labels.select(F.col("sample_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("sample_id"))
    placed = drawn.select("sample_id", F.conv(F.substring(F.md5(F.col("sample_id").cast("string")), 1, 12), 16, 10).cast("bigint").alias("position"))
    return in_sample_order(labels, placed)
