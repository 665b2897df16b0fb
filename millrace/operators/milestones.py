"""Milestones and questions: grouping, merging, votes, duplicates, pruning, validation, score columns.

Every function takes DataFrames; the key of a task (`task`) has high cardinality, and what belongs to
one task is a few dozen rows, so windows and arrays by task stay small. The queries use line items as
milestones of an order, three readings of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.observations import stripped, text_of
from millrace.functions.wording import forms
from millrace.plans.registry import query
from millrace.session import table

#: Words that give the reference away; evidence that a category admits, bounds of a vote.
LEAKS = forms("the reference", "milestone/milestones", "vector of change", "the other/strong agent/agents", "the runs/accounts")
UNDECIDED, FIRST_ORDERS, ALL_ORDERS, EARNED, JOIN_AT = (0.2, 0.85), 2, 6, 0.5, 0.55


def exact_groups(items: DataFrame, key: str) -> DataFrame:
    """(task, key, place, members): items (task, pos, key) of equal key, groups in the order first seen."""
    groups = items.groupBy("task", key).agg(F.min("pos").alias("first"), F.sort_array(F.collect_list("pos")).alias("members"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy("first"))).drop("first")


def disjoint_clusters(named: DataFrame, items: DataFrame) -> DataFrame:
    """(task, member, cluster) from named (task, cluster, place, member) over items (task, member): unknown members go, a
    member named twice stays where it was named first, a forgotten one is a cluster of its own, null-keyed (SURVEY SO08)."""
    first = named.join(items, ["task", "member"], "left_semi").groupBy("task", "member").agg(F.min_by("cluster", F.struct("cluster", "place")).alias("cluster"))
    return items.select("task", "member").join(first, ["task", "member"], "left")


def needs_alignment(items: DataFrame, key: str) -> DataFrame:
    """(task, aligned): whether some group of equal key lacks a reading of its task."""
    all_ = items.groupBy("task").agg(F.count_distinct("reading").alias("n"))
    some = items.groupBy("task", key).agg(F.count_distinct("reading").alias("reached"))
    return some.join(all_, "task").groupBy("task").agg(F.bool_or((F.col("n") > 1) & (F.col("reached") < F.col("n"))).alias("needed"))


def merged(items: DataFrame) -> DataFrame:
    """(task, number, representative, runs, depends_on, merged_from): one milestone of each cluster.

    items: (task, reading, pos, of, id, cluster, evidence array<struct<run, step>>, depends_on array<id>). The
    representative is the member whose evidence covers the most runs, earliest on ties; evidence is pooled, one entry of each run;
    dependencies follow the representative's into the new numbers; the order is the mean relative position.
    """
    reach = F.size(F.array_distinct(F.col("evidence.run")))
    own = items.withColumn("rank", F.struct(-reach, "reading", "pos"))
    cluster = own.groupBy("task", "cluster").agg(
        F.avg(F.col("pos") / F.greatest("of", F.lit(1))).alias("at"), F.min_by(F.struct("id", "reading", "depends_on"), "rank").alias("r"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence.run")))).alias("runs"), F.count("*").alias("merged_from"),
    )
    cluster = cluster.withColumn("number", F.row_number().over(Window.partitionBy("task").orderBy("at", "cluster")))
    numbers = items.select("task", "reading", "id", "cluster").join(cluster.select("task", "cluster", "number"), ["task", "cluster"])
    needs = cluster.select("task", "number", F.col("r.reading").alias("reading"), F.explode("r.depends_on").alias("id")).withColumnRenamed("number", "own")
    needs = needs.join(numbers, ["task", "reading", "id"]).where("number <> own").groupBy("task", F.col("own").alias("number")).agg(F.sort_array(F.collect_set("number")).alias("depends_on"))
    return cluster.join(needs, ["task", "number"], "left").select("task", "number", F.col("r.id").alias("representative"), "runs", F.coalesce("depends_on", F.array().cast("array<int>")).alias("depends_on"), "merged_from")


def pair_means(votes: DataFrame) -> DataFrame:
    """(pair, weight, undecided) from votes (pair, nth, vote): the mean of orders 1 and 2, of orders 1 to 6 where that mean is
    undecided; no later order is part of either round, and a pair met only in those has no row (SURVEY SM14)."""
    both = votes.where(F.col("nth") <= ALL_ORDERS).groupBy("pair").agg(F.avg(F.when(F.col("nth") <= FIRST_ORDERS, F.col("vote"))).alias("first"), F.avg("vote").alias("every"))
    undecided = F.coalesce(F.col("first").between(*UNDECIDED), F.lit(False))
    return both.select("pair", F.coalesce(F.when(undecided, F.col("every")).otherwise(F.col("first")), F.lit(0.0)).alias("weight"), undecided.alias("undecided"))


def lead_weights(members: DataFrame, means: DataFrame) -> DataFrame:
    """(task, a, b, weight): every member weighs what its group's first member does; a pair without a mean weighs 0.

    members: (task, member, lead); means: (task, a, b, weight) by first members, in either order.
    """
    left = members.select("task", F.col("member").alias("a"), F.col("lead").alias("la"))
    right = members.select("task", F.col("member").alias("b"), F.col("lead").alias("lb"))
    both = means.select("task", F.col("a").alias("la"), F.col("b").alias("lb"), "weight").union(means.select("task", "b", "a", "weight")).groupBy("task", "la", "lb").agg(F.max("weight").alias("weight"))
    return left.join(right, "task").where("a < b").join(both, ["task", "la", "lb"], "left").select("task", "a", "b", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def dropped_duplicates(pairs: DataFrame) -> DataFrame:
    """(task, dropped): second members of duplicate pairs (task, keep, drop, weight), heaviest pair first; a pair with a member already dropped is skipped."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "keep", "drop")))
    step = lambda gone, p: F.when(F.array_contains(gone, p["keep"]) | F.array_contains(gone, p["drop"]), gone).otherwise(F.array_append(gone, p["drop"]))
    kind = dict(pairs.dtypes)["drop"]
    return pairs.where(F.col("weight") >= JOIN_AT).groupBy("task").agg(order.alias("p")).select("task", F.aggregate("p", F.array().cast(f"array<{kind}>"), step).alias("dropped"))


def pruned(scores: DataFrame) -> DataFrame:
    """(task, question, scored_by): questions that some run earned, with those runs; a question that only unreadable runs could
    have earned stays open and is kept with none (SURVEY SM18). scores: (task, question, run, score; null: unreadable)."""
    earned = F.sort_array(F.collect_set(F.when(F.col("score") >= EARNED, F.col("run"))))
    each = scores.groupBy("task", "question").agg(earned.alias("scored_by"), F.bool_or(F.col("score").isNull()).alias("open"))
    return each.where((F.size("scored_by") > 0) | F.col("open")).select("task", "question", "scored_by")


def without_leaks(questions: DataFrame, text: str) -> DataFrame:
    """Questions that don't mention the reference."""
    return questions.where(~text_of(F.col(text)).rlike(LEAKS))


def haystacks(steps: DataFrame) -> DataFrame:
    """(task, run, kind, text): what a run printed, said outside of code, and wrote inside it. steps: (task, run, step, assistant, observation)."""
    fence = r"(?s)```[^\n]*\n(.*?)(?:```|\z)"
    folded = lambda c: F.regexp_replace(stripped(c), r"\s+", " ")
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", text_of(F.col(c)).alias("x")))), lambda s: s["x"]), " ")
    run = steps.groupBy("task", "run").agg(whole("assistant").alias("a"), whole("observation").alias("o"))
    fenced = F.array_join(F.regexp_extract_all("a", F.lit(fence), F.lit(1)), " ")
    kinds = F.map_from_arrays(F.array(*map(F.lit, ("output", "stated", "code"))), F.array(folded(F.col("o")), folded(F.regexp_replace("a", fence, " ")), folded(fenced)))
    return run.select("task", "run", F.explode(kinds).alias("kind", "text"))


def located(evidence: DataFrame, hay: DataFrame) -> DataFrame:
    """evidence (task, milestone, nth, run, source, span, allowed array<kind>) with found_run and found_kind: where the span occurs in a kind
    that is allowed, the cited run and kind before others; null where it doesn't (SURVEY PF24)."""
    here = hay.select("task", F.col("run").alias("r"), "kind", "text")
    keys = ["task", "milestone", "nth"]
    hits = evidence.join(here, "task").where(F.array_contains("allowed", F.col("kind")) & F.col("text").contains(F.col("span")) & (F.col("span") != ""))
    best = F.struct(F.col("r") != F.col("run"), "r", F.col("kind") != F.col("source"), F.array_position("allowed", F.col("kind")))
    place = hits.groupBy(*keys).agg(F.min_by(F.struct(F.col("r").alias("found_run"), F.col("kind").alias("found_kind")), best).alias("p"))
    return evidence.join(place, keys, "left").select(*evidence.columns, "p.found_run", "p.found_kind")


def verdicts(milestones: DataFrame, placed: DataFrame) -> DataFrame:
    """(task, milestone, reason, consensus, depends_on): null reason for a milestone that stays.

    milestones: (task, milestone, category, necessary, given, depends_on). Dependencies on milestones that go are taken out.
    """
    runs = placed.where("found_run IS NOT NULL").groupBy("task", "milestone").agg(F.sort_array(F.collect_set("found_run")).alias("consensus"))
    reason = F.when(~F.col("necessary") & (F.col("category") != "verification"), "optional").when(F.col("given"), "given_by_task").when(F.col("consensus").isNull(), "unreached")
    judged = milestones.join(runs, ["task", "milestone"], "left").withColumn("reason", reason)
    stay = judged.where("reason IS NULL").groupBy("task").agg(F.collect_set("milestone").alias("stay"))
    return judged.join(stay, "task", "left").select("task", "milestone", "reason", "consensus", F.array_intersect("depends_on", F.coalesce("stay", F.array().cast("array<int>"))).alias("depends_on"))


def earned_columns(questions: Column, earned: Column, run: Column) -> Column:
    """questions array<struct<id, ...>> as (id, earned): whether the run is among those that earned it; null where nothing was recorded."""
    of = lambda q: F.coalesce(F.array_contains(F.try_element_at(earned, q["id"]), run), F.lit(False))
    return F.transform(questions, lambda q: F.struct(q["id"].alias("id"), F.when(earned.isNotNull(), of(q)).alias("earned")))


def zeroed_records(sides: DataFrame, judges: list[str]) -> DataFrame:
    """One record of each judge with no credit for any question, for sides (task, side, questions array<id>, reason) that aren't judged."""
    each = sides.withColumn("judge", F.explode(F.array(*map(F.lit, judges))))
    filled = lambda v: F.map_from_arrays("questions", F.array_repeat(v, F.size("questions")))
    return each.select("task", "side", "judge", filled(F.lit("A")).alias("answers"), filled(F.lit(0.0)).alias("scores"), F.lit(0.0).alias("yes_rate"), F.lit(True).alias("parse_ok"), "reason")


def steps_of(turns: DataFrame) -> DataFrame:
    """(task, step, assistant, observation): each flagged assistant turn with the observation right after it, null without one. turns: (task, turn, role, content, flagged)."""
    following = Window.partitionBy("task").orderBy("turn")
    own = turns.withColumn("next", F.lead(F.struct("role", "content")).over(following))
    seen = F.when(F.col("next.role") != "assistant", F.col("next.content"))
    mine = own.where((F.col("role") == "assistant") & F.col("flagged")).withColumn("step", F.row_number().over(following))
    return mine.select("task", "step", F.col("content").alias("assistant"), seen.alias("observation"))


#: Line items repeat numbers of an order; the stand-ins take one of each.
LINES = """(SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity
  FROM lineitem GROUP BY l_orderkey, l_linenumber) x"""
ITEMS = f"""SELECT l_orderkey AS task, l_linenumber % 3 AS reading, l_linenumber AS id, l_suppkey % 4 AS cluster, l_partkey % 3 AS run, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey, l_linenumber % 3) AS of_ FROM {LINES}"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(f"SELECT * FROM {LINES}")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as milestones: reading by line number, cluster by supplier, one or two runs of evidence, the milestone before as dependency."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    run = F.col("run").cast("int")
    evidence = F.when(F.col("cluster") == 0, F.array(run, (run + 1) % 3)).otherwise(F.array(run))
    return spark.sql(ITEMS).select("task", "reading", "id", "cluster", "pos", F.col("of_").alias("of"), F.transform(evidence, lambda r: F.struct(r.alias("run"), F.lit(1).alias("step"))).alias("evidence"), F.array(F.col("id") - 3).alias("depends_on"))


@query(f"""
WITH g AS (SELECT l_orderkey AS task, l_suppkey % 4 AS key, min(l_linenumber) AS f, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS members FROM {LINES} GROUP BY 1, 2)
SELECT task, key, CAST(row_number() OVER (PARTITION BY task ORDER BY f) AS int) AS place, members FROM g""")
def exact_statement_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SM15, XA12: items of equal text, in the order first seen."""
    rows = lines(spark, sf_dir).selectExpr("l_orderkey AS task", "l_linenumber AS pos", "l_suppkey % 4 AS key")
    return exact_groups(rows, "key").withColumn("members", F.array_join("members", ","))


@query("""
WITH n AS (SELECT l_orderkey AS task, l_linenumber AS member, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 2 END AS cluster FROM lineitem)
SELECT task, member, CAST(min(cluster) AS int) AS cluster FROM n GROUP BY 1, 2""")
def total_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SO08: clusters made total and disjoint; here every third member is forgotten, all are named twice and some are unknown."""
    own = lines(spark, sf_dir).selectExpr("l_orderkey AS task", "l_linenumber AS member")
    named = own.where("member % 3 <> 0").withColumn("cluster", F.explode(F.array(F.col("member") % 2, F.col("member") % 2 + 5))).withColumn("place", F.lit(1))
    unknown = own.selectExpr("task", "member + 100 AS member", "0 AS cluster", "1 AS place")
    return disjoint_clusters(named.unionByName(unknown), own)


@query("""
WITH i AS (SELECT l_orderkey AS task, l_linenumber % 3 AS reading, l_suppkey % 4 AS key FROM lineitem), n AS (SELECT task, count(DISTINCT reading) AS n FROM i GROUP BY 1),
g AS (SELECT task, key, count(DISTINCT reading) AS r FROM i GROUP BY 1, 2)
SELECT task, bool_or(n > 1 AND r < n) AS needed FROM g JOIN n USING (task) GROUP BY 1""")
def alignment_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA13: tasks where exact grouping left a statement that some reading lacks."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS task", "l_linenumber % 3 AS reading", "l_suppkey % 4 AS key")
    return needs_alignment(rows, "key")


@query(f"""
WITH i AS (SELECT *, CASE WHEN cluster = 0 THEN [run, (run + 1) % 3] ELSE [run] END AS ev FROM ({ITEMS})),
c AS (SELECT task, cluster, avg(pos / of_) AS at_, count(*) AS merged_from, arg_min(id, len(ev) * -10000 + reading * 100 + pos) AS rep, arg_min(reading, len(ev) * -10000 + reading * 100 + pos) AS rr FROM i GROUP BY 1, 2),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY task ORDER BY at_, cluster) AS int) AS number FROM c),
e AS (SELECT task, cluster, string_agg(r, ',' ORDER BY r) AS runs FROM (SELECT DISTINCT task, cluster, unnest(ev) AS r FROM i) GROUP BY 1, 2),
d AS (SELECT n.task, n.number, string_agg(DISTINCT m.number, ',') AS dep FROM n JOIN i ON i.task = n.task AND i.id = n.rep - 3 AND i.reading = n.rr JOIN n m ON m.task = i.task AND m.cluster = i.cluster WHERE m.number <> n.number GROUP BY 1, 2)
SELECT task, number, rep AS representative, runs, coalesce(dep, '') AS depends_on, merged_from FROM n JOIN e USING (task, cluster) LEFT JOIN d USING (task, number)""")
def merged_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SM16: readings merged into one vector of milestones."""
    return merged(items(spark, sf_dir)).withColumns({"runs": F.array_join("runs", ","), "depends_on": F.array_join("depends_on", ",")})


@query("""
WITH v AS (SELECT l_partkey AS pair, l_linenumber AS nth, l_discount * 10 AS vote FROM lineitem WHERE l_linenumber <= 6),
m AS (SELECT pair, avg(vote) FILTER (nth <= 2) AS f, avg(vote) AS e FROM v GROUP BY 1)
SELECT pair, round(coalesce(CASE WHEN f BETWEEN 0.2 AND 0.85 THEN e ELSE f END, 0), 9) AS weight, coalesce(f BETWEEN 0.2 AND 0.85, false) AS undecided FROM m""")
def two_round_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SM14: weights of pairs by two rounds of votes."""
    votes = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS pair", "l_linenumber AS nth", "l_discount * 10 AS vote")
    return pair_means(votes).withColumn("weight", F.round("weight", 9))


@query("""
WITH m AS (SELECT l_orderkey AS task, l_linenumber AS member, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey % 2) AS lead_ FROM lineitem),
w AS (SELECT DISTINCT a.task, a.lead_ AS la, b.lead_ AS lb, 0.1 * ((a.lead_ + b.lead_) % 7) AS weight FROM m a JOIN m b ON a.task = b.task AND a.lead_ < b.lead_)
SELECT a.task, a.member AS a, b.member AS b, round(coalesce(w.weight, 0), 6) AS weight FROM m a JOIN m b ON a.task = b.task AND a.member < b.member
LEFT JOIN w ON w.task = a.task AND w.la = least(a.lead_, b.lead_) AND w.lb = greatest(a.lead_, b.lead_)""")
def weights_by_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SM13: pairs of members weighed by the first members of their groups."""
    lead = F.min("l_linenumber").over(Window.partitionBy("l_orderkey", F.col("l_suppkey") % 2))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("member"), lead.alias("lead"))
    firsts = members.select("task", "lead").distinct()
    means = firsts.select("task", F.col("lead").alias("a")).join(firsts.select("task", F.col("lead").alias("b")), "task").where("a < b").selectExpr("task", "a", "b", "0.1D * ((a + b) % 7) AS weight")
    return lead_weights(members, means).withColumn("weight", F.round("weight", 6))


@query("""
WITH p AS (SELECT l_orderkey AS task, l_linenumber AS keep, l_linenumber + 1 AS drop_, l_discount * 10 AS weight FROM lineitem),
r AS (SELECT task, keep, weight, row_number() OVER (PARTITION BY task ORDER BY weight DESC, keep) AS k FROM p WHERE weight >= 0.55),
f AS (SELECT task, list({'keep': keep, 'k': k} ORDER BY k) AS ps FROM r GROUP BY 1),
x AS (SELECT task, list_reduce(list_prepend([]::int[], list_transform(ps, lambda q: [q.keep])), lambda gone, q: CASE WHEN list_contains(gone, q[1]) OR list_contains(gone, q[1] + 1) THEN gone ELSE list_append(gone, q[1] + 1) END) AS gone FROM f)
SELECT task, array_to_string(gone, ',') AS dropped FROM x""")
def heaviest_duplicates_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SM17: duplicates dropped pair by pair, the heaviest first."""
    pairs = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS task", "l_linenumber AS keep", "l_linenumber + 1 AS `drop`", "l_discount * 10 AS weight")
    return dropped_duplicates(pairs).select("task", F.array_join("dropped", ",").alias("dropped"))


@query("""
WITH s AS (SELECT l_orderkey AS task, l_suppkey % 5 AS question, l_linenumber AS run, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount * 10 END AS score FROM lineitem),
e AS (SELECT task, question, coalesce(string_agg(DISTINCT run, ',' ORDER BY run) FILTER (score >= 0.5), '') AS scored_by, bool_or(score IS NULL) AS open_ FROM s GROUP BY 1, 2)
SELECT task, question, scored_by FROM e WHERE scored_by <> '' OR open_""")
def pruned_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SM18: questions that some run earned, or that unreadable runs leave open."""
    scores = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS task", "l_suppkey % 5 AS question", "l_linenumber AS run", "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount * 10 END AS score")
    return pruned(scores).withColumn("scored_by", F.array_join("scored_by", ","))


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '(?i)\bthe reference\b|\bmilestones?\b|\bvector of change\b|\bthe (?:other|strong) agents?\b|\bthe (?:runs|accounts)\b|\bthe\b') OR doc_id % 2 = 0 AND NOT regexp_matches(coalesce(text, ''), '(?i)\bthe reference\b|\bmilestones?\b')")
def reference_leaks_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY PF23: questions that give the reference away go; here texts of odd ids have `the` turned into a leak."""
    text = F.when(F.col("doc_id") % 2 == 1, F.regexp_replace(text_of(F.col("text")), r"(?i)\bthe\b", "the runs")).otherwise(F.col("text"))
    return without_leaks(table(spark, sf_dir, "documents").select("doc_id", text.alias("q")), "q").select("doc_id")


_STEPS = """SELECT conv_id AS task, conv_id % 2 AS run, turn AS step, CASE WHEN role = 'assistant' THEN 'I ran it: ' || chr(10) || '```bash' || chr(10) || 'cmd ' || turn || chr(10) || '```' || chr(10) || text END AS assistant, CASE WHEN role <> 'assistant' THEN text END AS observation FROM conversations WHERE turn IS NOT NULL AND text IS NOT NULL"""


@query(rf"""
WITH s AS ({_STEPS}), j AS (SELECT task, run, string_agg(coalesce(assistant, ''), ' ' ORDER BY step) AS a, string_agg(coalesce(observation, ''), ' ' ORDER BY step) AS o FROM s GROUP BY 1, 2),
k AS (SELECT task, run, unnest(['output', 'stated', 'code']) AS kind, unnest([o, regexp_replace(a, '(?s)```[^\n]*\n(.*?)(?:```|\z)', ' ', 'g'), array_to_string(regexp_extract_all(a, '(?s)```[^\n]*\n(.*?)(?:```|\z)', 1), ' ')]) AS x FROM j)
SELECT task, run, kind, md5(regexp_replace(regexp_replace(x, '^\s+|\s+\z', '', 'g'), '\s+', ' ', 'g')) AS text FROM k""")
def evidence_haystacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA10: search spaces of each run."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return haystacks(spark.sql(_STEPS)).withColumn("text", F.md5("text"))


@query(f"""
WITH m AS (SELECT l_orderkey AS task, l_linenumber AS milestone, CASE l_suppkey % 3 WHEN 0 THEN 'verification' WHEN 1 THEN 'edit' ELSE 'explore' END AS category, l_returnflag <> 'N' AS necessary, l_linestatus = 'F' AND l_quantity > 40 AS given, l_partkey % 4 AS run FROM {LINES}),
f AS (SELECT *, CASE WHEN milestone % 4 = 0 THEN NULL WHEN category = 'verification' THEN 'output' WHEN category = 'edit' THEN 'code' ELSE 'output' END AS kind FROM m),
v AS (SELECT *, CASE WHEN NOT necessary AND category <> 'verification' THEN 'optional' WHEN given THEN 'given_by_task' WHEN kind IS NULL THEN 'unreached' END AS reason FROM f)
SELECT v.task, v.milestone, v.reason, CASE WHEN v.kind IS NOT NULL THEN CASE WHEN run < 2 THEN run ELSE 0 END END AS found_run, v.kind AS found_kind, CASE WHEN EXISTS (SELECT 1 FROM v p WHERE p.task = v.task AND p.milestone = v.milestone - 1 AND p.reason IS NULL) THEN v.milestone - 1 END AS depends_on FROM v""")
def validated_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY PF24: evidence located in the runs, milestones kept or dropped with a reason, dangling dependencies pruned."""
    own = lines(spark, sf_dir).selectExpr(
        "l_orderkey AS task", "l_linenumber AS milestone", "CASE l_suppkey % 3 WHEN 0 THEN 'verification' WHEN 1 THEN 'edit' ELSE 'explore' END AS category", "l_returnflag <> 'N' AS necessary",
        "l_linestatus = 'F' AND l_quantity > 40 AS given", "CAST(l_partkey % 4 AS int) AS run", "array(l_linenumber - 1) AS depends_on",
    )
    allowed = F.when(F.col("category") == "edit", F.array(F.lit("code"))).when(F.col("category") == "explore", F.array(F.lit("output"), F.lit("code"))).otherwise(F.array(F.lit("output")))
    evidence = own.select("task", "milestone", F.lit(1).alias("nth"), "run", F.lit("output").alias("source"), F.when(F.col("milestone") % 4 == 0, "nowhere").otherwise("found").alias("span"), allowed.alias("allowed"))
    hay = own.select("task").distinct().crossJoin(spark.createDataFrame([(0, "output", "is found here"), (0, "code", "found()"), (1, "output", "found"), (1, "code", "found")], "run int, kind string, text string"))
    placed = located(evidence, hay)
    return verdicts(own.drop("run"), placed).join(placed.select("task", "milestone", "found_run", "found_kind"), ["task", "milestone"]).select("task", "milestone", "reason", "found_run", "found_kind", F.get("depends_on", F.lit(0)).alias("depends_on"))


@query("""
SELECT o_orderkey AS task, r AS run, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (CASE WHEN r = 1 THEN 'true' ELSE 'false' END) || ',' || (CASE WHEN r <= 2 THEN 'true' ELSE 'false' END) || ',false' END AS earned FROM orders, (SELECT unnest([1, 2, 3]) AS r)""")
def earned_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA08: which questions each reference run earned; null where an artifact never recorded it."""
    asked = F.expr("array(named_struct('id', 'q1'), named_struct('id', 'q2'), named_struct('id', 'q3'))")
    earned = F.when(F.col("task") % 3 != 0, F.expr("map('q1', array(1), 'q2', array(1, 2))"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run"))
    flags = F.transform(earned_columns(asked, earned, F.col("run")), lambda q: q["earned"].cast("string"))
    return rows.select("task", "run", F.when(earned.isNotNull(), F.array_join(flags, ",")).alias("earned"))


@query("""
SELECT o_orderkey AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'king' ELSE 'challenger' END AS side, j AS judge,
    array_to_string(list_transform(['q1', 'q2', 'q3'][:1 + o_custkey % 3], lambda q: q || '=A'), ',') AS answers, 0.0::double AS yes_rate, true AS parse_ok, o_orderpriority AS reason
FROM orders, (SELECT unnest(['j1', 'j2', 'j3']) AS j)""")
def zeroed_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA14, XA15: records of sides that get no credit without being judged."""
    sides = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS task", "CASE WHEN o_orderkey % 2 = 0 THEN 'king' ELSE 'challenger' END AS side",
        "slice(array('q1', 'q2', 'q3'), 1, 1 + CAST(o_custkey % 3 AS INT)) AS questions", "o_orderpriority AS reason")
    made = zeroed_records(sides, ["j1", "j2", "j3"])
    return made.select("task", "side", "judge", F.array_join(F.transform(F.map_entries("answers"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("answers"), "yes_rate", "parse_ok", "reason")


@query("""
WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE turn IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS task, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS int) AS step, md5(text) AS assistant, md5(CASE WHEN nr <> 'assistant' THEN nt END) AS observation FROM t WHERE role = 'assistant' AND turn % 3 <> 0""")
def flagged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA09: flagged assistant turns with what came back."""
    rows = table(spark, sf_dir, "conversations").where("turn IS NOT NULL").selectExpr("conv_id AS task", "turn", "role", "text AS content", "turn % 3 <> 0 AS flagged")
    return steps_of(rows).withColumns({"assistant": F.md5("assistant"), "observation": F.md5("observation")})
