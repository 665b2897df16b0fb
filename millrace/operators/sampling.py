"""Stratified sampling: apportionment, grids with exact margins, keyed draws under shared limits.

A draw orders the pool by a keyed hash, so it needs no generator, no driver-side pool and no order of
rows. Spark narrows the pool to a few candidates for each stratum, by two rank limits that provably hold
every row a scan of the whole order could take; only those reach the driver, where limits shared
by all strata are met one candidate after the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import table

#: Fixed limits of a draw: rollouts of one repository, characters before the turn, share of other languages in percent.
REPO_CAP, MAX_PREFIX, OTHER_PERCENT = 2, 54_000, 30


def keyed(seed: str, *values: Column | str) -> Column:
    """The keyed hash that orders a draw."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(v).cast("string") if isinstance(v, str) else v for v in values)))


def places(shares: DataFrame, count: Column | int, *within: str) -> DataFrame:
    """shares (name, weight) with `want`: largest remainders, equal ones in the order of names.

    With `within`, every combination of those columns is apportioned on its own. The windows run over the
    names of a sampling plan, never over rows of data.
    """
    every = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    count = F.lit(count) if isinstance(count, int) else count
    exact = shares.withColumn("exact", count * F.col("weight") / F.sum("weight").over(every))
    whole = exact.withColumn("whole", F.floor("exact"))
    turn = F.row_number().over(every.orderBy((F.col("exact") - F.col("whole")).desc(), "name"))
    missing = F.round(count - F.sum("whole").over(every)).cast("bigint")
    return whole.withColumn("want", F.col("whole") + (turn <= missing).cast("bigint")).drop("exact", "whole")


def grid(rows: DataFrame, columns: DataFrame, count: int) -> DataFrame:
    """(row, name, place, want): counts of each cell such that the margins of both sides are apportioned
    (SURVEY SP03). rows is (place, name, weight), columns (name, weight).

    After each row, the cells so far must add up to the apportionment of that many places over the
    columns; a column never gives back what it has, so a cell is the growth of the running maximum.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("place")
    sums = places(rows, count).withColumn("so_far", F.sum("want").over(order)).select(F.col("name").alias("row"), "place", "so_far")
    target = places(sums.crossJoin(columns), F.col("so_far"), "place")  # rows x columns of a plan
    before = Window.partitionBy("name").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.col("want") - F.coalesce(F.max("want").over(before), F.lit(0))
    return target.withColumn("cell", F.greatest(grown, F.lit(0))).select("row", "name", "place", F.col("cell").alias("want"))


def instances(pool: DataFrame, seed: str) -> DataFrame:
    """One rollout of each instance, that with the least keyed hash."""
    h = keyed(seed, "instance", "id")
    return pool.groupBy("instance").agg(F.min_by(F.struct(*pool.columns), F.struct(h, "id")).alias("r")).select("r.*")


def turn_of(phase: Column, first_edit: Column, h: Column) -> Column:
    """Turn to sample in a phase: 1 or 2 for a cold start, two before the first edit, or the edit."""
    coin = F.conv(F.substring(h, -1, 1), 16, 10).cast("int") % 2 + 1
    edit = F.when(first_edit <= 0, 1).when(phase == "pre_edit", F.greatest(first_edit - 2, F.lit(1))).otherwise(first_edit)
    return F.when(phase == "cold", coin).otherwise(edit)


def candidates(pool: DataFrame, wanted: DataFrame, seed: str, total: int) -> DataFrame:
    """The rows of pool that a scan in keyed order could take for each stratum of wanted (phase, family, stratum).

    A repository gives at most REPO_CAP rows, so of its rows of a stratum and kind of language only the
    first REPO_CAP matter. Of what is left, a scan for at most `total` rows passes over at most `total` used
    ones and `total` of spent repositories: the first 3 x total of each kind are enough.
    """
    h = keyed(seed, "id")
    size = F.when(F.col("phase") == "cold", 0).when(F.col("phase") == "at_edit", F.col("chars_at")).otherwise(F.col("chars_pre"))
    rows = pool.join(F.broadcast(wanted), "family").withColumns({"h": h, "foreign": F.col("language") != "python"})
    rows = rows.withColumn("turn", turn_of(F.col("phase"), F.col("first_edit"), F.col("h"))).where((size <= MAX_PREFIX) & (F.col("turns") > F.col("turn")))
    of_repo = Window.partitionBy("stratum", "foreign", "repo").orderBy("h", "id")
    of_kind = Window.partitionBy("stratum", "foreign").orderBy("h", "id")
    few = rows.withColumn("k", F.row_number().over(of_repo)).where(F.col("k") <= REPO_CAP)
    return few.withColumn("k", F.row_number().over(of_kind)).where(F.col("k") <= 3 * total).drop("k")


def taken(found: Iterable[Row], wanted: Sequence[Row]) -> list[Row]:
    """The candidates that are drawn: strata in order, candidates by hash, under the limits shared by all
    strata (SURVEY SP01). Raises where a stratum can't be filled."""
    lines: dict[int, list[Row]] = {}
    for r in sorted(found, key=lambda r: (r.h, r.id)):
        lines.setdefault(r.stratum, []).append(r)
    others = (sum(w.want for w in wanted) * OTHER_PERCENT + 50) // 100
    out: list[Row] = []
    ids: set[str] = set()
    spent: Counter[str] = Counter()
    for w in sorted(wanted, key=lambda w: w.stratum):
        own: list[Row] = []
        for r in lines.get(w.stratum, []):
            if len(own) < w.want and r.id not in ids and spent[r.repo] < REPO_CAP and (others > 0 or not r.foreign):
                own.append(r)
                ids.add(r.id)
                spent[r.repo] += 1
                others -= r.foreign
        if len(own) < w.want:
            raise ValueError(f"{w.phase} {w.family}: {w.want - len(own)} of {w.want} can't be filled")
        out += own
    return out


def sample(pool: DataFrame, phases: DataFrame, families: DataFrame, count: int, seed: str) -> list[Row]:
    """`count` rollouts of pool (id, instance, family, repo, language, turns, first_edit, chars_at, chars_pre)
    with margins by phases (place, name, weight) and families (name, weight); each with its `turn`."""
    cells = grid(phases, families, count)
    stratum = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("place", "name"))
    wanted = cells.select(F.col("row").alias("phase"), F.col("name").alias("family"), "want", stratum.alias("stratum")).collect()
    plan = pool.sparkSession.createDataFrame([(w.phase, w.family, w.stratum) for w in wanted if w.want], "phase string, family string, stratum int")
    return taken(candidates(instances(pool, seed), plan, seed, count).collect(), [w for w in wanted if w.want])


def kept_original(rows: DataFrame, key: str, percent: int, seed: str) -> DataFrame:
    """rows with `kept`: the share of them, rounded half up, with the least keyed hashes.

    Positions need no global sort: hashes fall into 4,096 buckets by their first digits, whole buckets are
    decided by their sums, and only rows of one bucket are ranked.
    """
    own = rows.withColumn("h", keyed(seed, key)).withColumn("bucket", F.substring("h", 1, 3))
    sums = own.groupBy("bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(1)).orderBy("bucket")  # 4,096 rows
    ends = sums.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(1))))
    most = ends.select("bucket", (F.floor((F.col("all") * percent + 50) / 100) - F.col("before")).alias("most"), "n")
    near = own.join(F.broadcast(most), "bucket")
    whole = near.where("most <= 0 OR most >= n").withColumn("kept", F.col("most") > 0)
    part = near.where("most > 0 AND most < n").withColumn("kept", F.row_number().over(Window.partitionBy("bucket").orderBy("h", key)) <= F.col("most"))
    return whole.union(part).drop("h", "bucket", "most", "n")


def even_phases(rows: DataFrame, phase: str, key: str, count: int, seed: str) -> DataFrame:
    """`count` rows, phases as even as they come: first by hash of each phase, then second ones."""
    h = keyed(seed, key)
    own = rows.withColumn("nth", F.row_number().over(Window.partitionBy(phase).orderBy(h, key))).where(F.col("nth") <= count)
    return own.orderBy("nth", phase).limit(count).drop("nth")


def rollouts(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """n samples of each row, numbered by a suffix."""
    return rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("sample_id", F.concat(key, F.lit("#r"), "r")).drop("r")


@query("""
WITH c AS (SELECT o_orderpriority p, count(*) n, 100.0::double * count(*) / sum(count(*)) OVER () exact FROM orders GROUP BY 1),
f AS (SELECT *, floor(exact) fl, row_number() OVER (ORDER BY exact - floor(exact) DESC, p) rk, sum(floor(exact)) OVER () got FROM c)
SELECT p AS priority, CAST(fl + CASE WHEN rk <= 100 - got THEN 1 ELSE 0 END AS bigint) AS want FROM f""")
def apportion_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FM04: 100 places over priorities in proportion to their orders."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("weight"))
    return places(n, 100).select(F.col("name").alias("priority"), "want")


@query("""
WITH r AS (SELECT o_orderpriority nm, count(*) w FROM orders GROUP BY 1), k AS (SELECT c_mktsegment nm, count(*) w FROM customer GROUP BY 1),
re AS (SELECT nm, 100.0::double * w / sum(w) OVER () e FROM r),
rw AS (SELECT nm, CAST(floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, nm) <= 100 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS bigint) want FROM re),
rs AS (SELECT nm, sum(want) OVER (ORDER BY nm) s FROM rw),
ke AS (SELECT rs.nm rn, k.nm cn, s, s * k.w::double / sum(k.w) OVER (PARTITION BY rs.nm) e FROM rs, k),
kw AS (SELECT rn, cn, s, CAST(floor(e) + CASE WHEN row_number() OVER (PARTITION BY rn ORDER BY e - floor(e) DESC, cn) <= s - sum(floor(e)) OVER (PARTITION BY rn) THEN 1 ELSE 0 END AS bigint) t FROM ke)
SELECT rn AS priority, cn AS segment, CAST(greatest(0, t - coalesce(max(t) OVER (PARTITION BY cn ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS bigint) AS want FROM kw""")
def two_way_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SP03: 100 places over priorities and market segments, both margins exact."""
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("weight")).withColumn("place", F.col("name"))
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("weight"))
    return grid(p, s, 100).select(F.col("row").alias("priority"), F.col("name").alias("segment"), "want")


@query("""
SELECT doc_id, source, lang, rk FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) rk FROM (
  SELECT doc_id, source, lang, md5('seed:' || doc_id) h, row_number() OVER (PARTITION BY lang, source ORDER BY md5('seed:' || doc_id), doc_id) pos FROM documents WHERE n_chars <= 54000) WHERE pos <= 2) WHERE rk <= 16""")
def stratified_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SP05 and the hash form of SP01: sixteen of each language, at most two of a source and
    language, by keyed hash. Both rank limits cut each task's rows before they are shuffled."""
    docs = table(spark, sf_dir, "documents").where(F.col("n_chars") <= MAX_PREFIX).select("doc_id", "source", "lang", keyed("seed", "doc_id").alias("h"))
    pos = F.row_number().over(Window.partitionBy("lang", "source").orderBy("h", "doc_id"))
    rk = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    few = docs.withColumn("pos", pos).where(F.col("pos") <= REPO_CAP)
    return few.withColumn("rk", rk).where("rk <= 16").select("doc_id", "source", "lang", "rk")


@query("""
SELECT instance, min_by(id, h) AS id FROM (SELECT doc_id // 2 AS instance, 'd' || doc_id AS id, md5('block:1:' || (doc_id // 2) || ':d' || doc_id) || 'd' || doc_id AS h FROM documents WHERE doc_id IS NOT NULL) GROUP BY 1""")
def one_rollout_per_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SP02: of the rollouts of an instance one is drawn."""
    return instances(document_pool(spark, sf_dir), "block:1").select("instance", "id")


@query("""
WITH o AS (SELECT doc_id, md5('seed:' || doc_id) h FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) k, count(*) OVER () n FROM o)
SELECT doc_id, k <= floor((n * 15 + 50) / 100.0) AS kept FROM r""")
def keep_original_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SP06: 15 percent of all documents keep their original form."""
    return kept_original(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id"), "doc_id", 15, "seed")


@query("""
SELECT doc_id, ['finish', 'submit', 'done', 'exit'][1 + ascii(substr(md5('variant:' || doc_id), 1, 1)) % 4] AS variant FROM documents""")
def seeded_choice_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SP07: each sample takes one of four commands by its own keyed hash."""
    names = F.array(*map(F.lit, ("finish", "submit", "done", "exit")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(names, F.ascii(keyed("variant", "doc_id")) % 4).alias("variant"))


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('sanity:' || doc_id), doc_id) nth FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL)
ORDER BY nth, lang LIMIT 3""")
def sanity_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SP08: three documents, languages as even as they come."""
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang")
    return even_phases(rows, "lang", "doc_id", 3, "sanity")


@query("SELECT doc_id, 'doc' || doc_id || '#r' || r AS sample_id FROM documents, (SELECT unnest([1, 2]) r)")
def rollout_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SP09: two rollouts of each document."""
    return rollouts(table(spark, sf_dir, "documents").select("doc_id"), F.concat(F.lit("doc"), "doc_id"), 2)


@query("SELECT doc_id, 'doc' || doc_id || '#r' || r AS sample_id FROM documents, (SELECT unnest([1, 2]) r)")
def rollout_expansion_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows under the name that the whole expansion had before."""
    return rollout_expansion(spark, sf_dir)


def document_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a pool of rollouts, two of an instance: a stand-in with every column of one."""
    return table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr(
        "'d' || doc_id AS id", "doc_id div 2 AS instance", "element_at(array('pr', 'lm', 'mechanical'), CAST(doc_id div 2 % 3 + 1 AS int)) AS family",
        "source || '/' || CAST(doc_id div 2 % 7 AS string) AS repo", "CASE WHEN lang = 'en' THEN 'python' ELSE lang END AS language",
        "9 AS turns", "CAST(doc_id % 6 AS int) AS first_edit", "n_chars AS chars_at", "n_chars div 2 AS chars_pre",
    )


@query()
def seeded_manifest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SP01: a draw of 12 from all documents; the driver sees at most 3 x 12 candidates of each of
    nine strata and two kinds of language."""
    phases = spark.createDataFrame([(1, "cold", 50), (2, "pre_edit", 30), (3, "at_edit", 20)], "place int, name string, weight int")
    families = spark.createDataFrame([("pr", 40), ("lm", 40), ("mechanical", 20)], "name string, weight int")
    drawn = sample(document_pool(spark, sf_dir), phases, families, 12, "block:1")
    return spark.createDataFrame([(i, f"{r.id}:{r.turn}") for i, r in enumerate(drawn)], "place int, sample_id string")
