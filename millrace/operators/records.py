"""Records of services: aliases, faults, quotas, headers, usage, manifests, loaders, artifacts, queues.

Functions take Columns or DataFrames; the queries apply them to stand-ins built from the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.registry import query
from millrace.session import table

#: Fault classes, fields of a manifest and of the JSON dialect of observations, categories of artifacts.
RETRYABLE, FINAL, UNKNOWN = ("infra", "remote_eval", "provider", "unknown"), "miner", "unknown"
MANIFEST_FIELDS = ("digest", "files", "version")
DIALECT_FIELDS = ("output", "returncode")
PR_URL = r"github\.com/([^/]+/[^/]+)/pull/(\d+)"


def picked(body: Column, *keys: str) -> Column:
    """The first of a JSON object's keys that has a value."""
    return F.coalesce(*(F.get_json_object(body, f"$.{k}") for k in keys))


def fault(kind: Column, retryable: Column) -> Column:
    """struct(kind, retryable): the final class is never retried, the known ones always, any other is unknown and retried."""
    known = F.coalesce(kind, F.lit(UNKNOWN))
    named = F.when(known.isin(FINAL, *RETRYABLE), known).otherwise(UNKNOWN)
    return F.struct(named.alias("kind"), (named != FINAL).alias("retryable"), F.coalesce(retryable, F.lit(True)).alias("stated"))


def quota_breaches(objects: DataFrame, owner: str, size: str, most_bytes: int, most_objects: int) -> DataFrame:
    """(owner, reason): owners over their bytes, else over their count of objects."""
    used = objects.groupBy(owner).agg(F.sum(size).alias("b"), F.count("*").alias("n"))
    reason = F.when(F.col("b") > most_bytes, "bytes").when(F.col("n") > most_objects, "objects")
    return used.withColumn("reason", reason).where("reason IS NOT NULL").select(owner, "reason")


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header, a number or a date; null for anything else."""
    when = F.try_to_timestamp(F.regexp_replace(header, r"^\w+, | GMT\z", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.unix_timestamp(when) - F.unix_timestamp(now)
    wait = F.coalesce(F.trim(header).try_cast("double"), seconds.cast("double"))
    return F.when(wait < 0, 0.0).otherwise(wait)


def nested_length(body: Column) -> Column:
    """Characters of all string values in a JSON text, at any depth; keys don't count."""
    # escapes first, so that a quote can only be an end; possessive, so that long texts don't recurse
    plain = F.regexp_replace(F.coalesce(body, F.lit("")), r"\\(?:u[0-9a-fA-F]{4}|.)", "x")
    own = F.filter(F.regexp_extract_all(plain, F.lit(r'"[^"]*+"\s*+:?'), F.lit(0)), lambda s: s.endswith('"'))
    return F.aggregate(F.transform(own, lambda s: F.length(s) - 2), F.lit(0), lambda a, n: a + n)


def tail_usage(response: Column, tail: int = 4096) -> Column:
    """struct(prompt, completion): the last token counts in the tail of a response, nulls without any."""
    end = F.substring(response, -tail, tail)
    last = lambda name: F.try_element_at(F.regexp_extract_all(end, F.lit(rf'"{name}"\s*:\s*(\d+)'), F.lit(1)), F.lit(-1)).try_cast("bigint")
    return F.struct(last("prompt_tokens").alias("prompt"), last("completion_tokens").alias("completion"))


def device_ids(topology: Column) -> Column:
    """Ids of all devices in a JSON topology of groups."""
    return F.flatten(F.from_json(topology, "struct<groups:array<struct<ids:array<int>>>>")["groups"]["ids"])


def chunked(values: Column, n: int) -> Column:
    """An array cut into arrays of n, the last one shorter."""
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / n).cast("int")), lambda i: F.slice(values, i * n + 1, n))).otherwise(F.slice(F.array(values), 1, 0))


def inferred_rule(stored: Column, rules: dict[str, Column], near: float = 1e-4) -> Column:
    """Name of the first rule whose value reproduces the stored one, null if none does."""
    named = F.lit(None).cast("string")
    for name, value in reversed(rules.items()):
        named = F.when(F.abs(stored - value) < near, name).otherwise(named)
    return named


def pinned_faults(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """(path, fault): pinned files that are missing or have another hash. Both: (path, sha)."""
    got = pinned.join(files.withColumnRenamed("sha", "own"), "path", "left")
    return got.withColumn("fault", F.when(F.col("own").isNull(), "missing").when(F.col("own") != F.col("sha"), "changed")).where("fault IS NOT NULL").select("path", "fault")


def manifest_fault(body: Column) -> Column:
    """First fault of a JSON manifest, null for a sound one: other fields than the fixed ones, a path twice, a digest that the files don't give."""
    keys = F.array_sort(F.json_object_keys(body))
    own = F.from_json(body, "struct<version:int, digest:string, files:array<struct<path:string,size:bigint,sha:string>>>")
    paths = own["files"]["path"]
    told = F.array_join(F.transform(F.array_sort(own["files"]), lambda f: F.concat_ws("\u0000", f["path"], f["size"].cast("string"), f["sha"])), "\n")
    return F.when(~F.coalesce(keys == F.array(*map(F.lit, MANIFEST_FIELDS)), F.lit(False)), "fields").when(F.size(F.array_distinct(paths)) < F.size(paths), "paths").when(F.sha2(told, 256) != own["digest"], "digest")


def artifact_rows(verdicts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(run, name, kind, bucket, key): the artifacts of a verdict (run, artifacts map<name, uri>) that have a known kind. kinds: (name, kind), a fixed small table."""
    from millrace.functions.names import bucket_and_key

    each = verdicts.select("run", F.explode("artifacts").alias("name", "uri")).join(kinds, "name")
    return each.select("run", "name", "kind", bucket_and_key(F.col("uri"))["bucket"].alias("bucket"), bucket_and_key(F.col("uri"))["key"].alias("key"))


def tail_gate(looped: Column, scored: Column, faults: Column, least: int = 16) -> Column:
    """Outcome of a tail check: a loop fails at once, a short conversation is skipped, else any fault of the judge's fails."""
    return F.when(looped, "loop").when(scored <= least, "skipped").when(faults > 0, "failed").otherwise("passed")


def head_gate(answers: Column, least: int) -> Column:
    """Outcome of a head check from its judge's answers: undecided without enough readable ones, else passed if most say yes."""
    readable = F.filter(answers, lambda a: F.lower(F.trim(a)).isin("yes", "no"))
    yes = F.size(F.filter(readable, lambda a: F.lower(F.trim(a)) == "yes"))
    return F.when(F.size(readable) < least, "undecided").when(2 * yes > F.size(readable), "passed").otherwise("failed")


def benchmark_tasks(rows: DataFrame) -> DataFrame:
    """One task of each id: the first row by (split, nth) wins, its splits are collected. rows: (id, repo, text, split, nth)."""
    first = F.min_by(F.struct("repo", "text"), F.struct("split", "nth"))
    return rows.where("id IS NOT NULL").groupBy(T.norm_id(F.col("id")).alias("id")).agg(first.alias("r"), F.array_sort(F.collect_set("split")).alias("splits")).select("id", "r.repo", "r.text", "splits")


def pr_of_url(url: Column) -> Column:
    """Key of the pull request that an address names, null without one."""
    repo, number = F.regexp_extract(url, PR_URL, 1), F.regexp_extract(url, PR_URL, 2)
    return F.when(repo != "", T.pr_key(repo, number.try_cast("bigint")))


def row_pr_keys(iid: Column, repo: Column, number: Column, url: Column) -> Column:
    """All pull request keys of a row, by its id, its fields and its address."""
    parsed = T.parse_id(iid)
    return F.array_distinct(F.array_compact(F.array(T.pr_key(parsed["repo"], parsed["number"]), F.when(number.isNotNull(), T.pr_key(repo, number)), pr_of_url(url))))


def dialect_text(c: Column) -> Column:
    """An observation in the JSON dialect as tagged text, null for anything else: it must have exactly the two fields."""
    exact = F.array_sort(F.json_object_keys(c)) == F.array(*map(F.lit, DIALECT_FIELDS))
    own = F.from_json(c, "struct<returncode:int,output:string>")
    return F.when(F.coalesce(exact, F.lit(False)), F.concat(F.lit("<returncode>"), own["returncode"].cast("string"), F.lit("</returncode>\n<output>\n"), F.coalesce(own["output"], F.lit("")), F.lit("\n</output>")))


def aligned_blocks(document: Column) -> Column:
    """array<struct<candidate, observation>> of a judged document: each candidate block with the observation before the next."""
    label = r"(?m)^(?:CANDIDATE OUTPUT(?: \d+)?|ENVIRONMENT OBSERVATION[^\n]*|CONTEXT [^\n]*):\n------\n"
    kinds = F.transform(F.regexp_extract_all(document, F.lit(label), F.lit(0)), lambda x: F.substring(x, 1, 3))
    bodies = F.transform(F.slice(F.split(document, label), 2, 1 << 30), lambda x: F.regexp_replace(x, r"\n------\s*\z", ""))
    made = F.filter(F.arrays_zip(kinds.alias("k"), bodies.alias("b")), lambda x: x["k"] != "CON")

    def of(m: Column) -> Column:
        following = lambda i: F.get(m, i + 1)
        each = F.transform(m, lambda x, i: F.struct(x["k"].alias("k"), x["b"].alias("candidate"), F.when(following(i)["k"] == "ENV", following(i)["b"]).alias("observation")))
        return F.transform(F.filter(each, lambda x: x["k"] == "CAN"), lambda x: F.struct(x["candidate"].alias("candidate"), x["observation"].alias("observation")))

    return T.let(made, of)


def tensor_shards(index: DataFrame, headers: DataFrame) -> DataFrame:
    """(model, tensor, shard): by the model's index where it has one, else by the headers of its files. Both: (model, tensor, shard)."""
    indexed = index.select("model").distinct()
    return index.select("model", "tensor", "shard").unionByName(headers.join(indexed, "model", "left_anti").select("model", "tensor", "shard"))


#: Fixed value: a digest that pins a commitment.
PINNED = r"(?:sha256:)?[0-9a-f]{64}|[0-9a-f]{40}"


def commitments(blocks: DataFrame, members: DataFrame, start: int, prefix: str) -> DataFrame:
    """(block, member, repo, digest): commitments from block `start` on with a payload of three parts `prefix|repo|digest` (SURVEY
    SC25), the repo with an owner and the digest one that pins it, of known members. blocks: (block, key, payload); members: (key, member)."""
    parts = F.split("payload", r"\|")
    own = blocks.where((F.col("block") >= start) & (F.size(parts) == 3) & (parts[0] == prefix))
    fits = F.col("repo").contains("/") & F.col("digest").rlike(rf"^(?:{PINNED})\z")
    return own.withColumns({"repo": parts[1], "digest": parts[2]}).where(fits).join(members, "key").select("block", "member", "repo", "digest")


def extracted_rows(prompts: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of each scored sample and reference run: prompts (sample_id, prompt) lose their rollout suffix, scores (sample_id,
    steps array<struct<run, text>>, models, trajectories) have runs as steps or, in older files, as parallel arrays."""
    first = prompts.groupBy(F.substring_index("sample_id", "#", 1).alias("sample")).agg(F.min_by("prompt", "sample_id").alias("prompt"))
    old = F.transform(F.arrays_zip("models", "trajectories"), lambda x, i: F.struct((i + 1).alias("run"), x["trajectories"].alias("text")))
    runs = F.explode(F.filter(F.coalesce("steps", old), lambda r: r["text"].isNotNull()))
    each = scores.select(F.substring_index("sample_id", "#", 1).alias("sample"), runs.alias("r")).select("sample", "r.run", "r.text")
    return each.join(first, "sample").dropDuplicates(["sample", "run", "text"])


def cache_entries(paths: DataFrame) -> DataFrame:
    """(path, layout, model, revision) of files in model caches of three layouts: hub snapshots, plain owner and name, content addresses; others are left out."""
    hub, plain, address = r"/models--([^/]+?)--([^/]+)/snapshots/([^/]+)/", r"/plain/([^/]+)/([^/]+)/", r"/blobs/sha256/([0-9a-f]{64})/"
    part = lambda p, i: F.regexp_extract("path", p, i)
    layout = F.when(part(hub, 1) != "", "hub").when(part(plain, 1) != "", "plain").when(part(address, 1) != "", "address")
    model = F.when(layout == "hub", F.concat_ws("/", part(hub, 1), part(hub, 2))).when(layout == "plain", F.concat_ws("/", part(plain, 1), part(plain, 2)))
    revision = F.when(layout == "hub", part(hub, 3)).when(layout == "address", part(address, 1))
    return paths.select("path", layout.alias("layout"), model.alias("model"), revision.alias("revision")).where("layout IS NOT NULL")


def orphans(chunks: DataFrame, pending: DataFrame) -> DataFrame:
    """Chunks (chunk, head) whose rows are still pending (chunk, head): written, but never committed. Equal heads mean equal rows."""
    return chunks.join(pending.select("head").distinct(), "head", "left_semi")


def enriched(chunk: DataFrame, more: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """chunk with the columns of `more` by key, one row of each, and the count of matched rows as an aggregate."""
    once = more.withColumn("__hit", F.lit(True)).dropDuplicates([key])
    return chunk.join(once, key, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False))), F.count_if("__hit")


def enqueued(commits: DataFrame, submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New submissions of commits (id, owner, uri) and the links of all of them: insert what is absent by uri, first id wins, then link every commit to its submission. submissions: (submission, uri)."""
    first = commits.groupBy("uri").agg(F.min("id").alias("submission"))
    new = first.join(submissions.select("uri"), "uri", "left_anti").select("submission", "uri")
    links = commits.join(submissions.unionByName(new), "uri").select("id", "submission")
    return new, links


@query("""SELECT event_id, coalesce(props->>'$.key', props->>'$.kind', props->>'$.k') AS picked, CASE event_type WHEN 'click' THEN 'miner' WHEN 'view' THEN 'infra' ELSE 'unknown' END AS kind, event_type <> 'click' AS retryable,
  CASE event_id % 3 WHEN 0 THEN (event_id % 90)::double WHEN 1 THEN 60.0::double END AS wait FROM events""")
def fields_and_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY PF13, PF16, FM07: aliases of a field, classes of faults, seconds to wait."""
    kind = F.when(F.col("event_type") == "click", "miner").when(F.col("event_type") == "view", "infra").otherwise(F.col("event_type"))
    got = fault(kind, F.lit(None).cast("boolean"))
    now = F.lit("2024-01-05 10:00:00").cast("timestamp")
    header = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 90).cast("string")).when(F.col("event_id") % 3 == 1, "Fri, 05 Jan 2024 10:01:00 GMT").otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", picked(F.col("props"), "key", "kind", "k").alias("picked"), got["kind"].alias("kind"), got["retryable"].alias("retryable"), retry_after(header, now).alias("wait"))


@query("""
WITH u AS (SELECT l_suppkey, sum(l_quantity) AS b, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN b > 15500 THEN 'bytes' ELSE 'objects' END AS reason FROM u WHERE b > 15500 OR n > 590""")
def quotas_breached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY PF21: suppliers over a quota of bytes or objects."""
    return quota_breaches(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", "l_quantity", 15_500, 590)


@query(r"""
SELECT doc_id, CAST(length(coalesce(text, '')) + length(coalesce(lang, '')) AS int) AS chars, doc_id AS prompt, doc_id + 7 AS completion, '1,2,' || doc_id % 5 AS devices, CAST((doc_id % 7 + 2) // 3 AS int) AS chunks,
  CASE doc_id % 3 WHEN 0 THEN 'flat' WHEN 1 THEN 'tagged' END AS rule FROM documents""")
def payload_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FM15, FM16, FM18, FM19, FM21: sizes of nested payloads, token counts, devices, chunks, the rule behind a stored weight."""
    k = F.col("doc_id")
    body = F.to_json(F.struct(F.col("doc_id"), F.array(F.struct(F.col("text").alias("text"))).alias("parts"), F.struct(F.col("lang").alias("lang")).alias("meta")))
    said = F.concat(F.lit('x {"usage": {"prompt_tokens": 1, "completion_tokens": 2}} y {"usage": {"prompt_tokens": '), k.cast("string"), F.lit(', "completion_tokens": '), (k + 7).cast("string"), F.lit("}}"))
    topology = F.concat(F.lit('{"groups": [{"ids": [1, 2]}, {"ids": ['), (k % 5).cast("string"), F.lit("]}]}"))
    values = F.when(k % 7 > 0, F.sequence(F.lit(1), (k % 7).cast("int"))).otherwise(F.array().cast("array<int>"))
    stored = F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.5).otherwise(0.3)
    return table(spark, sf_dir, "documents").select(
        "doc_id", nested_length(body).alias("chars"), tail_usage(said)["prompt"].alias("prompt"), tail_usage(said)["completion"].alias("completion"), F.array_join(device_ids(topology), ",").alias("devices"),
        F.size(chunked(values, 3)).alias("chunks"), inferred_rule(stored, {"flat": F.lit(1.00001), "tagged": F.lit(0.5)}).alias("rule"),
    )


@query("""
SELECT 'src' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'changed' END AS fault FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""")
def pinned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY VL05, VL06: pinned files that are missing or changed."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), "doc_id").alias("path"), "doc_id", F.sha2("text", 256).alias("sha"))
    have = d.where("doc_id % 5 <> 0").withColumn("sha", F.when(F.col("doc_id") % 7 == 0, F.concat("sha", F.lit("x"))).otherwise(F.col("sha")))
    return pinned_faults(have.select("path", "sha"), d.select("path", "sha"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'fields' WHEN 2 THEN 'paths' WHEN 3 THEN 'digest' END AS fault FROM documents""")
def manifest_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY VL07: manifests with other fields, a path twice or another digest."""
    k = F.col("doc_id")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    told = F.concat(F.lit("a\u00001\u0000"), sha, F.lit("\nb\u00002\u0000"), sha)
    file = lambda path, size: F.concat(F.lit(f'{{"path": "{path}", "size": {size}, "sha": "'), sha, F.lit('"}'))
    files = F.concat(file("b", 2), F.lit(", "), F.when(k % 4 == 2, file("b", 1)).otherwise(file("a", 1)))
    digest = F.when(k % 4 == 3, "no").otherwise(F.sha2(told, 256))
    body = F.concat(F.lit('{"version": 1, "files": ['), files, F.lit('], "digest": "'), digest, F.when(k % 4 == 1, '", "more": 1}').otherwise('"}'))
    return table(spark, sf_dir, "documents").select("doc_id", manifest_fault(body).alias("fault"))


@query("""
SELECT o_orderkey AS run, n AS name, CASE n WHEN 'log' THEN 'text' ELSE 'json' END AS kind, CASE WHEN n = 'log' THEN 'b' END AS bucket, CASE WHEN n = 'log' THEN 'k/' || o_orderkey END AS key,
  CASE WHEN o_orderstatus = 'F' THEN 'loop' WHEN o_orderkey % 32 <= 16 THEN 'skipped' WHEN o_custkey % 2 = 1 THEN 'failed' ELSE 'passed' END AS tail, CASE o_orderkey % 3 WHEN 0 THEN 'undecided' WHEN 1 THEN 'passed' ELSE 'failed' END AS head
FROM orders, (SELECT unnest(['log', 'scores']) AS n)""")
def artifacts_and_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY VL09, VL10, TQ21, TQ22: artifacts of verdicts with a known kind; outcomes of head and tail checks."""
    o = table(spark, sf_dir, "orders")
    uri = lambda scheme: F.concat(F.lit(scheme), F.lit("://b/k/"), F.col("o_orderkey").cast("string"))
    verdict = o.select(F.col("o_orderkey").alias("run"), F.create_map(F.lit("log"), uri("s3"), F.lit("scores"), uri("file"), F.lit("other"), uri("s3")).alias("artifacts"))
    kinds = spark.createDataFrame([("log", "text"), ("scores", "json")], "name string, kind string")
    answers = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("maybe"), F.lit("yes"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("Yes "), F.lit("no"), F.lit("yes"))).otherwise(F.array(F.lit("yes"), F.lit("no")))
    gates = o.select(F.col("o_orderkey").alias("run"), tail_gate(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 32, F.col("o_custkey") % 2).alias("tail"), head_gate(answers, 2).alias("head"))
    return artifact_rows(verdict, kinds).join(gates, "run")


@query(r"""
WITH r AS (SELECT doc_id, lower(trim(CASE WHEN doc_id % 3 = 0 THEN ' Own__' || source || '-' || (doc_id % 50) || '_interface' ELSE 'own__' || source || '-' || (doc_id % 50) END)) AS raw, source, text, lang FROM documents WHERE lang IS NOT NULL),
n AS (SELECT *, CASE WHEN ends_with(raw, '_interface') THEN left(raw, length(raw) - 10) ELSE raw END AS id FROM r)
SELECT id, arg_min(source, lang || lpad(doc_id::varchar, 12, '0')) AS repo, md5(arg_min(coalesce(text, ''), lang || lpad(doc_id::varchar, 12, '0'))) AS text, string_agg(DISTINCT lang, ',' ORDER BY lang) AS splits FROM n GROUP BY id""")
def benchmark_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SC12: one task of each normalised id, the first row's, with all its splits."""
    iid = F.concat(F.when(F.col("doc_id") % 3 == 0, " Own__").otherwise("own__"), "source", F.lit("-"), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 3 == 0, "_interface").otherwise(""))
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(iid.alias("id"), F.col("source").alias("repo"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("split"), F.col("doc_id").alias("nth"))
    return benchmark_tasks(rows).select("id", "repo", F.md5("text").alias("text"), F.array_join("splits", ",").alias("splits"))


@query(r"""
WITH s AS (SELECT doc_id, trim(regexp_replace(lower('own/' || source), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN slug || '#' || doc_id WHEN 1 THEN slug || '#' || doc_id || CASE WHEN doc_id = 7 THEN '' ELSE ',' || slug || '#7' END ELSE slug || '#9' END AS keys FROM s""")
def pull_request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY FS03, FS05, SC13: every pull request key of a row, once."""
    k, third = F.col("doc_id"), F.col("doc_id") % 3
    repo = F.concat(F.lit("own/"), "source")
    iid = F.when(third < 2, F.concat(F.lit("own__"), "source", F.lit("-"), k.cast("string"))).otherwise("none")
    url = F.when(third == 0, F.concat(F.lit("https://github.com/"), repo, F.lit("/pull/"), k.cast("string"))).when(third == 2, F.concat(F.lit("https://github.com/"), repo, F.lit("/pull/9")))
    keys = row_pr_keys(iid, repo, F.when(third == 1, F.lit(7).cast("bigint")), url)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(keys, ",").alias("keys"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN md5('<returncode>' || doc_id % 4 || '</returncode>' || chr(10) || '<output>' || chr(10) || coalesce(text, '') || chr(10) || '</output>') END AS tagged, 2 AS blocks, md5(coalesce(text, '')) AS second, 'seen' AS observation FROM documents""")
def dialects_and_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY XA04, XA05, JN36: the JSON dialect as tagged text; candidate blocks with their observations."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    exact = F.to_json(F.struct((k % 4).cast("int").alias("returncode"), text.alias("output")))
    more = F.to_json(F.struct((k % 4).cast("int").alias("returncode"), text.alias("output"), F.lit(1).alias("extra")))
    raw = F.when(k % 3 == 0, exact).when(k % 3 == 1, more).otherwise(text)
    fence = F.lit(":\n------\n")
    doc = F.concat(F.lit("HEAD\n\nCANDIDATE OUTPUT 1"), fence, F.lit("one\n------\n\nENVIRONMENT OBSERVATION (context only)"), fence, F.lit("seen\n------\n\nCONTEXT USER (do not score)"), fence, F.lit("more\n------\n\nCANDIDATE OUTPUT 2"), fence, text, F.lit("\n------"))
    blocks = aligned_blocks(doc)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(dialect_text(raw)).alias("tagged"), F.size(blocks).alias("blocks"), F.md5(blocks[1]["candidate"]).alias("second"), blocks[0]["observation"].alias("observation"))


@query("""
WITH i AS (SELECT DISTINCT l_suppkey AS model, 't' || l_linenumber AS tensor, 'i' || l_linenumber % 2 AS shard FROM lineitem WHERE l_suppkey % 2 = 0), h AS (SELECT DISTINCT l_suppkey AS model, 't' || l_linenumber AS tensor, 'h' || l_linenumber % 3 AS shard FROM lineitem)
SELECT * FROM i UNION ALL SELECT * FROM h WHERE model % 2 <> 0""")
def tensor_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SC24: shard of each tensor, by the index or by the headers."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    of = lambda df, p, n: df.selectExpr("l_suppkey AS model", "'t' || l_linenumber AS tensor", f"'{p}' || l_linenumber % {n} AS shard").distinct()
    return tensor_shards(of(rows.where("l_suppkey % 2 = 0"), "i", 2), of(rows, "h", 3))


@query("""
SELECT o_orderkey AS block, c_name AS member, repo, digest FROM (
    SELECT *, CASE WHEN o_orderpriority = '2-HIGH' THEN 'alone' ELSE 'own/' || o_custkey END AS repo, CASE substring(o_orderpriority, 1, 1)
        WHEN '1' THEN sha1(o_orderkey::varchar) WHEN '3' THEN sha256(o_orderkey::varchar) WHEN '4' THEN 'sha256:' || sha256(o_orderkey::varchar) ELSE substring(sha1(o_orderkey::varchar), 1, 39) END AS digest FROM orders)
JOIN customer ON o_custkey = c_custkey WHERE o_orderkey >= 1000 AND o_orderstatus <> 'P' AND length(digest) >= 40 AND repo LIKE '%/%'""")
def commitment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SC25: commitments from a block on, with a fitting payload, of known members."""
    blocks = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS block", "o_custkey AS key", """concat_ws('|', IF(o_orderstatus = 'P', 'v6', 'v7'), IF(o_orderpriority = '2-HIGH', 'alone', concat('own/', o_custkey)),
            CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN sha1(string(o_orderkey)) WHEN '3' THEN sha2(string(o_orderkey), 256)
            WHEN '4' THEN concat('sha256:', sha2(string(o_orderkey), 256)) ELSE left(sha1(string(o_orderkey)), 39) END) AS payload""")
    return commitments(blocks, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("member")), 1000, "v7")


@query("""
WITH p AS (SELECT o_custkey, arg_min(o_comment_, s) AS prompt FROM (SELECT o_custkey, 'p' || o_orderkey AS o_comment_, o_custkey || '#r' || lpad(o_orderkey::varchar, 12, '0') AS s FROM orders) GROUP BY 1)
SELECT DISTINCT CAST(o_custkey AS varchar) AS sample, r AS run, CASE WHEN o_custkey % 2 = 0 THEN 's' || r ELSE 't' || r END AS text, prompt FROM p, (SELECT unnest([1, 2, 3]) AS r) WHERE NOT (o_custkey % 2 = 1 AND r = 3)""")
def artifact_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SC29, XA07: prompts and reference runs of new and older artifacts, one row of each run."""
    o = table(spark, sf_dir, "orders")
    sample = F.concat(F.col("o_custkey").cast("string"), F.lit("#r"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    prompts = o.select(sample.alias("sample_id"), F.concat(F.lit("p"), "o_orderkey").alias("prompt"))
    steps = F.when(F.col("o_custkey") % 2 == 0, F.expr("transform(array(1, 2, 3), r -> named_struct('run', r, 'text', 's' || r))"))
    scores = o.select(sample.alias("sample_id"), steps.alias("steps"), F.expr("array('a', 'b', 'c')").alias("models"), F.expr("array('t1', 't2', NULL)").alias("trajectories"))
    return extracted_rows(prompts, scores)


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'hub' WHEN 1 THEN 'plain' ELSE 'address' END AS layout, CASE doc_id % 4 WHEN 0 THEN 'own/' || source WHEN 1 THEN 'own/' || source END AS model, CASE doc_id % 4 WHEN 0 THEN 'r' || doc_id WHEN 2 THEN sha256(coalesce(text, '')) END AS revision FROM documents WHERE doc_id % 4 <> 3""")
def model_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SC30: files of three cache layouts."""
    k = F.col("doc_id") % 4
    path = (
        F.when(k == 0, F.concat(F.lit("/c/models--own--"), "source", F.lit("/snapshots/r"), F.col("doc_id").cast("string"), F.lit("/w.bin")))
        .when(k == 1, F.concat(F.lit("/c/plain/own/"), "source", F.lit("/w.bin"))).when(k == 2, F.concat(F.lit("/c/blobs/sha256/"), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit("/w"))).otherwise("/c/else/w")
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return rows.join(cache_entries(rows.select("path").distinct()), "path").select("doc_id", "layout", "model", "revision")


@query("SELECT source AS chunk, arg_min(doc_id, doc_id) AS head FROM documents GROUP BY 1 HAVING min(doc_id) % 2 = 0")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SK05: chunks that were written but never committed, known by their first id."""
    chunks = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("chunk")).agg(F.min("doc_id").alias("head"))
    return orphans(chunks, chunks.where("head % 2 = 0")).select("chunk", "head")


@query("SELECT source, count(*) AS rows, count(l.doc_id) AS matched FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def enriched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY SK13: rows of each chunk and how many of them were enriched."""
    rows, matched = enriched(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("rows"), matched.alias("matched"))


@query("""
WITH c AS (SELECT o_orderkey AS id, 'uri' || o_custkey AS uri FROM orders), s AS (SELECT -c_custkey AS submission, 'uri' || c_custkey AS uri FROM customer WHERE c_acctbal > 0),
n AS (SELECT min(id) AS submission, uri FROM c WHERE uri NOT IN (SELECT uri FROM s) GROUP BY uri)
SELECT id, submission FROM c JOIN (SELECT * FROM s UNION ALL SELECT * FROM n) USING (uri)""")
def enqueue_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY DM04: submissions inserted where absent, then every commit linked to its own."""
    commits = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "'uri' || o_custkey AS uri")
    old = table(spark, sf_dir, "customer").where("c_acctbal > 0").selectExpr("-c_custkey AS submission", "'uri' || c_custkey AS uri")
    return enqueued(commits, old)[1]
