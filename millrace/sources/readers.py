"""Sources: JSON lines, block-lists, manifests, artifact listings, positional lookups, headers."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.turns import edited_in_turn

#: Names that a column of turns may have.
TURN_COLUMNS = ("messages", "trajectory", "conversation")


def shards(spark: SparkSession, *patterns: str) -> DataFrame:
    """Parquet shards of several globs, with the file and position of each row."""
    return spark.read.parquet(*patterns).select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"))


def turns_column(df: DataFrame) -> str:
    """The column that holds a trajectory's turns, by inspection of the schema."""
    for name in TURN_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"none of {TURN_COLUMNS} is a column")


def turn_fields(spark: SparkSession, *patterns: str) -> DataFrame:
    """(shard, row, role, content): roles and texts of each row's turns; no other column or nested field is read."""
    df = spark.read.parquet(*patterns)
    turns = turns_column(df)
    return df.select(F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"), F.col(f"{turns}.role").alias("role"), F.col(f"{turns}.content").alias("content"))


def row_meta(spark: SparkSession, *patterns: str, key: str = "instance_id", blocked: DataFrame | None = None) -> DataFrame:
    """One row of metadata of each row of the shards, at its position in the file: id, number of assistant turns, the turn of the
    first edit (0: none), characters before it, whether the id is blocked (iid)."""
    df = spark.read.parquet(*patterns)
    turns = F.col(turns_column(df))
    asst = F.filter(turns, lambda t: t["role"] == "assistant")
    first = F.array_position(F.transform(asst, lambda t: edited_in_turn(t["content"])), True).cast("int")
    nth = lambda i: F.size(F.filter(F.slice(turns, 1, i + 1), lambda t: t["role"] == "assistant"))
    before = F.filter(turns, lambda t, i: (nth(i) < first) & (first > 0))
    chars = F.aggregate(before, F.lit(0).cast("bigint"), lambda a, t: a + F.length(F.coalesce(t["content"], F.lit(""))))
    rows = df.select(F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"), F.col(key).alias("iid"), F.size(asst).alias("asst"), first.alias("first_edit"), chars.alias("chars_before"))
    if blocked is None:
        return rows.withColumn("blocked", F.lit(False))
    return rows.join(blocked.select("iid", F.lit(True).alias("blocked")).distinct(), "iid", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def of_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the ids, each once."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def cached(spark: SparkSession, path: str, version: str, loaders: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The tables of all loaders, each with its `label`, kept in `path` under a version.

    A loader runs only where the cache of this version lacks its label; another version reads nothing of this one.
    """
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    parts = []
    for label, load in loaders.items():
        own = f"{path}/{version}/{label}"
        done = jvm(f"{own}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            load().write.mode("overwrite").parquet(own)
        parts.append(spark.read.parquet(own).withColumn("label", F.lit(label)))
    return reduce(DataFrame.unionByName, parts)


def appended(spark: SparkSession, pattern: str, offsets: DataFrame, marker: str) -> DataFrame:
    """(path, length, text): what files hold beyond their offsets (path, offset), 0 where none is kept.

    The text begins a marker's length less one before the offset, so a marker cut in two isn't missed; lengths are the next offsets.
    """
    files = spark.read.format("binaryFile").load(pattern).join(offsets, "path", "left")
    start = F.greatest(F.coalesce("offset", F.lit(0)) - (len(marker.encode()) - 1), F.lit(0)).cast("int")
    return files.where(F.col("length") > F.coalesce("offset", F.lit(0))).select("path", "length", F.expr("content").substr(start + 1, F.col("length").cast("int")).cast("string").alias("text"))


def landed_pages(spark: SparkSession, pattern: str, item: str) -> DataFrame:
    """Rows of paginated answers that were landed as one JSON body a file: pages that another page's next_page names, and the first ones.

    A page that nothing leads to is a stale leftover and isn't read.
    """
    body = spark.read.text(pattern, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_name"), r"\."), 1).alias("page"), "value")
    named = body.select(F.get_json_object("value", "$.next_page").alias("page")).where("page IS NOT NULL")
    live = body.join(named.distinct(), "page", "left_semi").union(body.where("page = '1'")).distinct()
    return live.select("page", F.explode(json_items(F.col("value"), item)).alias("r")).select("page", "r.*")


def tree(paths: DataFrame) -> DataFrame:
    """(path, depth, folder) of every file of `path` and every folder above one; sorted by path that is depth first with sorted children."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("depth"), (i < F.size(parts)).alias("folder")))
    return paths.where("path <> ''").select(F.explode(prefixes).alias("p")).select("p.*").groupBy("path", "depth").agg(F.bool_or("folder").alias("folder"))


def row_at(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows at (shard, row) positions: one join, never a read per row."""
    return rows.join(wanted, ["shard", "row"])


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line fails the read, or is dropped. Blank lines never count."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def block_list(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers between white space."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("iid")).where("iid <> ''").distinct()


def instructions(spark: SparkSession, pattern: str) -> DataFrame:
    """(task, text) of files named instruction.md, without the footer below a line of dashes."""
    files = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("f"), "value")
    return files.select(F.element_at(F.split("f", "/"), -2).alias("task"), F.split("value", r"\n-{4,}\n", 2)[0].alias("text"))


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t")


def artifacts(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, files, newest, complete): files of each run folder; complete if all three markers are there."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")
    parts = F.split("path", "/")
    each = files.select(F.element_at(parts, -2).alias("run"), F.element_at(parts, -1).alias("name"), "length", "modificationTime")
    got = each.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "length")))).alias("files"), F.max("modificationTime").alias("newest"))
    needed = F.array(*map(F.lit, ("generated-samples.jsonl", "scoring-results.jsonl", "verdict.json")))
    return got.withColumn("complete", F.size(F.array_except(needed, F.map_keys("files"))) == 0)


def manifest(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(source, shard, row, meta) of a manifest; with a pinned hash any other content raises."""
    if sha256:
        got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
        if got is None or got.h != sha256:
            raise ValueError("the manifest isn't the pinned one")
    m = spark.read.option("multiLine", True).json(path)
    source = m.select(F.explode("sources").alias("s")).select(F.col("s.name").alias("source"), F.explode("s.shards").alias("d"))
    return source.select("source", F.col("d.name").alias("shard"), F.col("d.rows").alias("rows"), F.posexplode("d.rows_meta").alias("row", "meta"))


def manifest_faults(rows: DataFrame) -> DataFrame:
    """Shards whose name or row count is wrong; an empty result is a valid manifest."""
    n = rows.groupBy("source", "shard").agg(F.count("*").alias("found"), F.max("rows").alias("rows"))
    return n.where(~F.col("shard").rlike(r"^(?:[\w.-]+/)?data/train-[\w-]+\.parquet$") | (F.col("found") != F.col("rows")))


def json_items(body: Column, item: str) -> Column:
    """Rows in a JSON body, whichever of the usual keys holds them."""
    kind = f"array<{item}>"
    return F.coalesce(*(F.from_json(F.get_json_object(body, f"$.{k}"), kind) for k in ("results", "data", "items", "registrations")), F.from_json(body, kind))


def timestamp_of(c: Column) -> Column:
    """Seconds, milliseconds or ISO text to a timestamp."""
    number = c.try_cast("double")
    return F.when(number.isNotNull(), F.timestamp_seconds(F.when(number > 1e12, number / 1000).otherwise(number))).otherwise(F.try_to_timestamp(c))


def processes(text: DataFrame) -> DataFrame:
    """(pid, elapsed, command) from lines of a process listing."""
    parts = F.split(F.trim("value"), r"\s+", 3)
    return text.where(F.size(parts) == 3).select(parts[0].try_cast("bigint").alias("pid"), parts[1].alias("elapsed"), parts[2].alias("command")).where("pid IS NOT NULL")


def tensor_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, tensor, dtype, shape) from the JSON header of tensor files: a length in 8 bytes, then JSON."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                n = struct.unpack("<Q", content[:8])[0]
                for name, t in json.loads(content[8 : 8 + n]).items():
                    if name != "__metadata__":
                        rows.append((path, name, t["dtype"], [int(x) for x in t["shape"]]))
            yield pd.DataFrame(rows, columns=["path", "tensor", "dtype", "shape"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "path string, tensor string, dtype string, shape array<bigint>")
