"""Sources and sinks over files of their own."""

from __future__ import annotations

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, writers

TURN = "array<struct<role:string,content:string,other:string>>"


def test_turn_fields_and_metadata(spark, tmp_path):
    edit = "```bash\nsed -i 's/a/b/' pkg/mod.py\n```"
    rows = [("i1", [("user", "ask", "x"), ("assistant", "look", "x"), ("assistant", edit, "x")]), ("i2", [("assistant", "hm", "x")])]
    spark.createDataFrame(rows, f"instance_id string, messages {TURN}").coalesce(1).write.parquet(str(tmp_path / "t"))
    fields = readers.turn_fields(spark, str(tmp_path / "t"))
    assert "other" not in fields._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert fields.orderBy("row").first().role == ["user", "assistant", "assistant"]
    blocked = spark.createDataFrame([("i2",)], "iid string")
    got = {r.iid: r for r in readers.row_meta(spark, str(tmp_path / "t"), blocked=blocked).collect()}
    assert (got["i1"].asst, got["i1"].first_edit, got["i1"].chars_before, got["i1"].blocked) == (2, 2, 7, False)
    assert (got["i2"].asst, got["i2"].first_edit, got["i2"].chars_before, got["i2"].blocked) == (1, 0, 0, True)


def test_cache_runs_a_loader_once(spark, tmp_path):
    runs = []

    def load():
        runs.append(1)
        return spark.range(3)

    for version in ("v1", "v1", "v2"):
        assert readers.cached(spark, str(tmp_path), version, {"a": load}).count() == 3
    assert len(runs) == 2 and readers.cached(spark, str(tmp_path), "v2", {"a": load, "b": load}).count() == 6 and len(runs) == 3


def test_appended_text_overlaps_by_a_marker(spark, tmp_path):
    (tmp_path / "log").write_text("one<EN")
    none = spark.createDataFrame([], "path string, offset bigint")
    first = readers.appended(spark, str(tmp_path / "log"), none, "<END>").first()
    (tmp_path / "log").write_text("one<END>two")
    kept = spark.createDataFrame([(first.path, first.length)], "path string, offset bigint")
    assert first.text == "one<EN" and readers.appended(spark, str(tmp_path / "log"), kept, "<END>").first().text == "e<END>two"
    whole = spark.createDataFrame([(first.path, 11)], "path string, offset bigint")
    assert readers.appended(spark, str(tmp_path / "log"), whole, "<END>").isEmpty()


def test_pages_follow_their_links(spark, tmp_path):
    for name, body in (("1", {"results": [{"k": 1}], "next_page": "2"}), ("2", {"data": [{"k": 2}, {"k": 3}]}), ("9", {"items": [{"k": 9}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    got = readers.landed_pages(spark, str(tmp_path / "*.json"), "struct<k:int>")
    assert sorted(map(tuple, got.collect())) == [("1", 1), ("2", 2), ("2", 3)]


def test_tree_and_multi_get(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/d",), ("e",)], "path string")
    assert [tuple(r) for r in readers.tree(paths).orderBy("path").collect()] == [("a", 1, True), ("a/b", 2, True), ("a/b/c.py", 3, False), ("a/d", 2, False), ("e", 1, False)]
    assert readers.of_ids(spark.range(5), spark.createDataFrame([(1,), (1,), (7,)], "id long"), "id").count() == 1


def test_shards_have_names_and_row_groups(spark, tmp_path):
    names = writers.write_shards(spark.range(700).coalesce(1), str(tmp_path / "s"), 300, 64)
    assert names == ["train-00000.parquet", "train-00001.parquet", "train-00002.parquet"]
    files = [pq.ParquetFile(tmp_path / "s" / n) for n in names]
    assert sorted(f.metadata.num_rows for f in files) == [100, 300, 300] and all(f.metadata.row_group(i).num_rows <= 64 for f in files for i in range(f.num_row_groups))


def test_chunks_leave_a_remainder(spark):
    rows = spark.range(250).select(F.lit("s").alias("k"), "id")
    full, left = writers.cut_chunks(rows, "k", "id", 100)
    assert full.groupBy("chunk").count().orderBy("chunk").collect() == [(0, 100), (1, 100)] and left.count() == 50
    again, same = writers.cut_chunks(left, "k", "id", 100)
    assert again.isEmpty() and same.count() == 50


def test_artifacts_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "log", 1), ("r1", "scores", 2), ("r2", "log", 3)], "run string, artifact string, v int")
    writers.write_artifacts(rows, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 3 and (tmp_path / "a" / "run=r1" / "artifact=log").exists()
    assert json.loads(writers.published(rows.select("v"), "d").first().body) == {"rows": [{"v": 1}, {"v": 2}, {"v": 3}], "n": 3}
    text, digest = writers.manifest_text([{"rows": 2, "name": "a"}], "v1")
    assert json.loads(text)["total_rows"] == 2 and len(digest) == 64


def test_manifest_artifacts_and_headers(spark, tmp_path):
    meta = {"sources": [{"name": "s", "shards": [{"name": "data/train-0.parquet", "rows": 2, "rows_meta": [{"iid": "a"}, {"iid": "b"}]}, {"name": "x", "rows": 1, "rows_meta": [{"iid": "c"}]}]}]}
    (tmp_path / "m.json").write_text(json.dumps(meta))
    rows = readers.manifest(spark, str(tmp_path / "m.json"))
    assert rows.count() == 3 and [r.shard for r in readers.manifest_faults(rows).collect()] == ["x"]
    with pytest.raises(ValueError, match="pinned"):
        readers.manifest(spark, str(tmp_path / "m.json"), "0" * 64)
    for run, names in (("r1", ("generated-samples.jsonl", "scoring-results.jsonl", "verdict.json")), ("r2", ("verdict.json",))):
        (tmp_path / "runs" / run).mkdir(parents=True)
        for n in names:
            (tmp_path / "runs" / run / n).write_text("x")
    assert {r.run: r.complete for r in readers.artifacts(spark, str(tmp_path / "runs" / "*" / "*")).collect()} == {"r1": True, "r2": False}
    header = json.dumps({"__metadata__": {}, "w": {"dtype": "F16", "shape": [2, 3], "data_offsets": [0, 12]}}).encode()
    (tmp_path / "t.tensors").write_bytes(len(header).to_bytes(8, "little") + header + bytes(12))
    assert [(r.tensor, r.dtype, r["shape"]) for r in readers.tensor_headers(spark, str(tmp_path / "t.tensors")).collect()] == [("w", "F16", [2, 3])]
    body = spark.createDataFrame([('{"items": [{"k": 1}]}',), ('[{"k": 2}]',)], "b string")
    assert sorted(r.k[0].k for r in body.select(readers.json_items(F.col("b"), "struct<k:int>").alias("k")).collect()) == [1, 2]
