"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import decontamination, jaccard, repeats
from millrace.llm.shared import written


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), f"test-{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    everything = spark.read.parquet(f"{sf}/documents.parquet")
    assert kept["language"].count() == everything.count()  # every document has a clear language here
    groups = jaccard.linked_documents(kept["language"]).select("component_id").distinct()
    assert kept["near_duplicates"].count() == groups.count()
    assert kept["repeats"].count() == kept["near_duplicates"].count()
    lost = {r.doc_id: r.n_removed for r in repeats.summary(kept["near_duplicates"]).collect()}
    before, after = ({r.doc_id: len((r.text or "").encode()) for r in kept[k].collect()} for k in ("near_duplicates", "repeats"))
    assert all(0 <= before[k] - lost[k] - after[k] <= 3 * (lost[k] > 0) * 50 for k in before)  # a character cut in two goes whole
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontamination.contained_items(kept["benchmark"], items).isEmpty()
    assert kept["packing"].select("doc_id").distinct().count() == kept["benchmark"].count()


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns[:3] == ["doc_id", "piece", "start"] and got.count() > 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h int, label string"
FR, EN = "le chat et la souris dorment dans la maison bleue de la rue longue ", "the cat and the mouse sleep in the blue house of the long street "


def tables(spark, tmp_path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def rows_of():
    words = [f"w{i}" for i in range(200)]
    rows = [(i, (FR if i % 2 else EN) * 3 + " ".join(words[(i * 7 + j) % 200] for j in range(40)), "fr" if i % 2 else "en") for i in range(24)]
    rows += [(24, None, "en"), (25, "", None), (26, " \n ", "fr"), (27, "12 34", "en"), (None, EN * 2 + "nobody", "en"), (3, rows[3][1], "fr")]
    return [(*r, "s", len(r[1] or ""), 1, "x") for r in rows]


def test_each_stage_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and wordless texts, repeated rows, extra columns with names of our own."""
    sf = tables(spark, tmp_path, [(1, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (2, None), (3, "")])
    docs = spark.createDataFrame(rows_of(), COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        kept = got.collect()
        ids = {r.doc_id for r in kept}
        if name == "language":
            assert ids.isdisjoint({24, 25, 26, 27}) and {0, 1, 2, 3, None} <= ids and sum(r.doc_id == 3 for r in kept) == 2
        if name == "near_duplicates":
            assert len(ids) == len(kept) and {24, 25, 26, 27, None} <= ids
        if name == "repeats":
            assert len(kept) == docs.count() and {r.text for r in kept if r.doc_id == 24} == {None}
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
        if name == "benchmark":
            assert {1, 24, 25, 26, 27} & ids == {24, 25, 26, 27}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(packed) == docs.count()


def test_each_stage_on_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [])
    empty, some = spark.createDataFrame([], COLUMNS), spark.createDataFrame(rows_of(), COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == [], name
    assert corpus_pipeline.benchmark(spark, some, sf).count() == some.count()
    unlabelled = some.withColumn("lang", some.lang.isNull().cast("string")).where("lang = 'x'")
    assert corpus_pipeline.language(spark, unlabelled, sf).collect() == []


def test_near_duplicates_broadcast_no_exploded_table(spark, monkeypatch):
    plans, keep = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or keep(df, name))
    rows = [(i, f"one two three four five six seven eight nine ten {i // 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 20
    joins = [line for line in plans["stay"].splitlines() if "Join" in line and "salt" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0], joins
