"""Milestones written out, results merged, records in order."""

from __future__ import annotations

from millrace.operators import evidence as E

KIND = "task string, place int, id string, category string, statement string, reason string, depends_on array<string>, spans array<string>"


def test_milestones_are_written_out(spark):
    same, other = "def parse_header(line): return line_split", "class Writer: flush_buffers"
    rows = [
        ("t", 1, "a", "find", "found it", "needed", [], [same, same + " again_here", " ", other]), ("t", 2, "b", "fix", "", None, ["a", "zz", "b"], [same, same]),
        ("u", 1, "a", None, "x", "", ["a"], None), ("t", 3, "c", "fix", "done", "", ["a", "c"], [other, same, "third_span of_text", "fourth_one alone_too"]),
    ]
    got = {(r.task, r.id): r for r in E.projected(spark.createDataFrame(rows, KIND)).collect()}
    assert got["t", "a"].spans == [same, other] and not got["t", "a"].agreed and got["t", "b"].agreed and got["t", "b"].earlier == ["found it"]
    assert got["t", "c"].spans == [other, same, "third_span of_text"] and got["t", "c"].earlier == ["found it", "done"] and got["u", "a"].earlier == ["x"]
    assert got["t", "b"].text == "\n".join([
        "MILESTONE 2 (id b)", "  CATEGORY: fix", "  ACHIEVED: ", "  ALREADY REACHED BEFORE THIS ONE: found it",
        "  ROUTES: the agents reached this through the same code", f"  WHAT THEY HAD IN FRONT OF THEM:\n    {same}"])
    assert "  WHY IT IS REQUIRED: needed\n  ROUTES: the agents reached this through DIFFERENT code" in got["t", "a"].text
    assert E.projected(spark.createDataFrame([], KIND)).collect() == []


def test_results_replace_runs_of_their_suite(spark):
    runs = [("genesis", "s1", 1.0), ("r/a", "s1", 2.0), ("r/a", "s2", 3.0), ("r/b", "s1", 4.0)]
    results = [
        ("s1", True, 0, "king-0", "r/x", 10.0), ("s1", True, 3, "king-3", "r/a", 20.0), ("s2", False, 3, "king-3", "r/a", 30.0), ("s3", True, None, "king-9", "r/b", 40.0), ("s1", True, 5, "king-5", "r/new", 50.0),
        ("s1", True, None, "ref-a", "z/ref", 60.0), ("s1", True, None, "ref-a-nonet", "z/ref", 70.0), ("s2", True, None, "ref-b", "z/other", 80.0), ("s2", True, 1, None, "r/a", 90.0),
    ]
    got = E.merged_results(spark.createDataFrame(runs, "model string, suite string, score double"), spark.createDataFrame(results, "suite string, enabled boolean, reign int, model_key string, model_repo string, score double"))
    assert sorted(map(tuple, got.collect())) == [
        ("genesis", False, "s1", 10.0), ("r/a", False, "s1", 20.0), ("r/a", False, "s2", 3.0), ("r/b", False, "s1", 4.0), ("r/b", False, "s3", 40.0), ("ref-a-nonet", True, "s1", 70.0), ("ref-b", True, "s2", 80.0)]


def test_records_keep_the_order_of_samples(spark):
    records = spark.createDataFrame([("b", 1), ("a", 2), ("x", 3), ("b", 4)], "sample_id string, n int")
    samples = spark.createDataFrame([("b", 7), ("a", 9), ("c", 1)], "sample_id string, position int")
    assert [(r.sample_id, r.position) for r in E.in_sample_order(records, samples).collect()] == [("b", 7), ("b", 7), ("a", 9)]
