"""Votes on pairs."""

from __future__ import annotations

from millrace.operators import milestones as M


def test_votes_after_the_second_round_do_not_count(spark):
    votes = [
        ("open", 1, 0.4), ("open", 2, 0.6), ("open", 3, 1.0), ("open", 6, 1.0), ("open", 7, 0.0), ("sure", 1, 1.0), ("sure", 2, 0.9), ("sure", 3, 0.0), ("sure", 7, 0.0),
        ("none", 1, None), ("none", 7, 1.0), ("second", 3, 1.0), ("late", 7, 1.0), ("unplaced", None, 1.0),
    ]
    got = M.pair_means(spark.createDataFrame(votes, "pair string, nth int, vote double")).collect()
    assert {r.pair: (round(r.weight, 9), r.undecided) for r in got} == {"open": (0.75, True), "sure": (0.95, False), "none": (0.0, False), "second": (0.0, False)}
