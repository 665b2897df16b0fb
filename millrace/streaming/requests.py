"""Requests and their answers as two streams: who was answered, when, and who never was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlated(requests: DataFrame, answers: DataFrame, patience: str, late: str = "1 minute") -> DataFrame:
    """(id, asked_at, request, answered_at, answer) of every request: its answer, or nulls once `patience` is
    over. requests: (id, asked_at, request); answers: (id, answered_at, answer).

    An answer counts within `patience` of its request. Repeated requests of an id and repeated answers to it count
    once, while the watermark, `late` behind the newest event, remembers them: the first to arrive. Answers to nobody, and those that
    come too early or too late, go. State ends with the watermark; the same plan over tables gives the same rows.
    """
    asked = requests.where("id IS NOT NULL").withWatermark("asked_at", late).dropDuplicatesWithinWatermark(["id"])
    told = answers.where("id IS NOT NULL").select(F.col("id").alias("answer_to"), "answered_at", "answer").withWatermark("answered_at", late).dropDuplicatesWithinWatermark(["answer_to"])
    fits = F.expr(f"id = answer_to AND answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {patience}")
    return asked.join(told, fits, "leftOuter").select("id", "asked_at", "request", "answered_at", "answer")


def single_flight(calls: DataFrame, late: str = "1 minute") -> DataFrame:
    """The calls that do the work: of calls (key, at, ...) the first of each key to arrive, while the watermark
    remembers it; the others wait for its answer, which `correlated` hands to all of them by key."""
    return calls.where("key IS NOT NULL").withWatermark("at", late).dropDuplicatesWithinWatermark(["key"])
