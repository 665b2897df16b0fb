"""All registered queries of the engine with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "millrace.operators.leaks",
    "millrace.operators.corpus",
    "millrace.operators.joins",
    "millrace.operators.aggregates",
    "millrace.operators.windows",
    "millrace.operators.usage",
    "millrace.operators.text_quality",
    "millrace.operators.text_search",
    "millrace.operators.vectors",
    "millrace.operators.sampling",
    "millrace.operators.validation",
    "millrace.operators.dml",
    "millrace.operators.transcripts",
    "millrace.operators.lifecycle",
    "millrace.operators.observations",
    "millrace.operators.turns",
    "millrace.operators.milestones",
    "millrace.operators.records",
    "millrace.operators.weights",
    "millrace.operators.replies",
    "millrace.operators.signals",
    "millrace.operators.toolcalls",
    "millrace.operators.claims",
    "millrace.operators.imports",
    "millrace.operators.evidence",
    "millrace.operators.paths",
)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load() -> None:
    for name in MODULES:
        import_module(name)
