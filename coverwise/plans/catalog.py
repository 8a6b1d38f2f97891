"""The query catalogue: every registered query and its DuckDB oracle.

A query is a callable ``(spark, sf_dir) -> DataFrame`` that reads the driver
tables (or data Spark derives from them). ``oracle`` is the equivalent DuckDB
statement over the same tables, or ``None`` where only a row-count check is
possible.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    ops: tuple[str, ...]    # SURVEY section 2 operator ids it covers


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None, ops: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = Query(name, fn, oracle, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from . import (medallion_q, retrieval_q, qa_q, evaluation_q, drift_q,  # noqa: F401
                   streaming_q, tenancy_q, hierarchy_q, synonyms_q)
    return QUERIES
