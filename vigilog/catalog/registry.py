"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from ..sources.logs import LOGS_SQL, RAW_SQL, SCORE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is the same question for the checking engine."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


def on_logs(body: str, **ctes: str) -> str:
    """``body`` with the log view (and further named parts, in order) in front."""
    parts = [f"logs AS ({LOGS_SQL})"] + [f"{name} AS ({text})" for name, text in ctes.items()]
    return "WITH " + ", ".join(parts) + " " + body


def on_raw(body: str, **ctes: str) -> str:
    return on_logs(body, raw_logs=RAW_SQL, **ctes)


def on_scored(body: str, **ctes: str) -> str:
    scored = f"SELECT *, {SCORE_SQL} AS anomaly_score, ({SCORE_SQL}) > 0.95e0 AS is_anomaly FROM logs"
    return on_logs(body, scored=scored, **ctes)
