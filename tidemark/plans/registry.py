"""The named queries: each pairs a Spark plan with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        REGISTRY[name] = Entry(run, sql)
        return run

    return register


def load_all() -> dict[str, Entry]:
    from . import (  # noqa: F401
        queries_catalog,
        queries_functions,
        queries_jobs,
        queries_leases,
        queries_report,
        queries_streams,
        queries_text,
        queries_vectors,
    )

    return REGISTRY
