"""Names of the core queries, with their builders and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a builder under a name, with the SQL that gives the same result if there is one."""

    def put(build: Builder) -> Builder:
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return put
