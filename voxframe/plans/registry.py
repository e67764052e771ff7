"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (("WITH RECURSIVE " if any("UNION ALL" in c and "RECURSE" in c for c in ctes) else "WITH ") + ", ".join(ctes) + ("" if sql.startswith(",") else " ") if ctes else "") + sql
        return f

    return add
