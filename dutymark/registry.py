"""Queries by name, each with the tables it takes and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dutymark.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None):
    """Register f(*DataFrames of tables) as a query; sql may use the tables by name."""
    names = tuple(tables.split())

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, t) for t in names))
        if sql is not None:
            head, body = with_views(names, "").strip(), sql.strip()
            if head and body.startswith("with "):
                recursive = body.startswith("with recursive ")
                body = body.removeprefix("with recursive ").removeprefix("with ")
                head = ("with recursive " if recursive else "with ") + head.removeprefix("with ") + ","
            ORACLE_SQL[name] = f"{head}\n{body}"
        return f

    return register
