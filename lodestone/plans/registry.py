"""Queries by name, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return add


def graph_query(name: str, text: str, sql: str, graph: str = "trade", params: dict | None = None) -> None:
    """A query in the graph language over one of the driver's graphs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..cypher.binder import run as bind
        from . import catalog

        return bind(getattr(catalog, f"{graph}_graph")(spark, sf_dir), text, params)

    query(name, sql)(run)
