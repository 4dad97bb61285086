"""The registered queries of the disclosure-control operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers fn(read) under a name; read(table) gives a table of the scale at hand."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


from . import queries_cells, queries_facts, queries_plans, queries_protect, queries_risk, queries_utility  # noqa: E402, F401
