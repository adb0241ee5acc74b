"""Registry of named queries, each with the DuckDB SQL that states its meaning."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of a Tables as a query under its own name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """Register Spark SQL over the tables (as views); the oracle is the same text if none is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Tables(spark, sf_dir).sql(sql)

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of a folder as attributes; they are read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **args: object) -> DataFrame:
        """The query's tables are common table expressions before it, so the session's views stay as they are."""
        tables = ", ".join(f"{name} AS (SELECT * FROM parquet.`{self.sf_dir}/{name}.parquet`)" for name in TABLES if _mentions(text, name))
        own = re.match(r"\s*WITH(\s+RECURSIVE)?\s", text, re.I)
        whole = f"WITH{own[1] or ''} {tables}, {text[own.end() :]}" if own else f"WITH {tables} {text}"
        return self.spark.sql(whole if tables else text, args=args or None)


def _mentions(text: str, name: str) -> bool:
    low = text.lower()
    at = low.find(name)
    while at >= 0:
        before, after = low[at - 1] if at else " ", low[at + len(name)] if at + len(name) < len(low) else " "
        if not (before.isalnum() or before == "_") and not (after.isalnum() or after == "_"):
            return True
        at = low.find(name, at + 1)
    return False
