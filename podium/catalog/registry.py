"""Registered queries: a Spark callable and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans import is_small, pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
MATERIALIZED: set[str] = set()


class Tables:
    """The driver tables of one directory, read lazily."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def once(self, name: str, make: Callable[[Tables], DataFrame]) -> DataFrame:
        """A derived table, written once for all its uses in one query unless it derives from little."""
        if name not in self.made:
            df = make(self)
            self.made[name] = df if is_small(df) else pin(df)
        return self.made[name]


def cte(name: str, sql: str, materialized: bool = False) -> None:
    """Define shared SQL; later definitions may use earlier ones. A materialized one is computed once for all its uses."""
    CTES[name] = sql
    if materialized:
        MATERIALIZED.add(name)


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the shared definitions it needs, in definition order."""
    import re
    needed: set[str] = set()
    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])
    visit(sql)
    parts = [f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({CTES[n]})" for n in CTES if n in needed]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name`` with its SQL equivalent."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn
    return register
