"""Registration of queries and the views they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slipweave.catalog.views import BASE, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Base tables and derived views of one test directory, read lazily by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in BASE:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                view = VIEWS[name]
                needed = {u: getattr(self, u) for u in view.uses}
                self._seen[name] = self.spark.sql(view.spark, **needed)
        return self._seen[name]


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []
    for n in names:
        for d in [*_closure(tuple(u for u in VIEWS[n].uses if u in VIEWS)), n]:
            if d not in ordered:
                ordered.append(d)
    return ordered


def oracle(views: tuple[str, ...], sql: str) -> str:
    """Inline the views as common table expressions in front of ``sql``."""
    ctes = [f"{v} as (\n{VIEWS[v].duck}\n)" for v in _closure(views)]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with recursive " + ",\n".join([*ctes, body[5:]])
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(tuple(views.split()), sql)
        return fn

    return register
