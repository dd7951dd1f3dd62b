"""One entry per query: the Spark plan, its output columns and the check SQL.

The column list is written once and applied to both sides, so names and types
cannot drift: ``name:kind`` with kind ``s`` text, ``i`` integer, ``f`` number
rounded to 6 places (``f2`` to 2), ``t`` timestamp text, ``d`` date text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.plans.fixtures_sql import FIXTURES
from wattline.sources.fixtures import Fixtures


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[Fixtures], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Fixtures(spark, sf_dir))
        return df.select(*[_spark_cast(F.col(name), kind).alias(name) for name, kind in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"{_sql_cast(name, kind)} AS {name}" for name, kind in self.columns)
        return f"{with_clause(self.sql)}SELECT {cols} FROM (\n{self.sql.strip()}\n) AS final_rows"


REGISTRY: dict[str, Query] = {}


def query(key: str, columns: str, sql: str | None = None):
    """Register ``f(fixtures) -> DataFrame`` under ``key``."""

    def add(build):
        pairs = tuple(tuple(part.split(":")) for part in columns.split())
        assert key not in REGISTRY, key
        REGISTRY[key] = Query(key, build, pairs, sql)
        return build

    return add


def _spark_cast(col: Column, kind: str) -> Column:
    if kind == "s":
        return col.cast("string")
    if kind == "i":
        return col.cast("long")
    if kind == "t":
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    if kind == "d":
        return F.date_format(col, "yyyy-MM-dd")
    places = int(kind[1:] or 6)
    return F.round(col.cast("double") + F.lit(_nudge(places)), places)


def _nudge(places: int) -> float:
    """Lifts exact halves off the rounding edge, where engines round differently."""
    return 2e-4 * 10.0**-places


def _sql_cast(name: str, kind: str) -> str:
    if kind == "s":
        return f"CAST({name} AS VARCHAR)"
    if kind == "i":
        return f"CAST({name} AS BIGINT)"
    if kind == "t":
        return f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    if kind == "d":
        return f"strftime(CAST({name} AS DATE), '%Y-%m-%d')"
    places = int(kind[1:] or 6)
    return f"round(CAST({name} AS DOUBLE) + CAST({_nudge(places)!r} AS DOUBLE), {places}) + 0.0"


def with_clause(sql: str) -> str:
    """The WITH clause for every fixture the text names, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in FIXTURES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_name(name)

    def visit_name(name: str) -> None:
        body = FIXTURES[name]
        for dep in FIXTURES:
            if dep != name and dep not in order and re.search(rf"\b{dep}\b", body):
                visit_name(dep)
        if name not in order:
            order.append(name)

    visit(sql)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({FIXTURES[n].strip()})" for n in order) + "\n"
