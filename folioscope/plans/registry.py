"""Registry of runnable queries, each with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.steps import LINK_DAY
from folioscope.plans.tables_sql import TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Output types: l bigint, n bigint or null (as text), s text, b boolean, m money, d day, t second.
_SPARK_CASTS = {
    "l": lambda c: c.cast("bigint"),
    "n": lambda c: c.cast("bigint").cast("string"),
    "s": lambda c: c.cast("string"),
    "b": lambda c: c.cast("boolean"),
    "m": lambda c: c.cast("decimal(18,2)").cast("string"),
    "d": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
}
_SQL_CASTS = {
    "l": "CAST({c} AS BIGINT)",
    "n": "CAST(CAST({c} AS BIGINT) AS VARCHAR)",
    "s": "CAST({c} AS VARCHAR)",
    "b": "CAST({c} AS BOOLEAN)",
    "m": "CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)",
    "d": "strftime({c}, '%Y-%m-%d')",
    "t": "strftime({c}, '%Y-%m-%d %H:%M:%S')",
}


def _columns(shape: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in shape.split(",")]  # type: ignore[misc]


def _with_tables(body: str) -> str:
    """Puts the definitions of the model tables that the body mentions in front of it."""
    needed: set[str] = set()
    texts = [body]
    while texts:
        words = set(re.findall(r"\w+", texts.pop()))
        for name in words & TABLES.keys() - needed:
            needed.add(name)
            texts.append(TABLES[name])
    parts = [f"{name} AS ({TABLES[name]})" for name in TABLES if name in needed]
    return f"WITH {', '.join(parts)} " if parts else ""


def query(name: str, shape: str, sql: str | None = None, link_day: str = LINK_DAY):
    """Registers ``fn(model) -> DataFrame``; both engines return the columns of ``shape``."""
    columns = _columns(shape)

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from folioscope.sources.sample import Model

            df = fn(Model(spark, sf_dir))
            return df.select(*[_SPARK_CASTS[t](F.col(c)).alias(c) for c, t in columns])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            picked = ", ".join(f"{_SQL_CASTS[t].format(c=c)} AS {c}" for c, t in columns)
            text = f"{_with_tables(sql)}SELECT {picked} FROM ({sql}) AS result"
            SQL[name] = text.replace(f"DATE '{LINK_DAY}'", f"DATE '{link_day}'")
        return fn

    return register
