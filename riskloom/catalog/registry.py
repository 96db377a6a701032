"""Registry of the named queries with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def snake(name: str) -> str:
    s = name.replace("%", "pct").replace("σ", "s")
    return re.sub(r"[^0-9a-z]+", "_", s.lower()).strip("_")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Stable output: snake-case names, doubles rounded (no negative zero), integers as bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        cols.append(c.alias(snake(f.name)))
    return df.select(*cols)


def tidy_sql(body: str, doubles: str = "", digits: int = 6) -> str:
    """SQL twin of :func:`tidy` for the named double columns of ``body``."""
    cols = doubles.split()
    if not cols:
        return body
    rep = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({body})"


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; its result passes through :func:`tidy`."""

    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco
