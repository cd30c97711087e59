"""Registry of runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import round_scaled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_NUDGE = 0.013


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; timestamps without zone become session timestamps (UTC)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, with one kind of zero. A nudge far below the last
    digit keeps exact ties from depending on summation order."""
    nudge = F.lit(_NUDGE * 10.0**-digits)
    return df.select(
        *[(round_scaled(F.col(f"`{c}`") + nudge, digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def r(expr: str, digits: int = 6) -> str:
    """The SQL twin of :func:`rounded`."""
    return f"(round(CAST(({expr}) AS DOUBLE) + {_NUDGE * 10.0**-digits!r}, {digits}) + 0.0)"


def rs(alias: str, *cols: str) -> str:
    """Rounded columns of an alias, keeping their names."""
    return ", ".join(f"{r(f'{alias}.{c}')} AS {c}" for c in cols)


#: Upper tail of the limit law of Kolmogorov at ``x``: the theta series below 0.3, the alternating one above.
KOLMOGOROV_SQL = """CASE WHEN x IS NULL THEN NULL WHEN x <= 0 THEN 1.0
  WHEN x < 0.3 THEN 1 - sqrt(2 * pi()) / x * list_sum([exp(-((2 * k - 1) ** 2) * pi() ** 2 / (8 * x * x)) for k in range(1, 6)])
  ELSE GREATEST(0.0, LEAST(1.0, 2 * list_sum([CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * x * x) for k in range(1, 101)]))) END"""
