"""Column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ["open", "high", "low", "close"]
OHLCV = [*PRICES, "volume"]


def c(x: str | Column) -> Column:
    return F.col(f"`{x}`") if isinstance(x, str) else x


def tdiv(num, den) -> Column:
    """Division that gives NULL for a zero divisor, also under ANSI mode."""
    return F.try_divide(c(num), c(den))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def pct(now, then) -> Column:
    return (tdiv(now, then) - 1) * 100


def numeric_columns(df: DataFrame, but: list[str] = ()) -> list[str]:
    """Numeric columns in schema order (booleans excluded)."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in but]


def present(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def join_small(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join per-series or per-block statistics.

    No broadcast hint: Spark broadcasts by measured size. Beyond that a plain equi-join
    keeps the partitioning ``df`` already has, and AQE splits a hot series.
    """
    return df.join(stats, list(keys), how)
