"""Preparing a feature table for a tree model: lists, categories, numbers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.functions.columns import c, join_small

ONE_HOT_LIMIT = 10


def expand_periods(df: DataFrame, col: str = "fft_dominant_periods") -> DataFrame:
    """First three periods, their mean and their maximum instead of the list."""
    if col not in df.columns:
        return df
    arr = c(col)
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    new = {f"fft_dom_period_{k + 1}": F.get(arr, F.lit(k)).cast("double") for k in range(3)}
    new["fft_dom_period_mean"] = F.try_divide(total, F.size(arr))
    new["fft_dom_period_max"] = F.array_max(arr).cast("double")
    return df.withColumns(new).drop(col)


def string_columns(df: DataFrame, but: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in but]


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Exact distinct counts of all columns in one pass; one row reaches the driver."""
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), c(n).alias("v")) for n in cols])
    values = df.select(F.inline(pairs)).where(F.col("v").isNotNull()).distinct()
    return {r["k"]: r["count"] for r in values.groupBy("k").count().collect()}


def codes(df: DataFrame, col: str) -> DataFrame:
    """Alphabetical codes of a column's values: ``value, code``. Runs over distinct values."""
    from tidebars.operators.blocks import with_position

    values = df.select(c(col).alias("value")).where(c(col).isNotNull()).distinct()
    placed = with_position(values.withColumn("_all", F.lit(0)), ["_all"], ["value"])
    return placed.select("value", F.col("_i").alias("code"))


def encode_categories(
    df: DataFrame,
    target: str | None = None,
    keep: list[str] = ("symbol",),
    limit: int = ONE_HOT_LIMIT,
    values: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One-hot columns (first value dropped) up to ``limit`` values, sorted codes beyond.

    Which of the two a column gets depends on the data; columns named in ``values`` are one-hot over
    the values given there, so their schema does not.
    """
    values = values or {}
    cols = string_columns(df, [*keep, *([target] if target else [])])
    sizes = distinct_counts(df, [n for n in cols if n not in values])
    for col in cols:
        if col in values or sizes.get(col, 0) <= limit:
            # At most ``limit`` values reach the driver.
            options = values[col] if col in values else sorted(r[0] for r in df.select(c(col)).where(c(col).isNotNull()).distinct().collect())
            df = df.withColumns(
                {f"{col}_{v}": F.coalesce(c(col) == v, F.lit(False)).cast("int") for v in options[1:]}
            )
        else:
            table = codes(df, col).withColumnsRenamed({"value": col, "code": f"{col}_encoded"})
            df = join_small(df, table, [col], "left")
        df = df.drop(col)
    return df


def numeric_only(df: DataFrame, keep: list[str] = ("symbol", "ts")) -> DataFrame:
    """Numbers and booleans (as 0/1), and the columns named in ``keep``."""
    out = []
    for f in df.schema:
        if f.name in keep or isinstance(f.dataType, T.NumericType):
            out.append(c(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(c(f.name).cast("int").alias(f.name))
    return df.select(*out)


def model_matrix(
    df: DataFrame, target: str = "close", limit: int = ONE_HOT_LIMIT, values: dict[str, list[str]] | None = None, keep: list[str] = ("symbol",)
) -> DataFrame:
    """Keys (``keep`` and ``ts``), target and numeric features; the target's unscaled twin is not a feature."""
    df = numeric_only(encode_categories(expand_periods(df), target, list(keep), limit, values), [*keep, "ts"])
    return df.drop("close_og", "_i", "_n") if target != "close_og" else df.drop("_i", "_n")
