"""Turning a feature table into model input: missing values and normalisation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.functions.columns import OHLCV, PRICES, c, join_small, present, tdiv
from tidebars.operators.blocks import (
    SERIES,
    Frames,
    block_rows,
    own_rows,
    running,
    with_halo,
    with_position,
)
from tidebars.session import materialize

NULL_SHARE = 0.5
WARMUP_SMA = [200, 50, 20, 10, 5]
# Name parts that decide how a column is normalised (fixed values).
NOT_SCALED = ["regime", "is_", "in_value_area", "state"]
Z_SCORED = [
    "roc_", "macd", "vwap", "log_return", "distance", "vol_", "atr", "bb_width", "obv", "cci", "adx",
]
MIN_MAXED = ["rsi", "stoch", "mfi", "_sin_", "_cos_"]
_KEYS = {"symbol", "ts", "date", "_i", "_n"}


def null_shares(df: DataFrame) -> DataFrame:
    """One row per column: its share of NULLs. A single aggregate."""
    cols = [n for n in df.columns if n not in _KEYS]
    wide = df.agg(*[F.avg(c(n).isNull().cast("int")).alias(n) for n in cols])
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), c(n).alias("null_share")) for n in cols])
    return wide.select(F.inline(pairs))


def sparse_columns(df: DataFrame, threshold: float = NULL_SHARE) -> list[str]:
    """Columns with more NULLs than the threshold: one row of shares reaches the driver."""
    return [r["column"] for r in null_shares(df).where(F.col("null_share") > threshold).collect()]


def drop_sparse(df: DataFrame, threshold: float = NULL_SHARE) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


def warmup_windows(columns: list[str]) -> list[int]:
    """Warm-up lengths the columns ask for, longest first."""
    return [n for n in WARMUP_SMA if any(f"sma_{n}" in name for name in columns)]


def drop_warmup(df: DataFrame, by=SERIES) -> DataFrame:
    """Drop the first rows of each series: the longest SMA that the series outlasts."""
    spans = warmup_windows(df.columns)
    if not spans:
        return df
    df = with_position(df, by)
    cut = F.coalesce(*[F.when(F.col("_n") > n, n) for n in spans], F.lit(0))
    out = df.withColumn("_cut", cut).where(F.col("_i") >= F.col("_cut"))
    # Positions start at 0 again, so that what follows sees the shorter series.
    return out.withColumns({"_i": F.col("_i") - F.col("_cut"), "_n": F.col("_n") - F.col("_cut")}).drop("_cut")


def fill_scattered(df: DataFrame, by=SERIES, rows: int | None = None, only: list[str] | None = None) -> DataFrame:
    """Carry values forward; rows before the first value take that value. ``only`` names the columns that
    have NULLs, if that is known: the others need no running values."""
    df = with_position(df, by)
    cols = [n for n in (df.columns if only is None else only) if n not in {*_KEYS, *by}]
    if not cols:
        return df
    specs = {}
    for n in cols:
        specs[f"_p_{n}"] = ("last", n)
        specs[f"_f_{n}"] = ("next", n)
    out = running(df, specs, by, rows)
    return out.select(*[F.coalesce(c(f"_p_{n}"), c(f"_f_{n}")).alias(n) if n in cols else c(n) for n in df.columns])


def unique_names(df: DataFrame) -> DataFrame:
    """Repeated column names get ``_1``, ``_2``, …; the first keeps its name."""
    seen: dict[str, int] = {}
    names = []
    for n in df.columns:
        k = seen.get(n, 0)
        seen[n] = k + 1
        names.append(f"{n}_{k}" if k else n)
    return df.toDF(*names)


@dataclass
class Groups:
    """How each column is normalised."""

    price: list[str] = field(default_factory=list)
    volume: list[str] = field(default_factory=list)
    z: list[str] = field(default_factory=list)
    minmax: list[str] = field(default_factory=list)


def column_groups(schema: T.StructType) -> Groups:
    names = [f.name for f in schema if f.name not in _KEYS and isinstance(f.dataType, T.NumericType)]
    free = [n for n in names if not any(x in n for x in NOT_SCALED)]
    volume = [n for n in free if "volume" in n.lower() and "relative" not in n.lower()]
    price = [n for n in PRICES if n in free]
    z = [n for n in free if any(x in n for x in Z_SCORED) and n not in volume and n not in price]
    minmax = [n for n in free if any(x in n for x in MIN_MAXED) and n not in z]
    return Groups(price, volume, z, minmax)


def group_profile(df: DataFrame) -> DataFrame:
    """Every scaled column with its group, share of NULLs, mean and spread, from one pass over the rows."""
    groups = column_groups(df.schema)
    found = [(k, n) for k in ("price", "volume", "z", "minmax") for n in getattr(groups, k)]
    sums = [x for k, (_, n) in enumerate(found) for x in (F.avg(c(n).isNull().cast("int")).alias(f"n{k}"), F.avg(c(n)).alias(f"m{k}"), F.stddev_samp(c(n)).alias(f"s{k}"))]
    lines = [
        F.struct(F.lit(g).alias("column_group"), F.lit(n).alias("column"), F.col(f"n{k}").alias("null_share"), F.col(f"m{k}").alias("mean"), F.col(f"s{k}").alias("spread"))
        for k, (g, n) in enumerate(found)
    ]
    return df.agg(*sums).select(F.inline(F.array(*lines)))


def log_volume(df: DataFrame, cols: list[str], preserve: bool = False) -> DataFrame:
    return df.withColumns({f"{n}_log" if preserve else n: F.log1p(c(n)) for n in cols})


def z_layer(fr: Frames, cols: list[str], n: int = 20) -> dict[str, Column]:
    """Rolling z-scores named ``_z_…``; 0 where the window is flat."""
    out = {}
    for name in cols:
        mean, sd = fr.roll(F.avg, name, n), fr.roll(F.stddev_samp, name, n)
        flat = fr.roll(F.max, name, n) == fr.roll(F.min, name, n)
        score = F.when(flat, 0.0).otherwise(tdiv(c(name) - mean, sd))
        out[f"_z_{name}"] = score
    return out


def minmax_layer(fr: Frames, cols: list[str], n: int = 20) -> dict[str, Column]:
    """Rolling min-max places named ``_z_…``; 0.5 where the window is flat."""
    out = {}
    for name in cols:
        low, high = fr.roll(F.min, name, n), fr.roll(F.max, name, n)
        out[f"_z_{name}"] = F.when(high == low, 0.5).otherwise(tdiv(c(name) - low, high - low))
    return out


def back_filled(df: DataFrame, names: dict[str, str], by=SERIES, rows: int | None = None) -> DataFrame:
    """``{new: column}``: the column with the next known value in place of NULLs. ``df`` is a positioned table.

    Most columns lack values at the head of a series only; those take the first known one, from one row of statistics per
    series. Columns with holes further on, which that row shows too, need running values.
    """
    at = {n: F.when(c(x).isNotNull(), F.col("_i")) for n, x in names.items()}
    stats = [f for n, x in names.items() for f in (F.min(at[n]).alias(f"_p{n}"), F.min_by(c(x), at[n]).alias(f"_v{n}"), F.count_if(c(x).isNull()).alias(f"_m{n}"))]
    heads = materialize(df.groupBy(*by).agg(*stats))
    holes = heads.agg(*[F.max(c(f"_m{n}") - c(f"_p{n}")).alias(n) for n in names]).first()
    open_ = [n for n in names if (holes[n] or 0) > 0]
    if open_:
        df = running(df, {n: ("next", names[n]) for n in open_}, by, rows)
    plain = [n for n in names if n not in open_]
    out = join_small(df, heads.select(*by, *[c(f"{k}{n}") for n in plain for k in ("_p", "_v")]), list(by))
    filled = {n: F.when(F.col("_i") < c(f"_p{n}"), c(f"_v{n}")).otherwise(c(names[n])) for n in plain}
    return out.select(*[c(n) for n in df.columns], *[x.alias(n) for n, x in filled.items()])


def rolling_scale(
    df: DataFrame,
    z: list[str] = (),
    minmax: list[str] = (),
    n: int = 20,
    preserve: bool = False,
    backfill: bool = True,
    by=SERIES,
    rows: int | None = None,
) -> DataFrame:
    """Z-score and min-max columns over the last ``n`` rows, in one pass.

    In place (``close`` is kept as ``close_og``), or beside the original as ``_norm``.
    ``backfill`` gives warm-up rows the first later value, which looks ahead.
    """
    z, minmax = [n_ for n_ in z if n_ in df.columns], [n_ for n_ in minmax if n_ in df.columns]
    cols = [*z, *minmax]
    df = with_position(df, by)
    if not cols:
        return df
    size = block_rows(n, 0, rows)
    fr = Frames(tuple(by), size)
    out = with_halo(df, n, 0, size).withColumns({**z_layer(fr, z, n), **minmax_layer(fr, minmax, n)})
    out = own_rows(out, n, 0, size)
    if backfill:
        out = back_filled(materialize(out), {f"_b_{x}": f"_z_{x}" for x in cols}, by, rows)
        scaled = {x: c(f"_b_{x}") for x in cols}
    else:
        scaled = {x: c(f"_z_{x}") for x in cols}
    final = []
    for name in df.columns:
        if name in scaled and not preserve:
            final.append(scaled[name].alias(name))
        else:
            final.append(c(name))
    if preserve:
        final += [scaled[x].alias(f"{x}_norm") for x in cols]
    elif "close" in cols:
        final.append(c("close").alias("close_og"))
    return out.select(*final)


def normalize(
    df: DataFrame,
    preserve: bool = False,
    n: int = 20,
    backfill: bool = True,
    by=SERIES,
    rows: int | None = None,
) -> DataFrame:
    """Log of volumes, then z-scores and min-max places by column group."""
    g = column_groups(df.schema)
    df = log_volume(df, g.volume, preserve)
    volume = [f"{x}_log" for x in g.volume] if preserve else g.volume
    return rolling_scale(df, [*g.price, *volume, *g.z], g.minmax, n, preserve, backfill, by, rows)


def transform(
    df: DataFrame, preserve: bool = False, n: int = 20, by=SERIES, rows: int | None = None
) -> DataFrame:
    """Drop sparse columns, the warm-up rows, fill what is left, then normalise."""
    df = with_position(unique_names(df), by)
    shares = {r["column"]: r["null_share"] for r in null_shares(df).collect()}
    if any(s > 0 for s in shares.values()):
        df = df.drop(*[k for k, s in shares.items() if s > NULL_SHARE])
        df = materialize(drop_warmup(df, by))
        left = [r["column"] for r in null_shares(df).where("null_share > 0").collect()]
        df = fill_scattered(df, by, rows, left)
    return normalize(materialize(df), preserve, n, True, by, rows)


def one_hot_columns(df: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """0/1 columns for declared values of string columns, which they replace."""
    out = df
    for name, options in values.items():
        hot = {f"{name}_{v}": F.coalesce((c(name) == v).cast("int"), F.lit(0)) for v in options}
        out = out.withColumns(hot).drop(name)
    return out
