"""The feature registry, and the plan that computes any set of features together."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidebars.functions.columns import OHLCV
from tidebars.operators import calendar, decompose, price, regime, spectral, technical, volume
from tidebars.operators import recurrences as rec
from tidebars.operators.blocks import (
    SERIES,
    Frames,
    block_rows,
    carried,
    home_block,
    own_rows,
    running_within,
    with_halo,
    with_position,
)
from tidebars.session import materialize

log = logging.getLogger(__name__)
MIN_ROWS = 200


@dataclass(frozen=True)
class Feature:
    """A named group of columns.

    ``row`` features need only the row; ``window`` features are generators of column layers
    ``fn(frames, known columns)`` that see ``back`` earlier and ``ahead`` later rows; ``kernel`` features are block functions;
    ``series`` features take a positioned table. ``carry`` turns a window output into a
    running value once blocks are joined up.
    """

    name: str
    kind: str
    fn: Callable | None = None
    back: int = 0
    ahead: int = 0
    needs: tuple[str, ...] = ()
    kernels: tuple[rec.Kernel, ...] = ()
    carry: tuple[tuple[str, str], ...] = ()
    default: bool = True


REGISTRY: dict[str, Feature] = {}


def register(feature: Feature) -> Feature:
    REGISTRY[feature.name] = feature
    return feature


def register_feature(
    name: str, fn: Callable, back: int = 0, ahead: int = 0, needs: Iterable[str] = ()
) -> Feature:
    """Add a window feature of your own: a generator ``fn(frames, have)`` of column layers."""
    return register(Feature(name, "window", fn, back, ahead, tuple(needs), default=False))


for _f in [
    Feature("moving_averages", "window", price.moving_averages, back=199),
    Feature("ema", "kernel", kernels=tuple(rec.ema_kernel(n) for n in rec.EMA_SPANS)),
    Feature("rate_of_change", "window", price.rate_of_change, back=60),
    Feature("average_true_range", "kernel", kernels=(rec.atr_kernel(),)),
    Feature("bollinger_bands", "window", price.bollinger_bands, back=19),
    Feature("support_resistance", "window", price.support_resistance, back=19),
    Feature("volume_moving_averages", "window", volume.volume_moving_averages, back=59),
    Feature("volume_rate_of_change", "window", volume.volume_rate_of_change, back=20),
    Feature(
        "on_balance_volume", "window", volume.on_balance_volume, back=1, carry=(("obv", "sum"),)
    ),
    Feature(
        "volume_profile", "kernel", volume.profile_flags, kernels=(volume.profile_kernel(),)
    ),
    Feature("vwap", "window", volume.vwap),
    Feature("vwap_session", "series", volume.session_vwap, default=False),
    Feature("money_flow_index", "window", volume.money_flow_index, back=14),
    Feature("relative_strength_index", "kernel", kernels=(rec.rsi_kernel(),)),
    Feature("macd", "kernel", kernels=(rec.macd_kernel(),)),
    Feature("average_directional_index", "kernel", kernels=(rec.adx_kernel(),)),
    Feature("stochastic_oscillator", "window", technical.stochastic_oscillator, back=17),
    Feature("commodity_channel_index", "window", technical.commodity_channel_index, back=38),
    Feature(
        "ichimoku_cloud", "window", technical.ichimoku_cloud, back=77, ahead=26, default=False
    ),
    Feature("time_of_day", "row", calendar.time_of_day),
    Feature("day_of_week", "row", calendar.day_of_week),
    Feature("time_of_week", "row", calendar.time_of_week),
    Feature("time_of_month", "row", calendar.time_of_month),
    Feature("seasonal_decompose", "series", decompose.classical),
    Feature("stl_decomposition", "kernel", decompose.with_stl_strength, kernels=(decompose.stl_kernel(),)),
    Feature("mstl_decomposition", "kernel", kernels=(decompose.mstl_kernel(),)),
    Feature("holiday_features", "row", calendar.holiday_features),
    Feature(
        "volatility_regimes",
        "window",
        regime.volatility_regimes,
        back=120,
        kernels=(regime.rank_kernel(),),
    ),
    Feature(
        "trend_strength_indicators",
        "window",
        regime.trend_strength_indicators,
        back=204,
        needs=("average_directional_index",),
    ),
    Feature(
        "market_state_indicators",
        "window",
        regime.market_state,
        back=1,
        needs=("volatility_regimes", "trend_strength_indicators"),
        carry=(("state_duration", "max"),),
    ),
    Feature("log_returns", "window", price.log_returns, back=1),
    Feature("fast_fourier_transforms", "series", spectral.dominant_cycles, needs=("log_returns",)),
]:
    register(_f)


def resolve(names: Iterable[str] | None = None) -> list[Feature]:
    """The features asked for and what they need, needs first."""
    done: dict[str, Feature] = {}

    def visit(name: str):
        if name not in done:
            for need in REGISTRY[name].needs:
                visit(need)
            done[name] = REGISTRY[name]

    for name in names or [f.name for f in REGISTRY.values() if f.default]:
        visit(name)
    return list(done.values())


def check_bars(df: DataFrame) -> None:
    missing = [n for n in OHLCV if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}: features need open, high, low, close, volume")


def preconditions(df: DataFrame, by=SERIES) -> DataFrame:
    """Per symbol: rows, NULLs in the bar columns, and whether they suffice for every feature."""
    check_bars(df)
    nulls = sum((F.count_if(F.col(n).isNull()) for n in OHLCV[1:]), F.count_if(F.col("open").isNull()))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("n_nulls")).withColumns(
        {"short": F.col("n_rows") < MIN_ROWS, "has_nulls": F.col("n_nulls") > 0}
    )


def with_params(features: list[Feature], params: dict[str, dict]) -> list[Feature]:
    """Features with arguments of their own; ``back`` and ``ahead`` among them are the reach of a window
    that a longer parameter needs. Block kernels take none."""
    out = []
    for f in features:
        own = dict(params.get(f.name) or {})
        reach = {k: own.pop(k) for k in ("back", "ahead") if k in own}
        if own and f.kind == "kernel":
            raise ValueError(f"{f.name} takes no parameters")
        out.append(replace(f, fn=partial(f.fn, **own) if own else f.fn, **reach))
    return out


def generate(
    bars: DataFrame,
    names: Iterable[str] | dict[str, dict] | None = None,
    by=SERIES,
    rows: int | None = None,
    strict: bool = True,
    keep_position: bool = False,
) -> DataFrame:
    """Bars with the named features (all default ones when none are named).

    ``names`` may map a feature to its parameters, as ``{"volatility_regimes": {"n_regimes": 2}}``.
    Order: row features; block kernels, written once; features that join per-series statistics,
    written once; every bounded window and the running values within blocks in one shuffle, written before the
    blocks' summaries are read.
    With ``strict=False`` a feature that cannot be planned is logged and left out, and a kernel that
    fails on a block gives NULLs there.
    """
    check_bars(bars)
    features = with_params(resolve(names), names if isinstance(names, dict) else {})
    df = placed = with_position(bars, by)

    def attempt(f: Feature, step: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
        try:
            return step(df)
        except (AnalysisException, ValueError, KeyError) as e:
            if strict:
                raise
            log.error("feature %s left out: %s", f.name, e)
            return df

    for f in features:
        if f.kind == "row":
            df = attempt(f, f.fn, df)
    kernels = [k for f in features for k in f.kernels]
    if kernels:
        df = materialize(rec.apply_kernels(df, kernels, by, rows, strict))
    joined = False
    for f in features:
        if f.kind == "kernel" and f.fn:
            df, joined = attempt(f, lambda d, f=f: f.fn(d, by=by), df), True
        elif f.kind == "series" and not f.needs:
            df, joined = attempt(f, lambda d, f=f: f.fn(d, by=by, rows=rows), df), True

    windows = [f for f in features if f.kind == "window"]
    if windows:
        df = materialize(df) if joined else df
        # Windows of windows: a feature that builds on others adds to their reach.
        reach: dict[str, int] = {}
        for f in windows:
            reach[f.name] = f.back + max((reach.get(n, 0) for n in f.needs), default=0)
        back, ahead = max(reach.values()), max(f.ahead for f in windows)
        size = block_rows(back, ahead, rows)
        df = with_halo(df, back, ahead, size)
        df = add_layers(df, windows, Frames(tuple(by), size), strict)
        # Running values start in the same pass over the blocks; what is carried over their borders comes after.
        carry = {col: (kind, col) for f in windows for col, kind in f.carry if col in df.columns}
        if carry:
            df = df.withColumns(running_within(carry, by, F.col("_blk") == home_block(size)))
        df = own_rows(df, back, ahead, size, keep_block=True)
    else:
        carry = {}

    if carry:
        order = [n for n in df.columns if not n.startswith("_l_")]
        df = materialize(df)
        df = carried(df, df, carry, by)
        if "state_duration" in carry:
            df = df.withColumn("state_duration", F.col("_i") - F.col("state_duration") + 1)
        df = df.select(*[F.col(f"`{n}`") for n in order if n != "_blk"])
    df = df.drop("_blk")
    for f in features:
        if f.kind == "series" and f.needs:
            # Its own pass reads the positioned bars, not the plan of all windows.
            values = base_returns(placed, by, rows)
            df = attempt(f, lambda d, f=f, v=values: f.fn(d, by=by, values=v), df)
    temps = [n for n in df.columns if n.startswith("_") and n not in ("_i", "_n")]
    return df.drop(*temps) if keep_position else df.drop("_i", "_n", *temps)


def base_returns(base: DataFrame, by, rows: int | None) -> DataFrame:
    fr = Frames(tuple(by))
    narrow = with_halo(base.select(*by, "_i", "_n", "close"), 1, 0, rows)
    return own_rows(narrow.withColumns(next(price.log_returns(fr, set()))), 1, 0, rows)


def add_layers(df: DataFrame, features: list[Feature], fr: Frames, strict: bool) -> DataFrame:
    """Run the features' layers side by side: layer k of all of them is one projection."""
    open_: dict[str, Iterator] = {}
    waiting = list(features)
    names = {f.name for f in features}
    keep = list(df.columns)
    while waiting or open_:
        for f in list(waiting):
            if not any(n in open_ or n in {w.name for w in waiting} for n in f.needs if n in names):
                open_[f.name] = f.fn(fr, set(df.columns))
                waiting.remove(f)
        layer = {}
        for name, steps in list(open_.items()):
            new = next(steps, None)
            if new is None:
                del open_[name]
                continue
            new = {k: v for k, v in new.items() if k not in df.columns}
            if not strict:
                try:
                    df.withColumns(new).schema
                except AnalysisException as e:
                    log.error("feature %s left out: %s", name, e)
                    del open_[name]
                    continue
            layer |= new
        if layer:
            df = df.withColumns(layer)
            keep += [n for n in layer if not n.startswith("_")]
    return df.select(*[F.col(f"`{n}`") for n in keep])


def generated_features(df: DataFrame, by=SERIES) -> DataFrame:
    """The feature columns of a table, one row each: type, rows that are known, NULLs, and the first known
    position (NULL for a table without ``_i``). One pass with map-side sums."""
    base = {*by, "date", "ts", "_i", "_n", *OHLCV}
    found = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name not in base]
    at = F.col("_i") if "_i" in df.columns else F.lit(None).cast("long")
    sums = [x for k, (n, _) in enumerate(found) for x in (F.count(F.col(f"`{n}`")).alias(f"k{k}"), F.min(F.when(F.col(f"`{n}`").isNotNull(), at)).alias(f"f{k}"))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *sums)
    lines = [
        F.struct(F.lit(n).alias("feature"), F.lit(t).alias("type"), F.col(f"k{k}").alias("n_known"), (F.col("n") - F.col(f"k{k}")).alias("n_null"), F.col(f"f{k}").alias("first_known"))
        for k, (n, t) in enumerate(found)
    ]
    return row.select(F.inline(F.array(*lines)))
