"""Volatility and trend regimes, and the market state they make up."""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebars.functions.columns import c, pct, tdiv
from tidebars.operators.blocks import Frames
from tidebars.operators.order import WindowRanks
from tidebars.operators.price import sma
from tidebars.operators.recurrences import Kernel

EPSILON = 1e-8
VOL_REGIMES = ["low", "medium", "high"]
TREND_REGIMES = ["ranging", "weak_trend", "strong_trend"]


def one_hot(name: str, prefix: str, values: list[str]) -> dict[str, Column]:
    """A boolean column per declared value; the set never depends on the data."""
    return {f"{prefix}_{v}": F.coalesce(c(name) == v, F.lit(False)) for v in values}


def rank_kernel(short: int = 20, long: int = 100) -> Kernel:
    """``_vol_rank``: the volatility's average rank among the last ``long``, as a share; ``_vol_high``: 1 if it is
    above their median, else 0.

    A window aggregate cannot compare its rows with the current one, and sorts or gathers every window
    anew; here the time of a block does not depend on ``long``.
    """

    def fn(b):
        close = b["close"].to_numpy(float)
        rank, high = np.full(len(b), np.nan), np.full(len(b), np.nan)
        if len(b) >= short + long:
            with np.errstate(all="ignore"):
                returns = close[1:] / close[:-1] - 1
                vol = sliding_window_view(returns, short).std(axis=1, ddof=1)
            first = np.arange(len(vol) - long + 1)
            end = first + long
            unknown = np.concatenate([[0], np.cumsum(~np.isfinite(vol))])
            known = unknown[end] == unknown[first]
            order = WindowRanks(np.where(np.isfinite(vol), vol, 0.0))
            now = order.ranks[end - 1]
            less = order.below(first, end, now)
            equal = order.below(first, end, now + 1) - less
            middle = [order.kth(first, end, np.full(len(first), k)) for k in ((long - 1) // 2, long // 2)]
            rank[short + long - 1 :] = np.where(known, (less + (equal + 1) / 2) / long, np.nan)
            high[short + long - 1 :] = np.where(known, vol[end - 1] > (middle[0] + middle[1]) / 2, np.nan)
        return {"_vol_rank": rank, "_vol_high": high}

    return Kernel(("_vol_rank", "_vol_high"), short + long, fn)


def volatility_regimes(
    fr: Frames, have: set[str], short: int = 20, long: int = 100, n_regimes: int = 3
):
    """Needs ``_vol_rank`` or, for two regimes, ``_vol_high`` of ``rank_kernel`` with the same lengths."""
    yield {"returns": tdiv("close", fr.lag("close")) - 1}
    year = math.sqrt(252)
    # A flat window has no spread; comparing extremes avoids a rounding residue.
    flat = fr.roll(F.max, "returns", long) == fr.roll(F.min, "returns", long)
    yield {
        "volatility_short": fr.roll(F.stddev_samp, "returns", short) * year,
        "volatility_long": F.when(~flat, fr.roll(F.stddev_samp, "returns", long) * year),
    }
    vol = F.col("volatility_short")
    mean = fr.roll(F.avg, "volatility_short", long)
    spread = fr.roll(F.stddev_samp, "volatility_short", long)
    log_vol = F.ln(vol + EPSILON)
    layer = {
        "volatility_ratio": tdiv(vol, F.col("volatility_long") + EPSILON),
        "volatility_zscore": tdiv(vol - mean, spread),
        "volatility_change": log_vol - fr.lag(log_vol, 5),
    }
    if n_regimes == 2:
        regime, values = F.when(F.col("_vol_high") == 1, "high").otherwise("low"), ["low", "high"]
        yield {**layer, "volatility_regime": regime}
    else:
        values, place = VOL_REGIMES, F.col("_vol_rank")
        regime = F.when(place < 0.33, "low").when(place >= 0.66, "high").otherwise("medium")
        yield {**layer, "volatility_regime": regime}
    yield one_hot("volatility_regime", "vol_regime", values)


def trend_strength_indicators(
    fr: Frames,
    have: set[str],
    n: int = 20,
    adx_threshold: float = 25,
    strict_alignment: bool = False,
):
    """Needs ``adx`` for its two regime columns; without it they are left out.

    ``strict_alignment`` asks all three distances to have the same sign; by default
    any three non-zero distances count as aligned.
    """
    spans, has_adx = [20, 50, 200], "adx" in have
    # A straight line through the previous n closes; x restarts in each block so that
    # large positions cost no precision.
    x = (F.col("_i") - F.col("_blk") * fr.rows_per_block).cast("double")
    w = fr.prior(n)
    full = F.count("close").over(w) == n
    level = F.max("close").over(w) == F.min("close").over(w)
    layer = {
        **sma(fr, spans),
        "regression_slope": F.when(full, F.regr_slope(F.col("close"), x).over(w)),
        "r_squared": F.when(full, F.when(level, 0.0).otherwise(F.regr_r2(F.col("close"), x).over(w))),
    }
    if has_adx:
        layer["adx_trend_regime"] = F.when(F.col("adx") > adx_threshold, "trending").otherwise("ranging")
    yield layer
    layer = {
        **{f"dist_from_sma_{k}": pct("close", f"sma_{k}") for k in spans},
        **{f"sma_{k}_slope": pct(f"sma_{k}", fr.lag(f"sma_{k}", 5)) for k in spans},
        "ma_cross_50_200": F.when(F.col("sma_50") > F.col("sma_200"), 1).otherwise(-1),
        "norm_regression_slope": tdiv("regression_slope", "close"),
    }
    if has_adx:
        layer |= one_hot("adx_trend_regime", "adx_regime", ["ranging", "trending"])
    yield layer
    signs = [F.signum(f"dist_from_sma_{k}") for k in spans]
    if strict_alignment:
        aligned = F.abs(signs[0] + signs[1] + signs[2]) == 3
    else:
        aligned = F.abs(signs[0] * signs[1] * signs[2]) == 1
    parts = [F.col("r_squared"), F.coalesce(aligned, F.lit(False)).cast("double")]
    if has_adx:
        parts.insert(0, F.col("adx") / 100)
    known = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    yield {"trend_strength": tdiv(total, known) * 100}
    strength = F.col("trend_strength")
    label = F.when(strength > 70, "strong_trend").when(strength > 40, "weak_trend").otherwise("ranging")
    yield {"trend_regime": label}
    yield one_hot("trend_regime", "trend_regime", TREND_REGIMES)


def market_state(fr: Frames, have: set[str]):
    """Nine states from volatility and trend; a change starts a new ``state_duration``."""

    def code(name: str, values: list[str]) -> Column:
        # "high" of a two-way split keeps the code 2 of the three-way one.
        return F.array_position(F.array(*[F.lit(v) for v in values]), c(name)).cast("int") - 1

    yield {
        "vol_regime_num": code("volatility_regime", VOL_REGIMES),
        "trend_regime_num": code("trend_regime", TREND_REGIMES),
    }
    names = [f"{v}_vol_{t}" for v in VOL_REGIMES for t in TREND_REGIMES]
    state = F.col("vol_regime_num") * 3 + F.col("trend_regime_num")
    label = F.get(F.array(*[F.lit(x) for x in names]), state)
    yield {"market_state": state, "market_state_desc": label}
    changed = (F.col("_i") == 0) | (F.col("market_state") != fr.lag("market_state"))
    yield {
        **one_hot("market_state_desc", "state", names),
        "state_duration": F.when(changed, F.col("_i")),
    }
