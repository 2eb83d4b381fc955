"""Seasonal decomposition: classical, STL and multi-period STL of the close.

All three work on bounded blocks. A moving average or a LOESS fit sees a fixed number
of neighbours, and so does any finite chain of them; with a halo that wide, a block
gives the values the whole series would give. See Cleveland et al., "STL: A
Seasonal-Trend Decomposition Procedure Based on Loess", 1990, and Bandara, Hyndman and
Bergmeir, "MSTL", 2021.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.columns import join_small, tdiv
from tidebars.operators.blocks import SERIES, Frames, own_rows, with_halo
from tidebars.operators.recurrences import Kernel
from tidebars.session import materialize

PERIOD = 160
STL_SEASONAL = 13
STL_INNER = 5


def classical(df: DataFrame, period: int = PERIOD, by=SERIES, rows: int | None = None) -> DataFrame:
    """Centred moving average, phase means of what is left, and the remainder.

    Trend ends are straight lines through the nearest ``period`` trend values. Series
    shorter than two periods get NULLs. ``df`` must be positioned.
    """
    half = period // 2
    fr = Frames(tuple(by))
    seated = with_halo(df, half, half, rows)
    span = fr.rows(-half, half)
    if period % 2:
        mean = F.sum("close").over(span) / period
    else:
        edges = fr.lag("close", half) + fr.lead("close", half)
        mean = (F.sum("close").over(span) - 0.5 * edges) / period
    full = (F.col("_i") >= half) & (F.col("_i") < F.col("_n") - half)
    seated = seated.withColumn("_mid", F.when(full & (F.col("_n") >= 2 * period), mean))
    # Read by the ends, the phases and the result.
    mids = materialize(own_rows(seated, half, half, rows))

    first, last = F.lit(half), F.col("_n") - 1 - half
    at_head = (F.col("_i") >= first) & (F.col("_i") < F.least(first + period, last))
    at_tail = (F.col("_i") >= F.greatest(first, last - period)) & (F.col("_i") < last)
    x_tail = F.col("_i") - F.col("_n")

    def line(where, x):
        y, xx = F.when(where, F.col("_mid")), F.when(where, x.cast("double"))
        return F.regr_slope(y, xx), F.regr_intercept(y, xx)

    (hs, hi), (ts, ti) = line(at_head, F.col("_i")), line(at_tail, x_tail)
    ends = mids.groupBy(*by).agg(
        hs.alias("_hs"), hi.alias("_hi"), ts.alias("_ts"), ti.alias("_ti")
    )
    trended = join_small(mids, ends, list(by))
    head = F.col("_hs") * F.col("_i") + F.col("_hi")
    tail = F.col("_ts") * x_tail + F.col("_ti")
    trend = F.coalesce("_mid", F.when(F.col("_i") < first, head).otherwise(tail))
    trended = trended.withColumn("seasonal_trend", trend).withColumn("_phase", F.col("_i") % period)
    phases = trended.groupBy(*by, "_phase").agg(
        F.avg(F.col("close") - F.col("seasonal_trend")).alias("_avg")
    )
    # `period` rows per series.
    centre = F.avg("_avg").over(Window.partitionBy(*by))
    phases = phases.select(*by, "_phase", (F.col("_avg") - centre).alias("seasonal_seasonal"))
    out = join_small(trended, phases, [*by, "_phase"])
    rest = F.col("close") - F.col("seasonal_trend") - F.col("seasonal_seasonal")
    out = out.withColumns(
        {"seasonal_residual": rest, "seasonal_norm": tdiv("seasonal_seasonal", "close")}
    )
    return out.drop("_mid", "_hs", "_hi", "_ts", "_ti", "_phase")


def _odd(n: int) -> int:
    return n + 1 - n % 2


def trend_window(period: int, seasonal: int) -> int:
    return _odd(math.ceil(1.5 * period / (1 - 1.5 / seasonal)))


def _loess_weights(x: float, left: int, right: int, q: int, n: int, span: int) -> np.ndarray:
    """Weights of points left..right in the local line at x (tricube, degree 1)."""
    j = np.arange(left, right + 1, dtype=float)
    h = max(x - left, right - x) + (max(q - n, 0) // 2)
    r = np.abs(j - x)
    if h <= 0:
        return np.ones(1)
    w = np.where(r <= 0.001 * h, 1.0, (1 - np.minimum(r / h, 1.0) ** 3) ** 3)
    w[r > 0.999 * h] = 0.0
    w /= w.sum()
    centre = (w * j).sum()
    spread = (w * (j - centre) ** 2).sum()
    # The slope is dropped where the points spread too little against the whole series.
    if math.sqrt(spread) > 0.001 * span:
        w = w * ((x - centre) / spread * (j - centre) + 1)
    return w


def loess(y: np.ndarray, q: int, span: int, extend: bool = False) -> np.ndarray:
    """Local lines over the ``q`` nearest of evenly spaced points, down axis 0.

    Inside the series every fit has the same weights, so it is one moving weighted
    sum; only the ends differ. ``span`` is the length less one of the whole series this
    piece belongs to. ``extend`` adds one fitted point before the first and after the last.
    """
    n = len(y)
    m = min(q, n)
    half = (q - 1) // 2
    out = np.empty((n + 2, *y.shape[1:]))
    if n > q:
        kernel = _loess_weights(half, 0, q - 1, q, n, span)
        if y.ndim == 1:
            out[1 + half : 1 + n - half] = np.convolve(y, kernel[::-1], "valid")
        else:
            inner = out[1 + half : 1 + n - half]
            inner[:] = 0.0
            for k, wk in enumerate(kernel):
                inner += wk * y[k : k + n - q + 1]
        ends = [*range(-1, half), *range(n - half, n + 1)]
    else:
        ends = range(-1, n + 1)
    for x in ends:
        # The window follows the point but stays inside the series.
        left = min(max(x - half, 0), n - m)
        w = _loess_weights(x, left, left + m - 1, q, n, span)
        out[x + 1] = np.tensordot(w, y[left : left + m], axes=(0, 0))
    return out if extend else out[1:-1]


def _mean_filter(x: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(x, np.full(k, 1.0 / k), "valid")


def stl(
    y: np.ndarray, period: int, seasonal: int, length: int, inner: int = STL_INNER
) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend of ``y``, a piece of a series of ``length`` points."""
    n = len(y)
    nt, nl = trend_window(period, seasonal), _odd(period + 1)
    cycles = max(length // period, 1)
    trend = np.zeros(n)
    season = np.zeros(n)
    for _ in range(inner):
        free = y - trend
        cyc = np.empty(n + 2 * period)
        # Phases with one point more than the others form a matrix of their own.
        more = n % period
        for first, last, k in ((0, more, n // period + 1), (more, period, n // period)):
            if first < last and k:
                rows = np.arange(k)[:, None] * period + np.arange(first, last)[None, :]
                fit = loess(free[rows], seasonal, cycles - 1, extend=True)
                at = np.arange(k + 2)[:, None] * period + np.arange(first, last)[None, :]
                cyc[at] = fit
        low = _mean_filter(_mean_filter(_mean_filter(cyc, period), period), 3)
        season = cyc[period : period + n] - loess(low, nl, length - 1)
        trend = loess(y - season, nt, length - 1)
    return season, trend


def stl_reach(period: int, seasonal: int, inner: int = STL_INNER) -> int:
    """Rows on either side that can touch an STL value."""
    low = period + 2 + _odd(period + 1) // 2
    one = (seasonal // 2 + 1) * period + low + trend_window(period, seasonal) // 2 + 1
    return inner * one


def _whole(b: pd.DataFrame, period: int) -> bool:
    return int(b["_n"].iloc[0]) >= 2 * period


def stl_kernel(period: int = PERIOD, seasonal: int = STL_SEASONAL) -> Kernel:
    def fn(b):
        y = b["close"].to_numpy(float)
        if not _whole(b, period):
            s = t = np.full(len(y), np.nan)
        else:
            s, t = stl(y, period, seasonal, int(b["_n"].iloc[0]))
        return {"stl_trend": t, "stl_seasonal": s, "stl_residual": y - s - t}

    reach = stl_reach(period, seasonal)
    return Kernel(("stl_trend", "stl_seasonal", "stl_residual"), reach, fn, reach)


def mstl_kernel(periods: tuple[int, ...] = (24, PERIOD), iterate: int = 2) -> Kernel:
    """Several seasons, refined in turn; seasonal windows are 11, 15, 19, …"""
    windows = [7 + 4 * (k + 1) for k in range(len(periods))]
    names = ("mstl_trend", *[f"mstl_seasonal_{p}" for p in periods], "mstl_residual")

    def fn(b):
        y = b["close"].to_numpy(float)
        if not _whole(b, max(periods)):
            return {k: np.full(len(y), np.nan) for k in names}
        length = int(b["_n"].iloc[0])
        seasons = [np.zeros(len(y)) for _ in periods]
        rest, trend = y, None
        for _ in range(iterate if len(periods) > 1 else 1):
            for k, p in enumerate(periods):
                rest = rest + seasons[k]
                seasons[k], trend = stl(rest, p, windows[k], length)
                rest = rest - seasons[k]
        return dict(zip(names, [trend, *seasons, rest - trend]))

    reach = iterate * sum(stl_reach(p, w) for p, w in zip(periods, windows))
    return Kernel(names, reach, fn, reach)


def with_stl_strength(df: DataFrame, by=SERIES) -> DataFrame:
    """Strength of season and trend: one minus the residual's share of the variance."""

    def strength(part: str):
        both = F.var_samp(F.col(part) + F.col("stl_residual"))
        return 1 - F.try_divide(F.var_samp("stl_residual"), both)

    stats = df.groupBy(*by).agg(
        strength("stl_seasonal").alias("stl_seasonal_strength"),
        strength("stl_trend").alias("stl_trend_strength"),
    )
    return join_small(df, stats, list(by))
