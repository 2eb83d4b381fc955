"""Volume: averages, momentum, balance, profile, VWAP, money flow."""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.columns import pct, tdiv, typical_price
from tidebars.operators.blocks import SERIES, Frames
from tidebars.operators.recurrences import Kernel

VMA_PERIODS = [7, 15, 30, 60]
VROC_PERIODS = [1, 5, 10, 20]


def volume_moving_averages(fr: Frames, have: set[str], periods=tuple(VMA_PERIODS)):
    yield {f"vma_{n}": fr.roll(F.avg, "volume", n) for n in periods}
    yield {f"relative_volume_{n}": tdiv("volume", f"vma_{n}") for n in periods}


def volume_rate_of_change(fr: Frames, have: set[str], periods=tuple(VROC_PERIODS)):
    yield {f"vroc_{n}": pct("volume", fr.lag("volume", n)) for n in periods}


def on_balance_volume(fr: Frames, have: set[str]):
    """Signed volume of each row; the running sum follows once blocks are joined up."""
    yield {"obv": F.col("volume") * F.signum(F.col("close") - fr.lag("close"))}


def profile_kernel(bins: int = 10, n: int = 20, key_metrics: bool = True) -> Kernel:
    """Share of volume by price bin over the previous ``n`` rows, later rows weighing more.

    The bins span the low to the high of the n rows that end with the current one. A row
    outside them counts in the nearest bin. ``key_metrics`` adds point of control, value
    area (70 % of volume) and concentration. Bins depend on the row that looks at them,
    so no window aggregate can say this; whole blocks of windows are binned at once.
    """
    names = [f"vol_bin_{k}" for k in range(bins)]
    if key_metrics:
        names += ["vol_poc", "vol_va_high", "vol_va_low", "vol_va_width", "vol_concentration"]
    weight = 1 + 0.1 * (np.arange(n) / n)

    def piece(b: dict[str, np.ndarray], first: int, last: int) -> np.ndarray:
        """Values of rows first..last-1; row r looks at rows r-n..r-1."""
        m = last - first
        tp = sliding_window_view(b["tp"][first - n : last - 1], n)
        vol = sliding_window_view(b["volume"][first - n : last - 1], n)
        low = sliding_window_view(b["low"][first - n + 1 : last], n).min(axis=1)
        span = sliding_window_view(b["high"][first - n + 1 : last], n).max(axis=1) - low
        with np.errstate(divide="ignore", invalid="ignore"):
            step = span / bins
            at = np.nan_to_num(np.floor((tp - low[:, None]) / step[:, None]), posinf=bins, neginf=0)
            at = np.clip(at, 0, bins - 1).astype(np.int64) + np.arange(m)[:, None] * bins
            share = np.bincount(at.ravel(), (vol * weight).ravel(), m * bins).reshape(m, bins)
            total = share.sum(axis=1)
            share = np.where(total[:, None] > 0, share / total[:, None] * 100, share)
        live = (span > 0) & np.isfinite(total)
        if not key_metrics:
            return np.where(live[:, None], share, np.nan)
        # Largest share first, the higher bin first among equals.
        order = np.argsort(share, axis=1, kind="stable")[:, ::-1]
        cum = np.cumsum(np.take_along_axis(share, order, 1) / 100, axis=1)
        inside = np.hstack([np.ones((m, 1), bool), cum[:, :-1] < 0.7])
        top = np.where(inside, order, -1).max(axis=1) + 1
        bottom = np.where(inside, order, bins).min(axis=1)
        p = share / 100
        entropy = -np.sum(np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0), axis=1)
        high_at, low_at = low + top * step, low + bottom * step
        with np.errstate(divide="ignore", invalid="ignore"):
            cols = [low + (share.argmax(axis=1) + 0.5) * step, high_at, low_at, (high_at - low_at) / span]
        out = np.where(live[:, None], np.column_stack([share, *cols]), np.nan)
        return np.column_stack([out, np.where(live, 1 - entropy / math.log(bins), 1.0)])

    def fn(pdf):
        b = {k: pdf[k].to_numpy(float) for k in ("high", "low", "close", "volume")}
        b["tp"] = (b["high"] + b["low"] + b["close"]) / 3
        out = np.full((len(pdf), len(names)), np.nan)
        if key_metrics:
            out[:, -1] = 1.0
        for first in range(n, len(pdf), 8192):
            last = min(first + 8192, len(pdf))
            out[first:last] = piece(b, first, last)
        return {k: out[:, j] for j, k in enumerate(names)}

    return Kernel(tuple(names), n, fn)


def profile_flags(df: DataFrame, by=SERIES) -> DataFrame:
    """Distance to the point of control, and whether the close is in the value area."""
    inside = (F.col("close") >= F.col("vol_va_low")) & (F.col("close") <= F.col("vol_va_high"))
    return df.withColumns(
        {
            "close_to_poc_pct": tdiv(F.col("close") - F.col("vol_poc"), "vol_poc") * 100,
            "in_value_area": F.when(inside, 1).otherwise(0),
        }
    )


def vwap(fr: Frames, have: set[str], n: int = 1):
    yield {"_flow": F.col("volume") * typical_price()}
    yield {"vwap": tdiv(fr.roll(F.sum, "_flow", n), fr.roll(F.sum, "volume", n))}


def session_vwap(df: DataFrame, by=SERIES, rows: int | None = None) -> DataFrame:
    """``vwap_session``: volume-weighted price since the first bar of the day. A positioned table.

    A day of a series is one window: at most 86,400 bars of a second.
    """
    day = Window.partitionBy(*by, F.to_date("ts")).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    flow = F.sum(F.col("volume") * typical_price()).over(day)
    return df.withColumn("vwap_session", tdiv(flow, F.sum("volume").over(day)))


def money_flow_index(fr: Frames, have: set[str], n: int = 14):
    """0 when no row of the window has a negative flow, as there is then no ratio."""
    tp, prev = typical_price(), fr.lag(typical_price())
    yield {"_up": F.signum(tp - prev), "_flow": F.col("volume") * tp}
    yield {
        "_pos": F.when(F.col("_up") > 0, F.col("_flow")).otherwise(0.0),
        "_neg": F.when(F.col("_up") < 0, F.col("_flow")).otherwise(0.0),
    }
    ups, downs = fr.roll(F.sum, "_pos", n), fr.roll(F.sum, "_neg", n)
    ratio = F.when(ups.isNotNull(), F.coalesce(tdiv(ups, downs), F.lit(0.0)))
    yield {"mfi": 100 - tdiv(F.lit(100.0), 1 + ratio)}
