"""Smoothed indicators that depend on all earlier rows: EMA, ATR, RSI, MACD, ADX.

Spark has no scan operator, so these run as one grouped map over bounded blocks. Each
is a linear recurrence ``s = a*s + b*x`` whose memory fades as ``a**n``; a block starts
``memory_rows`` early, where whatever came before has faded below one rounding step.
Indicators that divide two fading values (RSI, ADX) start where ``a**n`` has left the
double range altogether, so that long flat stretches give the same ratio too.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebars.operators.blocks import SERIES, block_rows, own_rows, with_halo

EMA_SPANS = [5, 10, 20, 50, 200]
# Blocks of grouped maps are larger than those of windows: their halos are longer.
KERNEL_ROWS = 131_072


def memory_rows(a: float, ratio: bool = False) -> int:
    """Rows after which ``a**n`` is below 2**-60, or below the smallest double."""
    if a <= 0:
        return 1
    return math.ceil((790 if ratio else 42) / -math.log(a))


@dataclass(frozen=True)
class Kernel:
    """A block function: pandas block in, new columns out, in row order."""

    outputs: tuple[str, ...]
    back: int
    fn: Callable[[pd.DataFrame], dict[str, np.ndarray]]
    ahead: int = 0


def _ewm(x: pd.Series, span: float, min_periods: int = 0) -> np.ndarray:
    return x.ewm(span=span, adjust=False, min_periods=min_periods).mean().to_numpy()


def true_range(b: pd.DataFrame) -> np.ndarray:
    prev = b["close"].shift(1)
    parts = [b["high"] - b["low"], (b["high"] - prev).abs(), (b["low"] - prev).abs()]
    return pd.concat(parts, axis=1).max(axis=1).to_numpy()


def _at_start(b: pd.DataFrame) -> bool:
    return int(b["_i"].iloc[0]) == 0


def _wilder(x: np.ndarray, n: int, start: bool, seed) -> np.ndarray:
    """Wilder mean of x: seeded with ``seed(first n)`` at row n-1 of a series."""
    out = np.full(len(x), np.nan)
    at = n - 1 if start else 0
    if len(x) > at:
        y = pd.Series(x[at:].astype(float))
        if start:
            y.iloc[0] = seed(x[:n])
        out[at:] = y.ewm(alpha=1 / n, adjust=False).mean().to_numpy()
    return out


def ema_kernel(span: int) -> Kernel:
    def fn(b):
        # min_periods counts within the block; a halo always holds more than `span` rows.
        return {f"ema_{span}": _ewm(b["close"], span, span)}

    return Kernel((f"ema_{span}",), max(memory_rows(1 - 2 / (span + 1)), span), fn)


def atr_kernel(n: int = 14) -> Kernel:
    def fn(b):
        return {"atr": _ewm(pd.Series(true_range(b)), n)}

    return Kernel(("atr",), memory_rows(1 - 2 / (n + 1)) + 1, fn)


def macd_kernel(fast: int = 12, slow: int = 26, signal: int = 9) -> Kernel:
    def fn(b):
        line = pd.Series(_ewm(b["close"], fast) - _ewm(b["close"], slow))
        sig = _ewm(line, signal)
        return {
            "macd_line": line.to_numpy(),
            "macd_signal": sig,
            "macd_histogram": line.to_numpy() - sig,
        }

    back = memory_rows(1 - 2 / (slow + 1)) + memory_rows(1 - 2 / (signal + 1))
    return Kernel(("macd_line", "macd_signal", "macd_histogram"), back, fn)


def rsi_kernel(n: int = 14) -> Kernel:
    name = f"rsi_{n}"

    def fn(b):
        delta = b["close"].diff().to_numpy()
        gain = np.where(delta > 0, delta, 0.0)
        loss = np.where(delta < 0, -delta, 0.0)
        start = _at_start(b)
        if start and len(b) < n:
            return {name: np.full(len(b), np.nan)}
        g, l = _wilder(gain, n, start, np.mean), _wilder(loss, n, start, np.mean)
        with np.errstate(all="ignore"):
            return {name: 100 - 100 / (1 + g / l)}

    return Kernel((name,), memory_rows(1 - 1 / n, ratio=True) + 1, fn)


def adx_kernel(n: int = 14) -> Kernel:
    def fn(b):
        up, down = b["high"].diff().to_numpy(), -b["low"].diff().to_numpy()
        plus = np.where((up > down) & (up > 0), up, 0.0)
        minus = np.where((down > up) & (down > 0), down, 0.0)
        start = _at_start(b)
        if start and len(b) < n:
            none = np.full(len(b), np.nan)
            return {"+di": none, "-di": none, "adx": none}
        tr, p, m = (_wilder(x, n, start, np.mean) for x in (true_range(b), plus, minus))
        with np.errstate(all="ignore"):
            pdi, mdi = 100 * (p / tr), 100 * (m / tr)
            dx = 100 * np.abs(pdi - mdi) / (pdi + mdi)
        adx = np.full(len(b), np.nan)
        if len(b) >= n:
            adx[n - 1 :] = np.lib.stride_tricks.sliding_window_view(dx, n).mean(axis=1)
        return {"+di": pdi, "-di": mdi, "adx": adx}

    return Kernel(("+di", "-di", "adx"), memory_rows(1 - 1 / n, ratio=True) + n + 1, fn)


def apply_kernels(
    df: DataFrame, kernels: list[Kernel], by=SERIES, rows: int | None = None, strict: bool = True
) -> DataFrame:
    """Run all kernels in one pass over the blocks of a positioned table.

    Without ``strict`` a kernel that fails on a block leaves NULLs there and says so in the worker's log.
    """
    outputs = [o for k in kernels for o in k.outputs]
    back, ahead = max(k.back for k in kernels), max(k.ahead for k in kernels)
    size = block_rows(back, ahead, rows or KERNEL_ROWS)
    schema = T.StructType(
        [f for f in df.schema if f.name not in outputs]
        + [T.StructField(o, T.DoubleType()) for o in outputs]
    )
    names = schema.names

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        home = int(pdf["_blk"].iloc[0])
        pdf = pdf.sort_values("_i", ignore_index=True)
        new = {}
        for k in kernels:
            # Each kernel sees no more halo than it asked for; extra rows change nothing.
            try:
                new.update(k.fn(pdf))
            except Exception:
                if strict:
                    raise
                logging.getLogger(__name__).exception("kernel for %s failed on a block", k.outputs)
                new.update({o: np.full(len(pdf), np.nan) for o in k.outputs})
        for name, values in new.items():
            values = np.asarray(values, dtype=float)
            pdf[name] = np.where(np.isfinite(values), values, np.nan)
        return pdf.loc[pdf["_i"] // size == home, names]

    seated = with_halo(df, back, ahead, size)
    # Arrow hands NaN over as NULL, so indicators are NULL where undefined.
    return seated.groupBy(*by, "_blk").applyInPandas(block, schema)
