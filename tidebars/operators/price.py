"""Price action: moving averages, momentum, bands, distance from extremes.

A window feature is a generator of layers. Each layer is a dict of new columns that may
use the columns of earlier layers; the layers of all features are planned side by side,
so that Spark computes each in a single Window node. Names with a leading underscore
are dropped at the end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.functions.columns import c, pct, tdiv
from tidebars.operators.blocks import Frames

SMA_PERIODS = [5, 10, 20, 50, 200]
ROC_PERIODS = [1, 5, 10, 20, 60]


def sma(fr: Frames, periods) -> dict:
    return {f"sma_{n}": fr.roll(F.avg, "close", n) for n in periods}


def moving_averages(fr: Frames, have: set[str], periods=tuple(SMA_PERIODS)):
    yield sma(fr, periods)


def rate_of_change(fr: Frames, have: set[str], periods=tuple(ROC_PERIODS)):
    yield {f"roc_{n}": pct("close", fr.lag("close", n)) for n in periods}


def bollinger_bands(fr: Frames, have: set[str], n: int = 20, width: float = 2.0):
    yield {"std": fr.roll(F.stddev_samp, "close", n), **sma(fr, [n])}
    mean, spread = c(f"sma_{n}"), width * F.col("std")
    yield {
        "upper_band": mean + spread,
        "lower_band": mean - spread,
        "bb_width": tdiv((mean + spread) - (mean - spread), mean),
    }


def support_resistance(fr: Frames, have: set[str], n: int = 20):
    yield {
        "distance_from_high": pct("close", fr.roll(F.max, "high", n)),
        "distance_from_low": pct("close", fr.roll(F.min, "low", n)),
    }


def log_returns(fr: Frames, have: set[str]):
    ratio = tdiv("close", fr.lag("close"))
    yield {"log_return": F.when(ratio > 0, F.ln(ratio))}
