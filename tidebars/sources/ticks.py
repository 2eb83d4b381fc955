"""Bars from ticks, and coarser bars from finer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.columns import c

# Minutes per bar of each named resolution (fixed values).
RESOLUTION_MINUTES = {
    "MINUTE": 1,
    "MINUTE_5": 5,
    "MINUTE_15": 15,
    "MINUTE_30": 30,
    "HOUR": 60,
    "HOUR_4": 240,
    "DAY": 1440,
    "WEEK": 10080,
}


def duration(resolution: str) -> str:
    return f"{RESOLUTION_MINUTES[resolution]} minutes"


def bars_from_ticks(
    ticks: DataFrame,
    resolution: str = "MINUTE",
    symbol: str = "symbol",
    ts: str = "ts",
    price: str = "price",
    size: str | None = None,
    seq: str | None = None,
) -> DataFrame:
    """One bar per symbol and interval; ``seq`` orders ticks of the same instant.

    A plain aggregate: ticks are reduced before the shuffle, so a hot symbol or a hot
    interval costs one partial row per task.
    """
    at = F.struct(c(ts), c(seq)) if seq else c(ts)
    return (
        ticks.groupBy(
            c(symbol).alias("symbol"), F.window(c(ts), duration(resolution)).alias("_w")
        )
        .agg(
            F.min_by(c(price), at).alias("open"),
            F.max(c(price)).alias("high"),
            F.min(c(price)).alias("low"),
            F.max_by(c(price), at).alias("close"),
            F.sum(c(size) if size else F.lit(1)).cast("long").alias("volume"),
        )
        .select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def coarser_bars(bars: DataFrame, resolution: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of a longer interval."""
    return (
        bars.groupBy(*by, F.window("ts", duration(resolution)).alias("_w"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(*by, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
