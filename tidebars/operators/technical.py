"""Oscillators and clouds built from bounded windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.functions.columns import tdiv, typical_price
from tidebars.operators.blocks import Frames


def stochastic_oscillator(fr: Frames, have: set[str], k: int = 14, d: int = 3, slow: int = 3):
    """Undefined fast values count as 50 before smoothing, the first rows too."""
    low, high = fr.roll(F.min, "low", k), fr.roll(F.max, "high", k)
    yield {"_fast": F.coalesce(tdiv(100 * (F.col("close") - low), high - low), F.lit(50.0))}
    yield {"stoch_k": fr.roll(F.avg, "_fast", slow) if slow > 1 else F.col("_fast")}
    yield {"stoch_d": fr.roll(F.avg, "stoch_k", d)}


def commodity_channel_index(fr: Frames, have: set[str], n: int = 20):
    yield {"_off": typical_price() - fr.roll(F.avg, typical_price(), n)}
    yield {"_dev": F.abs("_off")}
    yield {"cci": tdiv("_off", 0.015 * fr.roll(F.avg, "_dev", n))}


def ichimoku_cloud(
    fr: Frames,
    have: set[str],
    tenkan: int = 9,
    kijun: int = 26,
    senkou: int = 52,
    shift: int = 26,
):
    """``ichimoku_chikou`` looks ahead by ``shift`` rows."""

    def middle(n):
        return (fr.roll(F.max, "high", n) + fr.roll(F.min, "low", n)) / 2

    yield {
        "ichimoku_tenkan": middle(tenkan),
        "ichimoku_kijun": middle(kijun),
        "_slow": middle(senkou),
        "ichimoku_chikou": fr.lead("close", shift),
    }
    yield {
        "ichimoku_senkou_a": fr.lag((F.col("ichimoku_tenkan") + F.col("ichimoku_kijun")) / 2, shift),
        "ichimoku_senkou_b": fr.lag("_slow", shift),
    }
