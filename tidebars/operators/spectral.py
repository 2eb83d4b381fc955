"""Dominant cycles of log returns.

Every series is transformed across the cluster, whatever its length: a chirp turns the DFT of any length into a circular
convolution of length M = L1*L2 (Bluestein 1970), whose transforms are split into L2
and L1 groups of about sqrt(M) values (Bailey 1990).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.columns import join_small
from tidebars.operators.blocks import SERIES, with_position

DIGITS = 9


def _top(by, keys, k: np.ndarray, power: np.ndarray, n: int, top: int) -> pd.DataFrame:
    # Here the largest power of the series is not known, so powers are rounded to their own digits.
    with np.errstate(divide="ignore"):
        scale = 10.0 ** (DIGITS - np.ceil(np.log10(np.maximum(power, 1e-300))))
    best = np.lexsort((k, -np.round(power * scale) / scale))[:top]
    out = pd.DataFrame({"_k": k[best].astype("int64"), "power": power[best], "_m": n})
    for name, value in zip(by, keys):
        out.insert(0, name, value)
    return out[[*by, "_k", "power", "_m"]]


def _chirp(n: np.ndarray, size: int) -> np.ndarray:
    return np.exp(-1j * np.pi * ((n * n) % (2 * size)) / size)


def _plan(size: int) -> tuple[int, int, int]:
    bits = max(int(2 * size - 2).bit_length(), 2)
    l1 = 1 << ((bits + 1) // 2)
    m = 1 << bits
    return m, l1, m // l1


def _long_peaks(x: DataFrame, by: list[str], col: str, top: int) -> DataFrame:
    keys = ", ".join(f"`{b}` {x.schema[b].dataType.simpleString()}" for b in by)
    part = f"{keys}, _n bigint, _r bigint, _c bigint, re double, im double"
    wide = f"{keys}, _n bigint, _r bigint, _c bigint, re double, im double, bre double, bim double"

    def rows(key, n, r, c, v, b=None):
        out = pd.DataFrame({"_n": n, "_r": r, "_c": c, "re": v.real, "im": v.imag})
        if b is not None:
            out["bre"], out["bim"] = b.real, b.imag
        for name, value in zip(reversed(by), reversed(key[: len(by)])):
            out.insert(0, name, value)
        return out

    # Column groups: every L2-th return, transformed over n1, twisted, sent to row k1.
    bits = F.length(F.bin(2 * F.col("_n") - 2))
    l2 = F.pow(F.lit(2.0), bits - F.floor((bits + 1) / 2)).cast("long")
    x = x.select(*by, "_n", "_i", col, (F.col("_i") % l2).alias("_g"))

    def columns(key, pdf):
        size, n2 = int(pdf["_n"].iloc[0]), int(key[-1])
        m, l1, l2 = _plan(size)
        i = pdf["_i"].to_numpy()
        a = np.zeros(l1, complex)
        a[i // l2] = pdf[col].to_numpy() * _chirp(i, size)
        at = np.arange(l1, dtype=np.int64) * l2 + n2
        near = np.minimum(at, m - at)
        b = np.where(near < size, np.conj(_chirp(near, size)), 0)
        k1 = np.arange(l1, dtype=np.int64)
        twist = np.exp(-2j * np.pi * ((n2 * k1) % m) / m)
        return rows(key, size, k1, n2, np.fft.fft(a) * twist, np.fft.fft(b) * twist)

    def across(key, pdf):
        size, k1 = int(pdf["_n"].iloc[0]), int(key[-1])
        m, l1, l2 = _plan(size)
        pdf = pdf.sort_values("_c")
        a = np.fft.fft(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        b = np.fft.fft(pdf["bre"].to_numpy() + 1j * pdf["bim"].to_numpy())
        n2 = np.arange(l2, dtype=np.int64)
        back = np.exp(2j * np.pi * ((n2 * k1) % m) / m)
        return rows(key, size, n2, k1, np.fft.ifft(a * b) * back)

    def peaks(key, pdf):
        size, n2 = int(pdf["_n"].iloc[0]), int(key[-1])
        m, l1, l2 = _plan(size)
        pdf = pdf.sort_values("_c")
        v = np.fft.ifft(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        k = np.arange(l1, dtype=np.int64) * l2 + n2
        keep = (k >= 1) & (k <= (size - 1) // 2)
        return _top(by, key[: len(by)], k[keep], np.abs(v[keep]) ** 2, size, top)

    first = x.groupBy(*by, "_g").applyInPandas(columns, wide)
    second = first.groupBy(*by, "_r").applyInPandas(across, part)
    return second.groupBy(*by, "_r").applyInPandas(
        peaks, f"{keys}, _k bigint, power double, _m bigint"
    )


def spectrum_peaks(df: DataFrame, col: str = "log_return", top: int = 5, by=SERIES) -> DataFrame:
    """The ``top`` strongest positive frequencies: ``_k`` cycles over ``_m`` values.

    Powers that agree in nine digits of the largest are equal (what differs beyond is rounding noise);
    of these the slower frequency comes first.
    """
    by = list(by)
    x = df.where(F.col(col).isNotNull()).select(*by, F.col("_i").alias("_at"), col)
    x = with_position(x, by, ["_at"]).drop("_at")
    found = _long_peaks(x, by, col, top)
    # `top` rows per group of about sqrt(M) values.
    series = Window.partitionBy(*by)
    digits = F.round(F.try_divide(F.col("power"), F.max("power").over(series)), DIGITS)
    ranked = found.withColumn("_digits", digits)
    best = series.orderBy(F.col("_digits").desc_nulls_last(), "_k")
    return ranked.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top).drop("_rank", "_digits")


def dominant_cycles(
    df: DataFrame,
    col: str = "log_return",
    top: int = 5,
    by=SERIES,
    values: DataFrame | None = None,
) -> DataFrame:
    """Add ``fft_dominant_periods`` (all, sorted) and ``fft_cycles`` with the phase of each
    usable period: at least 2 rows and at most a third of the series.

    ``values`` may hold the same series in a table that is cheaper to read than ``df``.
    """
    peaks = spectrum_peaks(df if values is None else values, col, top, by)
    period = F.rint(1 / (F.col("_k") / F.col("_m"))).cast("int")
    usable = (period >= 2) & (period <= F.floor(F.col("_m") / 3))
    stats = peaks.groupBy(*by).agg(
        F.sort_array(F.collect_list(period)).alias("fft_dominant_periods"),
        F.sort_array(F.collect_set(F.when(usable, period))).alias("_usable"),
    )
    out = join_small(df, stats, list(by), "left")

    def cycle(p):
        turn = 2 * math.pi * F.col("_i") / p
        return F.struct(p.alias("period"), F.sin(turn).alias("sin"), F.cos(turn).alias("cos"))

    return out.withColumn("fft_cycles", F.transform("_usable", cycle)).drop("_usable")
