"""Block functions: a block with its halo gives what the whole series gives."""

import numpy as np
import pandas as pd
import pytest

from tests.frames import by_row, walk
from tidebars.operators import recurrences as rec
from tidebars.operators.blocks import with_position
from tidebars.operators.decompose import mstl_kernel, stl, stl_kernel, stl_reach
from tidebars.operators.regime import rank_kernel
from tidebars.operators.volume import profile_kernel


def whole(kernel, pdf):
    pdf = pdf.assign(_i=np.arange(len(pdf)), _n=len(pdf))
    return kernel.fn(pdf)


def test_ema_and_rsi_against_plain_loops():
    pdf = walk(120)
    close = pdf["close"].to_numpy()
    got = whole(rec.ema_kernel(10), pdf)["ema_10"]
    s = close[0]
    for k in range(1, 120):
        s += 2 / 11 * (close[k] - s)
        if k >= 9:
            assert got[k] == pytest.approx(s, rel=1e-12)
    assert np.isnan(got[:9]).all()

    rsi = whole(rec.rsi_kernel(14), pdf)["rsi_14"]
    d = np.diff(close, prepend=close[0])
    g, l = np.maximum(d, 0)[:14].mean(), np.maximum(-d, 0)[:14].mean()
    assert rsi[13] == pytest.approx(100 - 100 / (1 + g / l))
    for k in range(14, 120):
        g, l = (g * 13 + max(d[k], 0)) / 14, (l * 13 + max(-d[k], 0)) / 14
        assert rsi[k] == pytest.approx(100 - 100 / (1 + g / l))


def test_adx_against_plain_loops():
    pdf = walk(100)
    got = whole(rec.adx_kernel(), pdf)
    h, l, c = (pdf[k].to_numpy() for k in ("high", "low", "close"))
    up, dn = np.diff(h, prepend=np.nan), -np.diff(l, prepend=np.nan)
    p = np.where((up > dn) & (up > 0), up, 0)
    m = np.where((dn > up) & (dn > 0), dn, 0)
    pc = np.roll(c, 1)
    tr = np.maximum(h - l, np.maximum(abs(h - pc), abs(l - pc)))
    tr[0] = h[0] - l[0]
    t, a, b = tr[:14].sum(), p[:14].sum(), m[:14].sum()
    dx = []
    for k in range(13, 100):
        if k > 13:
            t, a, b = t - t / 14 + tr[k], a - a / 14 + p[k], b - b / 14 + m[k]
        assert got["+di"][k] == pytest.approx(100 * a / t)
        dx.append(100 * abs(a - b) / (a + b))
    assert got["adx"][26] == pytest.approx(np.mean(dx[:14]))
    assert got["adx"][99] == pytest.approx(np.mean(dx[-14:]))


def test_rsi_of_a_rise_is_100_and_of_a_flat_line_is_null():
    pdf = walk(40)
    pdf["close"] = np.arange(40.0) + 1
    assert (whole(rec.rsi_kernel(), pdf)["rsi_14"][13:] == 100).all()
    pdf["close"] = 5.0
    assert np.isnan(whole(rec.rsi_kernel(), pdf)["rsi_14"]).all()


@pytest.mark.parametrize(
    "kernel",
    [rec.ema_kernel(20), rec.atr_kernel(), rec.macd_kernel(), rec.rsi_kernel(), rec.adx_kernel(), profile_kernel(), rank_kernel()],
    ids=lambda k: k.outputs[0],
)
def test_blocks_equal_whole_series(spark, kernel):
    """A block size well below the series, and a flat stretch longer than a block."""
    n = max(3 * kernel.back, 2000)
    pdf = walk(n, "s", 7, "1min")
    a, b = n // 4, n // 4 + min(kernel.back, n // 3)
    for k in ("open", "high", "low", "close"):
        pdf.loc[a:b, k] = pdf["close"].iloc[a]
    df = with_position(spark.createDataFrame(pdf[["symbol", "ts", "open", "high", "low", "close", "volume"]]))
    got = by_row(rec.apply_kernels(df, [kernel], rows=max(kernel.back, 300)))
    want = whole(kernel, pdf)
    for name in kernel.outputs:
        w = np.where(np.isfinite(want[name]), want[name], np.nan)
        np.testing.assert_allclose(got[name].to_numpy(float), w, rtol=1e-8, atol=1e-9, err_msg=name)


def test_profile_against_plain_loops():
    pdf = walk(60)
    got = whole(profile_kernel(), pdf)
    tp = ((pdf["high"] + pdf["low"] + pdf["close"]) / 3).to_numpy()
    for r in (20, 41, 59):
        lo, hi = pdf["low"].iloc[r - 19 : r + 1].min(), pdf["high"].iloc[r - 19 : r + 1].max()
        bins = np.zeros(10)
        for pos, j in enumerate(range(r - 20, r)):
            k = int(np.clip(np.floor((tp[j] - lo) / ((hi - lo) / 10)), 0, 9))
            bins[k] += pdf["volume"].iloc[j] * (1 + 0.1 * pos / 20)
        bins *= 100 / bins.sum()
        np.testing.assert_allclose([got[f"vol_bin_{k}"][r] for k in range(10)], bins)
        assert got["vol_poc"][r] == pytest.approx(lo + (bins.argmax() + 0.5) * (hi - lo) / 10)
    assert np.isnan(got["vol_poc"][:20]).all() and (got["vol_concentration"][:20] == 1).all()


def test_stl_of_season_and_line():
    t = np.arange(2000)
    season = 3 * np.sin(2 * np.pi * t / 50)
    s, trend = stl(10 + 0.01 * t + season, 50, 13, 2000)
    assert np.abs(s - season).max() < 1e-2
    assert np.abs(trend - 10 - 0.01 * t)[100:-100].max() < 1e-2


def test_stl_piece_equals_whole():
    y = walk(30_000, freq="1min")["close"].to_numpy()
    s, trend = stl(y, 160, 13, len(y))
    r = stl_reach(160, 13)
    for a, b in ((12_000, 14_000), (28_000, 30_000)):
        ps, pt = stl(y[a - r : min(b + r, len(y))], 160, 13, len(y))
        np.testing.assert_allclose(ps[r : r + b - a], s[a:b], atol=1e-8)
        np.testing.assert_allclose(pt[r : r + b - a], trend[a:b], atol=1e-8)


def test_decomposed_blocks_equal_whole_and_sum_up(spark):
    kernel = stl_kernel(24, 7)
    pdf = walk(6 * kernel.back, freq="1h")
    df = with_position(spark.createDataFrame(pdf))
    got = by_row(rec.apply_kernels(df, [kernel], rows=kernel.back))
    want = whole(kernel, pdf)
    np.testing.assert_allclose(got["stl_trend"], want["stl_trend"], atol=1e-8)
    np.testing.assert_allclose(
        got["stl_trend"] + got["stl_seasonal"] + got["stl_residual"], pdf["close"], rtol=1e-12
    )


def test_mstl_parts_sum_to_the_close_and_short_series_are_null():
    pdf = walk(700)
    out = whole(mstl_kernel(), pdf)
    np.testing.assert_allclose(sum(out.values()), pdf["close"], rtol=1e-12)
    assert all(np.isnan(v).all() for v in whole(mstl_kernel(), walk(300)).values())
