import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.frames import by_row, walk
from tidebars.operators.blocks import Frames, own_rows, running, with_halo, with_position
from tidebars.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def bars(spark):
    # One symbol holds most rows.
    pdf = pd.concat([walk(900, "hot", 1), walk(37, "b", 2), walk(1, "c", 3)], ignore_index=True)
    pdf = pdf.sample(frac=1, random_state=5, ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


def test_positions_follow_time(bars):
    pdf, df = bars
    got = by_row(with_position(df))
    want = pdf.sort_values(["symbol", "ts"], ignore_index=True)
    assert (got["ts"] == want["ts"]).all()
    assert (got["_i"] == want.groupby("symbol").cumcount()).all()
    assert (got["_n"] == want.groupby("symbol")["ts"].transform("size")).all()


def test_row_without_symbol_is_an_error(spark):
    df = spark.createDataFrame([(None, 1)], "symbol string, ts int")
    with pytest.raises(Exception, match="a row has no symbol"):
        with_position(df)


@pytest.mark.parametrize("rows", [20, 64, 10_000])
def test_halo_windows_equal_whole_windows(bars, rows):
    pdf, df = bars
    fr = Frames(("symbol",), rows)
    seated = with_halo(with_position(df), 19, 5, rows)
    out = seated.withColumns(
        {"mean": fr.roll(F.avg, "close", 20), "ahead": fr.lead("close", 5)}
    )
    got = by_row(own_rows(out, 19, 5, rows))
    want = pdf.sort_values(["symbol", "ts"], ignore_index=True)
    g = want.groupby("symbol")["close"]
    assert len(got) == len(want)
    np.testing.assert_allclose(got["mean"], g.transform(lambda x: x.rolling(20).mean()), rtol=1e-9)
    np.testing.assert_allclose(got["ahead"], g.shift(-5), rtol=1e-12)


@pytest.mark.parametrize("rows", [7, 10_000])
def test_running_values_cross_blocks(spark, rows):
    pdf = walk(200, "x")
    pdf.loc[pdf.index % 11 != 3, "close"] = np.nan
    pdf["n"] = np.arange(200)[::-1]
    df = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    specs = {
        "total": ("sum", "volume"),
        "top": ("max", "n"),
        "last": ("last", "close"),
        "prior": ("prior", "close"),
        "next": ("next", "close"),
    }
    got = by_row(running(with_position(df), specs, rows=rows))
    assert (got["total"] == pdf["volume"].cumsum()).all()
    assert (got["top"] == 199).all()
    np.testing.assert_array_equal(got["last"], pdf["close"].ffill())
    np.testing.assert_array_equal(got["prior"], pdf["close"].ffill().shift(1))
    np.testing.assert_array_equal(got["next"], pdf["close"].bfill())


def test_quantiles_are_exact(bars):
    pdf, df = bars
    got = quantiles(df, ["close", "volume"], {"q1": 0.25, "q9": 0.9}).toPandas().set_index("symbol")
    for s, g in pdf.groupby("symbol"):
        assert got.loc[s, "close_q1"] == pytest.approx(g["close"].quantile(0.25), rel=1e-12)
        assert got.loc[s, "volume_q9"] == pytest.approx(g["volume"].quantile(0.9), rel=1e-12)


def test_quantiles_with_one_common_value(spark):
    pdf = pd.DataFrame({"symbol": "s", "x": [1.0] * 500 + [2.0, 3.0, 9.0]})
    got = quantiles(spark.createDataFrame(pdf), ["x"], {"m": 0.5, "t": 0.999}).first()
    assert got["x_m"] == 1.0
    assert got["x_t"] == pytest.approx(pdf["x"].quantile(0.999))
