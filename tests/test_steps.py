"""Cleaning, validation, transformation, selection, cycles, sources, streams."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.frames import by_row, walk
from tidebars.functions.columns import OHLCV
from tidebars.operators import clean as cl
from tidebars.operators import select as sel
from tidebars.operators import transform as tr
from tidebars.operators import validate as va
from tidebars.operators.blocks import with_position
from tidebars.operators.spectral import dominant_cycles, spectrum_peaks
from tidebars.plans.registry import generate
from tidebars.sources import files as fs
from tidebars.sources import vendor_json as vj
from tidebars.streaming import indicators as ind

NOW = datetime(2030, 1, 1)


@pytest.fixture(scope="module")
def messy(spark):
    pdf = walk(300)
    for k in OHLCV:
        pdf[k] = pdf[k].astype(object)
    pdf.loc[pdf.index % 10 == 3, OHLCV] = None
    pdf.loc[7, "ts"] = pdf.loc[6, "ts"]
    pdf.loc[50, ["high", "low"]] = pdf.loc[50, ["low", "high"]].to_numpy()
    pdf.loc[60, "volume"] = -5
    pdf.loc[70, "close"] = pdf.loc[70, "close"] * 10
    pdf = pdf.drop(index=range(100, 110))
    for k in OHLCV:
        pdf[k] = pdf[k].map(lambda v: "NaN" if v is None else repr(float(v)))
    return spark.createDataFrame(pdf.assign(seq=range(len(pdf))).astype({"ts": str}))


@pytest.mark.parametrize("rows", [None, 16])
def test_cleaned_bars_are_valid(messy, rows):
    out = cl.clean(messy, rows=rows)
    got = out.toPandas().sort_values("ts", ignore_index=True)
    assert len(got) == 300 and not got.isna().any().any()
    assert (got["ts"].diff().dropna() == pd.Timedelta("1h")).all()
    assert (got["volume"].iloc[100:110] == 0).all()
    assert got["volume"].min() >= 0
    assert (got["high"] >= got[["open", "close", "low"]].max(axis=1)).all()
    codes = {r["code"] for r in va.issues(out, NOW).select("code").collect()}
    assert not codes & {"high_below", "low_above", "duplicate", "gap", "negative_volume", "close_price"}


def test_interpolation_matches_pandas(spark):
    pdf = walk(60)
    pdf.loc[[0, 1, 10, 11, 12, 40, 58, 59], "close"] = np.nan
    df = cl.null_tokens(spark.createDataFrame(pdf))
    got = by_row(cl.interpolate(with_position(df), ["close"], rows=8))
    np.testing.assert_allclose(got["close"], pdf["close"].interpolate())


def test_columns_may_be_missing(spark):
    df = spark.createDataFrame(walk(40)[["symbol", "ts", "close"]])
    assert cl.clean(df).columns == ["symbol", "ts", "close"]
    report = va.issues(cl.clean(df), NOW).collect()
    assert [r["description"] for r in report] == ["Missing columns: open, high, low"]


def test_few_rows_and_verdict(spark):
    df = with_position(spark.createDataFrame(pd.concat([walk(10, "few"), walk(50, "many")])))
    got = {r["symbol"]: r["is_valid"] for r in va.verdict(df, va.issues(df, NOW)).collect()}
    assert got == {"few": False, "many": True}


def test_features_need_all_columns(spark):
    with pytest.raises(ValueError, match="volume"):
        generate(spark.createDataFrame(walk(30).drop(columns="volume")))


def test_features_match_pandas_in_small_blocks(spark):
    pdf = walk(500)
    names = ["moving_averages", "rate_of_change", "bollinger_bands", "on_balance_volume", "log_returns"]
    got = by_row(generate(spark.createDataFrame(pdf), names, rows=210, keep_position=True))
    c = pdf["close"]
    np.testing.assert_allclose(got["sma_200"], c.rolling(200).mean(), rtol=1e-9)
    np.testing.assert_allclose(got["roc_60"], (c / c.shift(60) - 1) * 100, rtol=1e-9)
    np.testing.assert_allclose(got["std"], c.rolling(20).std(), rtol=1e-6)
    np.testing.assert_allclose(got["obv"], (pdf["volume"] * np.sign(c.diff())).cumsum())
    assert (got["upper_band"].dropna() >= got["lower_band"].dropna()).all()


def test_broken_feature_is_left_out_unless_strict(spark):
    from tidebars.plans.registry import REGISTRY, register_feature

    def bad(fr, have):
        yield {"nothing": F.col("no_such_column")}

    register_feature("bad", bad)
    df = spark.createDataFrame(walk(30))
    try:
        out = generate(df, ["bad", "log_returns"], strict=False)
        assert "log_return" in out.columns and "nothing" not in out.columns
    finally:
        REGISTRY.pop("bad")


def test_transform_leaves_no_nulls(spark):
    df = generate(spark.createDataFrame(walk(260)), ["moving_averages", "rate_of_change", "money_flow_index"], keep_position=True)
    out = tr.transform(df, rows=64).toPandas()
    assert not out.isna().any().any()
    assert len(out) == 210 and "sma_200" not in out.columns and "close_og" in out.columns


def test_scaling_of_flat_windows(spark):
    pdf = walk(40)
    pdf["close"] = 5.0
    df = tr.rolling_scale(spark.createDataFrame(pdf), ["close"], ["close"][:0]).toPandas()
    assert (df["close"] == 0).all()
    df = tr.rolling_scale(spark.createDataFrame(pdf), [], ["close"]).toPandas()
    assert (df["close"] == 0.5).all()


def test_cfs_keeps_one_of_a_close_pair(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=400)
    pdf = pd.DataFrame({"close": y, "a": y + rng.normal(size=400), "noise": rng.normal(size=400), "flat": 1.0})
    pdf["a2"] = pdf["a"] + rng.normal(0, 0.1, 400)
    pdf["twin"] = y * 2
    got = sel.cfs(spark.createDataFrame(pdf), "close", 5)
    assert len({"a", "a2"} & set(got)) == 1 and "twin" not in got and got[-1] == "close"


def test_trees_find_the_signal_and_votes_count(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    pdf = pd.DataFrame(x, columns=["x0", "x1", "x2"]).assign(close=3 * x[:, 1])
    scores = sel.tree_importance(spark.createDataFrame(pdf), trees=3, depth=3).toPandas()
    assert scores.sort_values("importance").iloc[-1]["feature"] == "x1"
    got = sel.votes(spark, {"p": ["a", "b"], "q": ["b", "close"], "r": None}, "close").collect()
    assert {r["feature"]: r["selected"] for r in got} == {"a": False, "b": True}


@pytest.mark.parametrize("n", [101, 256, 1000, 1597])
def test_spread_fft_equals_one_fft(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) + np.sin(2 * np.pi * np.arange(n) / 12.3)
    pdf = pd.DataFrame({"symbol": "s", "ts": np.arange(n), "log_return": x})
    df = with_position(spark.createDataFrame(pdf))
    got = spectrum_peaks(df).toPandas().sort_values("_k")
    power = np.abs(np.fft.rfft(x))[1 : (n - 1) // 2 + 1] ** 2
    best = np.sort(np.argsort(-power, kind="stable")[:5])
    assert (got["_k"].to_numpy() == best + 1).all()
    np.testing.assert_allclose(got["power"], power[best], rtol=1e-8)


def test_equal_powers_go_to_the_slower_cycles(spark):
    """The powers of one impulse are all equal but for rounding noise."""
    pdf = pd.DataFrame({"symbol": "s", "ts": np.arange(64), "log_return": np.eye(64)[5]})
    got = spectrum_peaks(with_position(spark.createDataFrame(pdf))).collect()
    assert sorted(r["_k"] for r in got) == [1, 2, 3, 4, 5]


def test_cycle_is_found(spark):
    pdf = walk(600)
    pdf["close"] = 100 + 5 * np.sin(2 * np.pi * np.arange(600) / 20)
    df = generate(spark.createDataFrame(pdf), ["log_returns"], keep_position=True)
    row = dominant_cycles(df).where("_i = 5").first()
    assert 20 in row["fft_dominant_periods"]
    cycle = next(c for c in row["fft_cycles"] if c["period"] == 20)
    assert cycle["sin"] == pytest.approx(np.sin(2 * np.pi * 5 / 20))


def test_names_and_paths():
    name = fs.dataset_name("GBP/USD", "MINUTE_5", "2024-02-01", "03/01/2024", source="some feed", ext="csv")
    assert name == "raw_GBP_USD_m5_20240201_20240301_some_feed.csv"
    assert fs.dataset_name("X", "day", "2024/01/02", "2024-01-03T00:00:00", raw=False, info="v1").startswith("processed_v1_X_d_")
    assert fs.processed_path("/d/raw/raw_X.csv") == "/d/processed/processed_X.csv"
    with pytest.raises(ValueError):
        fs.dataset_name("X", "d", "soon", "2024-01-01")


def test_read_rejects_other_inputs(spark):
    for bad in ("bars.txt", 5):
        with pytest.raises(ValueError):
            fs.read_bars(spark, bad)


def test_mid_price_ties_and_errors(spark):
    body = (
        '{"prices":[{"snapshotTimeUTC":"2025-05-01T10:00:00","openPrice":{"bid":1.33210,"ask":1.33221},'
        '"highPrice":{"bid":1.33210,"ask":1.33221},"lowPrice":{"bid":1.1,"ask":1.3},"closePrice":{"bid":1,"ask":2},'
        '"lastTradedVolume":7}]}'
    )
    df = spark.createDataFrame([(body,), ('{"errorCode":"error.x"}',), ("not json",)], "body string")
    rows = vj.broker_bars(df, F.lit("S")).collect()
    assert [(r["open"], r["low"], r["close"], r["volume"]) for r in rows] == [(1.33216, 1.2, 1.5, 7)]
    meta = vj.with_metadata(df).select("error_code", "ok").collect()
    assert [(m["error_code"], m["ok"]) for m in meta] == [(None, True), ("error.x", False), (None, False)]


def test_stream_equals_batch(spark, tmp_path):
    ind.use_rocksdb(spark)
    pdf = pd.concat([walk(80, "A", 1), walk(60, "B", 2)], ignore_index=True)
    df = spark.createDataFrame(pdf)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    # Two files, so that state is carried from one batch to the next.
    cut = pdf["ts"].min() + pd.Timedelta("30h")
    df.where(F.col("ts") < F.lit(cut)).coalesce(1).write.parquet(src)
    df.where(F.col("ts") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    q = (
        ind.live_indicators(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(out)
    )
    q.awaitTermination()
    live = spark.read.parquet(out).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    names = ["macd", "average_true_range", "relative_strength_index", "on_balance_volume"]
    batch = by_row(generate(df, names, keep_position=True))
    both = live.merge(batch, on=["symbol", "ts"], suffixes=("", "_b"))
    # The last bar waits for the watermark.
    assert len(both) == len(live) == 139
    for k in ("macd_line", "macd_signal", "atr", "rsi_14", "obv"):
        np.testing.assert_allclose(both[k].astype(float), both[f"{k}_b"].astype(float), rtol=1e-9, atol=1e-9)


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from tidebars.session import materialize, scratch

    with scratch(spark) as path:
        assert materialize(spark.range(3)).count() == 3 and os.listdir(path)
    assert not os.path.exists(path)


def test_positions_of_another_series_are_refused(spark):
    df = with_position(spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "symbol string, venue string, ts long"))
    with pytest.raises(ValueError, match="positioned within"):
        with_position(df, ["venue", "symbol"])


def test_panels_keyed_by_two_columns(spark):
    from datetime import datetime

    from tidebars.operators.validate import issues

    pdf = pd.concat([walk(60).assign(exchange="p"), walk(60).assign(exchange="q")])
    found = issues(spark.createDataFrame(pdf), datetime(2000, 1, 1), by=("exchange", "symbol"))
    assert {r["exchange"] for r in found.where("code = 'future'").collect()} == {"p", "q"}


def test_plan_of_all_features_reads_tables_a_few_times(spark, sf_dir):
    from tidebars.plans.queries import bars_1h

    plan = generate(bars_1h(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") <= 8


def test_elimination_query_runs_the_whole_job(spark, sf_dir, monkeypatch):
    """All features of the selection table, and the defaults of ``rfecv``."""
    from tidebars.operators import select
    from tidebars.plans.queries import QUERIES, _selection_table

    asked = []
    monkeypatch.setattr(select, "rfecv", lambda df, *args, **kw: asked.append((df, args, kw)) or ([], df))
    QUERIES["l04_rfecv_scores"](spark, sf_dir)
    df, args, kw = asked[0]
    assert args == ("close",) and not kw and {"symbol", "ts"} <= set(df.columns)
    every = set(select.features_of(_selection_table(spark, sf_dir), "close"))
    assert set(select.features_of(df, "close")) == every
    rounds = spark.createDataFrame([], "fold int, n_features int, train_rows long, test_rows long, strongest string")
    monkeypatch.setattr(select, "rfecv_rounds", lambda df, *args, **kw: asked.append((df, args, kw)) or rounds)
    QUERIES["l04_rfecv"](spark, sf_dir)
    df, args, kw = asked[1]
    assert args == ("close",) and not kw and set(select.features_of(df, "close")) == every | {"signal"}


def test_a_lost_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    """The driver dies in the second selection method; the next run reads what had ended and does the rest."""
    from tidebars.plans import engineer as en

    bars = spark.createDataFrame(pd.concat([walk(260, "A", 1), walk(240, "B", 2)]))
    told = {"features": ["rate_of_change", "bollinger_bands", "time_of_day"], "trees": 3, "rfe": {"step": 0.5}, "now": None, "folder": str(tmp_path / "run")}
    with monkeypatch.context() as m:
        real = en.chosen_by

        def dies(x, method, *args):
            if method == "trees":
                raise RuntimeError("driver lost")
            return real(x, method, *args)

        m.setattr(en, "chosen_by", dies)
        with pytest.raises(RuntimeError, match="driver lost"):
            en.engineer(bars, **told)
    calls = []
    with monkeypatch.context() as m:
        m.setattr(en, "generate", lambda *a, **k: pytest.fail("features are there already"))
        m.setattr(en, "chosen_by", lambda x, method, *args: calls.append(method) or real(x, method, *args))
        got = en.engineer(bars, **told)
    assert calls == ["trees", "rfe"]
    stages = [r["stage"] for r in got["manifest"].orderBy("ended").collect()]
    assert stages == ["cleaned", "issues", "features", "transformed", "matrix", "chosen-cfs", "chosen-trees", "chosen-rfe", "selected"]
    whole = en.engineer(bars, **{**told, "folder": str(tmp_path / "whole")})["selected"]
    assert sorted(map(str, got["selected"].collect())) == sorted(map(str, whole.collect()))
    # Other bars, or other arguments, are another run.
    from tidebars.plans.stages import Stages, content

    other = content(bars.where("volume > 200"))
    assert other != content(bars) and content(bars.repartition(3)) == content(bars)
    assert not Stages(spark, str(tmp_path / "run"), other).known.get(Stages(spark, str(tmp_path / "run"), other).print)


def test_whole_way_with_two_keys(spark, tmp_path):
    """Two venues with symbols of one name, to the written table."""
    from tidebars.plans.engineer import engineer

    pdf = pd.concat([walk(120, s, k).assign(venue=v) for k, (v, s) in enumerate([(1, "A"), (1, "B"), (2, "A")])])
    out = engineer(spark.createDataFrame(pdf), ["rate_of_change", "bollinger_bands"], trees=3, rfe={"step": 0.5}, out=str(tmp_path / "t"), by=("venue", "symbol"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert (tmp_path / "t" / "venue=2" / "symbol=A").is_dir() and back.count() == out["transformed"].count()
    assert {(r["venue"], r["symbol"]) for r in back.collect()} == {(1, "A"), (1, "B"), (2, "A")}
    assert "venue" not in {r["feature"] for r in out["votes"].collect()} and out["selected"].columns[:3] == ["venue", "symbol", "ts"]


def test_responses_land_exactly_once(spark, tmp_path):
    files, out = tmp_path / "in", str(tmp_path / "bronze")
    files.mkdir()
    (files / "a.json").write_text('{"instrument":"X","resolution":"HOUR","prices":[{"lastTradedVolume":3},\n{"lastTradedVolume":4}]}')
    (files / "b.json").write_text('{"errorCode":"error.x"}')
    first = vj.land_responses(spark, str(files), out)
    assert {(r["file_path"].rsplit("/", 1)[1], r["n_points"], r["ok"], r["error_code"]) for r in first.collect()} == {("a.json", 2, True, None), ("b.json", 0, False, "error.x")}
    assert vj.land_responses(spark, str(files), out).count() == 2
    (files / "c.json").write_text("not json")
    again = vj.land_responses(spark, str(files), out)
    assert sorted(r["file_path"].rsplit("/", 1)[1] for r in again.collect()) == ["a.json", "b.json", "c.json"]
    assert all(r["file_size"] > 0 and r["body"] for r in again.collect())


def test_coverage_of_many_ranges(spark):
    """Overlapping and disjoint ranges of one symbol, against a plain count."""
    from datetime import datetime, timedelta

    from tidebars.sources.coverage import coverage

    start = datetime(2024, 1, 1)
    stamps = [start + timedelta(minutes=7 * k) for k in range(300)]
    ranges = [(f, f + timedelta(minutes=m)) for k in range(60) for f, m in [(start + timedelta(minutes=31 * k), 1 + 17 * k % 400)]] + [(start, start + timedelta(days=2)), (start, start + timedelta(days=1))]
    got = coverage(
        spark.createDataFrame([("A", t) for t in stamps] + [("B", start)], "symbol string, ts timestamp"),
        spark.createDataFrame([("A", a, b) for a, b in ranges], "symbol string, from_ts timestamp, to_ts timestamp"), "MINUTE_5", 12,
    )
    want = []
    for a, b in ranges:
        for k in range(-(-int((b - a).total_seconds()) // 3600)):
            lo, hi = a + timedelta(hours=k), min(a + timedelta(hours=k + 1), b)
            inside = [t for t in stamps if lo <= t < hi]
            want.append((a, k, lo, hi, len(inside), min(inside, default=None), max(inside, default=None)))
    rows = [(r["from_ts"], r["chunk"], r["chunk_start"], r["chunk_end"], r["n_points"], r["first_ts"], r["last_ts"]) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_a_plain_local_session_has_a_scratch_folder(tmp_path):
    """Without any settings of its own: Spark forbids naming the checkpoint folder at run time."""
    import os
    import subprocess
    import sys

    said = "from tidebars.session import get_spark, materialize; s = get_spark(master='local[1]'); print('rows', materialize(s.range(3)).count() + materialize(s.range(4)).count())"
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([os.getcwd(), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", said], env=env, capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "rows 7" in done.stdout, done.stderr[-2000:]


def test_updates_and_late_bars_on_a_stream(spark, tmp_path):
    """Two keys; of several updates the one with the largest number counts, in whatever order files bring them, and bars
    behind the watermark change nothing."""
    ind.use_rocksdb(spark)
    pdf = pd.concat([walk(60, "A", k).assign(venue=k, arrived=2) for k in (1, 2)], ignore_index=True)
    wrong = pdf.assign(close=1.0, high=2.0, low=0.5, arrived=1)
    cut = pdf["ts"].min() + pd.Timedelta("30h")
    parts = [pd.concat([pdf[pdf["ts"] < cut], wrong[wrong["ts"] < cut]]), pd.concat([wrong, pdf[pdf["ts"] >= cut], wrong[wrong["ts"] < cut - pd.Timedelta("1D")].assign(arrived=9)])]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        df = spark.createDataFrame(part.sample(frac=1, random_state=1))
        df.repartition(3).write.mode("append").parquet(src)
        stream = ind.live_indicators(spark.readStream.schema(df.schema).parquet(src), "2 hours", by=("venue", "symbol"), arrived="arrived")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out).toPandas().sort_values(["venue", "ts"], ignore_index=True)
    batch = generate(spark.createDataFrame(pdf.drop(columns="arrived")), ["macd", "average_true_range", "relative_strength_index", "on_balance_volume"], by=("venue", "symbol"))
    both = got.merge(batch.toPandas(), on=["venue", "symbol", "ts"], suffixes=("", "_b"))
    # The last two hours wait for the watermark.
    assert len(got) == len(both) == 2 * 58
    for k in ("close", "macd_line", "macd_signal", "atr", "rsi_14", "obv"):
        np.testing.assert_allclose(both[k].astype(float), both[f"{k}_b"].astype(float), rtol=1e-9, atol=1e-9)
