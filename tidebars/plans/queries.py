"""Registered queries: each operator over whole tables.

Bars come from ``events`` (hourly, symbol = event type) and from ``orders`` (daily,
symbol = priority). ``dirty`` bars are the hourly ones with defects placed by position.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.functions.columns import OHLCV, PRICES, c
from tidebars.operators import clean as cl
from tidebars.operators import model_prep as mp
from tidebars.operators import select as sel
from tidebars.operators import transform as tr
from tidebars.operators import validate as va
from tidebars.operators.blocks import Frames, own_rows, with_halo, with_position
from tidebars.operators.quantiles import quantiles
from tidebars.plans.engineer import engineer, stage_profile
from tidebars.plans.registry import generate, generated_features, preconditions
from tidebars.session import materialize, scratch_dir
from tidebars.sources import coverage as cov
from tidebars.sources import files as fs
from tidebars.sources import vendor_json as vj
from tidebars.sources.ticks import bars_from_ticks, coarser_bars
from tidebars.streaming import indicators as ind
from tidebars.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = datetime(2024, 1, 20)
MARKER = "~end"


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


# ---- inputs -----------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The tables hold stamps without a zone; they are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("size"),
        "event_id",
    )


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), "HOUR", size="size", seq="event_id")


def bars_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), "MINUTE", size="size", seq="event_id")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("price"),
        "o_orderkey",
    )
    return bars_from_ticks(trades, "DAY", seq="o_orderkey")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_position(bars_1h(spark, sf_dir))
    fr = Frames()
    i = F.col("_i")
    df = own_rows(with_halo(df, 1).withColumn("_pts", fr.lag("ts")), 1)
    lost = i % 10 == 3
    scale = F.when(i % 33 == 5, 10.0).otherwise(1.0)
    none = F.lit(None).cast("double")
    return df.select(
        "symbol",
        F.when(i % 20 == 7, F.col("_pts")).otherwise(F.col("ts")).alias("ts"),
        i.alias("seq"),
        F.when(lost | (i < 2) | (i % 25 == 12), none).when(i % 100 == 41, 0.0).otherwise(F.col("open") * scale).alias("open"),
        F.when(lost | (i % 25 == 14), none)
        .when(i % 40 == 21, F.col("open") * 0.9)
        .when(i % 100 == 71, -F.col("high"))
        .otherwise(F.col("high") * scale)
        .alias("high"),
        F.when(lost | (i % 25 == 16), none)
        .when(i % 40 == 11, F.col("open") * 1.1)
        .when(i % 100 == 81, 0.0)
        .otherwise(F.col("low") * scale)
        .alias("low"),
        F.when(lost | (i < 3), none)
        .when(i % 50 == 29, 0.0)
        .otherwise(F.col("close") * scale)
        .alias("close"),
        F.when(lost | (i % 25 == 18), F.lit(None).cast("long"))
        .when(i % 50 == 19, -F.col("volume"))
        .when(i % 50 == 9, F.col("volume") * 50)
        .when(i % 200 == 130, F.col("volume") * 1_000_000_000)
        .otherwise(F.col("volume"))
        .alias("volume"),
    )


def emit(df: DataFrame, *names: str, dp: int = 6) -> DataFrame:
    """Doubles rounded, timestamps without zone, columns as named."""
    out = []
    for n in names or df.columns:
        kind = df.schema[n].dataType
        if isinstance(kind, T.DoubleType):
            out.append((F.round(c(n), dp) + F.lit(0.0)).alias(n))
        elif isinstance(kind, T.TimestampType):
            out.append(c(n).cast("timestamp_ntz").alias(n))
        else:
            out.append(c(n))
    return df.select(*out)


# ---- sources, sinks ---------------------------------------------------------


@query("s01_read_bars")
def _(spark, sf):
    """CSV with capital headers out and in again, as the raw files of a vendor come."""
    path = f"{scratch_dir(spark)}/bars-{datetime.now().timestamp()}.csv"
    raw = bars_1h(spark, sf).select("symbol", F.col("ts").alias("Date"), *[c(n).alias(n.title()) for n in OHLCV])
    raw.write.option("header", True).csv(path)
    df = cl.parse_timestamps(cl.null_tokens(fs.read_bars(spark, path)))
    return emit(cl.consistent_types(df), "symbol", "ts", *OHLCV)


@query("s02_lower_names")
def _(spark, sf):
    df = bars_1h(spark, sf)
    return emit(fs.lower_names(df.toDF(*[n.upper() for n in df.columns])))


def _responses(spark, sf):
    """Broker responses, one per symbol and day, quotes a fixed spread around the ticks."""
    df = bars_1h(spark, sf)

    def number(n):
        p = c(n).cast("decimal(20,5)")
        bid, ask = p - F.lit("0.00003").cast("decimal(20,5)"), p + F.lit("0.00006").cast("decimal(20,5)")
        return F.format_string('{"bid":%s,"ask":%s}', bid.cast("string"), ask.cast("string"))

    price = F.format_string(
        '{"snapshotTimeUTC":"%s","openPrice":%s,"highPrice":%s,"lowPrice":%s,"closePrice":%s,'
        '"lastTradedVolume":%s}',
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        number("open"),
        number("high"),
        number("low"),
        number("close"),
        F.col("volume").cast("string"),
    )
    day = F.to_date("ts")
    # A day of hourly bars: at most 24 entries per document.
    return df.groupBy("symbol", day.alias("day")).agg(
        F.format_string(
            '{"instrument":"%s","resolution":"HOUR","from":"%s","prices":[%s]}',
            F.first("symbol"),
            F.first(day).cast("string"),
            F.array_join(F.sort_array(F.collect_list(price)), ","),
        ).alias("body")
    )


@query("s03_broker_json")
def _(spark, sf):
    return emit(vj.broker_bars(_responses(spark, sf), "symbol"), "symbol", "ts", *OHLCV)


@query("s04_equity_json")
def _(spark, sf):
    df = bars_1h(spark, sf).withColumn("day", F.to_date("ts"))
    gone = F.hour("ts") % 7 == 3
    entry = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("key"),
        F.map_filter(
            F.create_map(
                *[
                    x
                    for k, n in enumerate(OHLCV)
                    for x in (F.lit(f"{k + 1}. {n}"), c(n).cast("string"))
                ]
            ),
            lambda k, v: ~(gone & (k == "5. volume")),
        ).alias("value"),
    )
    docs = df.groupBy("symbol", "day").agg(
        F.to_json(
            F.create_map(
                F.lit("Meta Data"),
                F.map_from_entries(F.array(F.struct(F.lit("x"), F.create_map(F.lit("a"), F.lit("b"))))),
                F.lit("Time Series (60min)"),
                F.map_from_entries(F.collect_list(entry)),
            )
        ).alias("body")
    )
    return emit(vj.equity_bars(docs, "symbol"), "symbol", "ts", *OHLCV)


@query("s05_concat_chunks")
def _(spark, sf):
    """Two chunks that share the bars of one day; the earlier chunk wins."""
    df = bars_1h(spark, sf)
    early = df.where("ts < '2024-01-16'")
    late = df.where("ts >= '2024-01-15'").withColumn("close", F.col("close") + 1)
    return emit(vj.concat_chunks(early, late), "symbol", "ts", *OHLCV)


def _ranges(spark, sf):
    df = bars_1h(spark, sf).groupBy("symbol").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))
    return df.withColumn("to_ts", F.col("to_ts") + F.expr("INTERVAL 40 HOURS"))


@query("s06_chunk_plan")
def _(spark, sf):
    return emit(cov.chunk_plan(_ranges(spark, sf), "MINUTE_5", 100))


@query("s07_coverage")
def _(spark, sf):
    return emit(cov.coverage(bars_1h(spark, sf), _ranges(spark, sf), "MINUTE_5", 100))


@query("s07_coverage_summary")
def _(spark, sf):
    cover = cov.coverage(bars_1h(spark, sf), _ranges(spark, sf), "MINUTE_5", 100)
    return emit(cov.coverage_summary(cover))


@query("s07_coverage_two_ranges")
def _(spark, sf):
    """Two ranges of each symbol, with the same chunk numbers."""
    whole = _ranges(spark, sf)
    half = F.timestamp_micros(F.floor((F.unix_micros("from_ts") + F.unix_micros("to_ts")) / 2))
    two = whole.withColumn("to_ts", half).unionByName(whole.withColumn("from_ts", half))
    return emit(cov.coverage(bars_1h(spark, sf), two, "MINUTE_5", 100))


@query("s08_write_processed")
def _(spark, sf):
    path = f"{scratch_dir(spark)}/processed-{datetime.now().timestamp()}"
    fs.write_bars(bars_1h(spark, sf), path)
    back = spark.read.parquet(path)
    return emit(back.withColumn("symbol", c("symbol").cast("string")), "symbol", "ts", *OHLCV)


@query("s09_dataset_names")
def _(spark, sf):
    return emit(fs.dataset_names(bars_1d(spark, sf), "DAY"), "symbol", "dataset")


@query("s10_bars_1h")
def _(spark, sf):
    return emit(bars_1h(spark, sf), "symbol", "ts", *OHLCV)


@query("s10_bars_1m")
def _(spark, sf):
    return emit(bars_1m(spark, sf), "symbol", "ts", *OHLCV)


@query("s10_coarser_bars")
def _(spark, sf):
    return emit(coarser_bars(bars_1h(spark, sf), "HOUR_4"), "symbol", "ts", *OHLCV)


def _account_docs(spark, sf):
    """One document per nation with its customers as accounts."""
    cust = table(spark, sf, "customer")
    account = F.struct(
        c("c_custkey").cast("string").alias("accountId"),
        c("c_name").alias("accountName"),
        F.struct(c("c_acctbal").alias("available")).alias("balance"),
    )
    # Documents of at most 1000 customers each.
    part = F.floor(F.col("c_custkey") / 1000)
    return cust.groupBy("c_nationkey", part.alias("part")).agg(
        F.to_json(F.struct(F.collect_list(account).alias("accounts"))).alias("body")
    )


@query("s11_accounts")
def _(spark, sf):
    return emit(vj.accounts(_account_docs(spark, sf)), dp=2)


@query("s11_account_by_name")
def _(spark, sf):
    return emit(vj.account_by_name(_account_docs(spark, sf), "Customer#000000042"), dp=2)


def _position_docs(spark, sf):
    orders = table(spark, sf, "orders")
    deal = F.when(c("o_orderkey") % 5 != 0, F.concat(F.lit("D"), c("o_orderkey").cast("string")))
    position = F.struct(F.struct(deal.alias("dealId")).alias("position"))
    # Documents of at most 1000 keys each, however many orders a customer has.
    return orders.groupBy("o_custkey", F.floor(F.col("o_orderkey") / 1000).alias("part")).agg(
        F.to_json(F.struct(F.collect_list(position).alias("positions"), F.lit("X1").alias("dealReference"))).alias("body")
    )


@query("s12_deals")
def _(spark, sf):
    return vj.deals(_position_docs(spark, sf)).select("o_custkey", "deal_id")


@query("s12_deal_counts")
def _(spark, sf):
    deals = vj.deals(_position_docs(spark, sf))
    return deals.groupBy("o_custkey").agg(F.count("deal_id").alias("n_deals"))


@query("s13_json_key")
def _(spark, sf):
    df = table(spark, sf, "events")
    return df.select("event_id", vj.json_key("k", "props").alias("k"))


@query("s14_landed_responses")
def _(spark, sf):
    """Responses as files, one document each; half of them land, then the rest, then nothing more."""
    at = f"{scratch_dir(spark)}/landing-{datetime.now().timestamp()}"
    docs = materialize(_responses(spark, sf))
    odd = F.xxhash64("symbol", "body") % 2 == 0
    for part in (docs.where(odd), docs.where(~odd), docs.limit(0)):
        part.select("symbol", "body").write.mode("append").partitionBy("symbol").option("maxRecordsPerFile", 1).text(f"{at}/files")
        landed = vj.land_responses(spark, f"{at}/files", f"{at}/bronze", keys="symbol string")
    return landed.select(
        "symbol",
        "instrument",
        "resolution",
        c("from_ts").cast("timestamp_ntz").alias("from_ts"),
        c("n_points").cast("long").alias("n_points"),
        "ok",
    )


# ---- cleaning ---------------------------------------------------------------


@query("c01a_null_tokens")
def _(spark, sf):
    df = bars_1h(spark, sf)
    h = F.hour("ts")
    text = F.when(h == 1, "NA").when(h == 2, "").when(h == 3, "None").otherwise(c("close").cast("string"))
    vol = F.when(h == 4, "N/A").otherwise(c("volume").cast("string"))
    return emit(cl.null_tokens(df.withColumns({"close": text, "volume": vol})), "symbol", "ts", "close", "volume")


@query("c01_fill_missing")
def _(spark, sf):
    return emit(cl.fill_missing(dirty(spark, sf)), "symbol", "seq", *OHLCV)


@query("c01f_interpolate")
def _(spark, sf):
    df = with_position(dirty(spark, sf).withColumn("volume", c("volume").cast("double")), order=["ts", "seq"])
    return emit(cl.interpolate(df, OHLCV), "symbol", "seq", *OHLCV)


@query("c02_drop_duplicates")
def _(spark, sf):
    return emit(cl.drop_duplicates(dirty(spark, sf), first="seq"), "symbol", "ts", "seq", "close")


@query("c03_timestamps")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    text = F.when(
        F.col("event_id") % 3 == 0,
        F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")),
    ).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("never")
    return emit(cl.parse_timestamps(df.withColumn("ts", text)))


@query("c04_fill_gaps")
def _(spark, sf):
    return emit(cl.fill_gaps(bars_1h(spark, sf)), "symbol", "ts", *OHLCV)


@query("c04_bar_interval")
def _(spark, sf):
    return emit(cl.bar_interval(with_position(bars_1h(spark, sf))))


def _off_grid(spark, sf):
    """Hourly bars of which every 50th stands 17 minutes late."""
    df = with_position(bars_1h(spark, sf))
    late = F.col("ts") + F.expr("INTERVAL 17 MINUTES")
    return df.withColumn("ts", F.when(F.col("_i") % 50 == 49, late).otherwise(F.col("ts"))).drop("_i", "_n")


@query("c04_off_grid")
def _(spark, sf):
    return emit(cl.fill_gaps(_off_grid(spark, sf)), "symbol", "ts", *OHLCV)


@query("c04_off_grid_counts")
def _(spark, sf):
    return cl.grid_report(_off_grid(spark, sf))


@query("c02_null_order")
def _(spark, sf):
    """Copies of which some or all have no number: values stay, and ties go by value."""
    df = dirty(spark, sf).withColumn("seq", F.when(c("seq") % 20 != 6, c("seq")))
    return emit(cl.drop_duplicates(df.select("symbol", "ts", "seq", "close", "open"), first="seq"), "symbol", "ts", "seq", "close", "open")


@query("c05_outlier_bounds")
def _(spark, sf):
    return emit(cl.outlier_bounds(bars_1h(spark, sf)), dp=4)


@query("c05_cap_outliers")
def _(spark, sf):
    return emit(cl.cap_outliers(bars_1h(spark, sf)), "symbol", "ts", *OHLCV)


@query("c06_types")
def _(spark, sf):
    df = bars_1h(spark, sf).withColumn("volume", (c("volume") + 0.5).cast("string"))
    return emit(cl.consistent_types(df), "symbol", "ts", *OHLCV)


@query("c07_repair_ohlc")
def _(spark, sf):
    return emit(cl.repair_ohlc(dirty(spark, sf)), "symbol", "seq", *OHLCV)


@query("c07_repair_counts")
def _(spark, sf):
    return cl.repair_counts(dirty(spark, sf))


@query("c08_partial_columns")
def _(spark, sf):
    """Cleaning with close and volume only."""
    return emit(cl.clean(dirty(spark, sf).select("symbol", "ts", "seq", "close", "volume")), "symbol", "ts", "close", "volume")


@query("c09_clean")
def _(spark, sf):
    return emit(cl.clean(dirty(spark, sf)), "symbol", "ts", *OHLCV)


# ---- validation -------------------------------------------------------------


@query("v01_affected_rows")
def _(spark, sf):
    df = with_position(dirty(spark, sf), order=["ts", "seq"])
    return emit(va.affected_rows(df, NOW)).select("symbol", "ts", "code", c("detail").cast("double").alias("gap_seconds"))


@query("v01_issues")
def _(spark, sf):
    df = with_position(dirty(spark, sf), order=["ts", "seq"])
    return emit(va.issues(df, NOW))


@query("v04_unreadable_timestamps")
def _(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 == 0, "soon").otherwise(c("ts").cast("string")).alias("ts")
    )
    return va.unreadable_timestamps(df)


@query("v11_missing_columns")
def _(spark, sf):
    df = bars_1d(spark, sf).select("symbol", "ts", "close")
    return emit(va.issues(df).where("code = 'missing_columns'"), "symbol", "code", "issue_type", "description", "n_rows")


@query("v12_few_rows")
def _(spark, sf):
    """Weekly bars: few enough that the minimum matters."""
    weekly = coarser_bars(bars_1h(spark, sf), "WEEK")
    return emit(va.issues(weekly).where("code = 'few_rows'"), "symbol", "code", "issue_type", "description", "n_rows")


@query("v13_verdict")
def _(spark, sf):
    """Hourly bars, and one symbol with steady daily bars that has nothing to complain about."""
    steady = F.lit(100.0) + F.col("k") % 5
    calm = spark.range(60).select(F.lit("calm").alias("symbol"), F.col("id").alias("k")).select(
        "symbol", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("k") * 86_400).alias("ts"),
        steady.alias("open"), (steady + 2).alias("high"), (steady - 2).alias("low"), (steady + 1).alias("close"), (F.lit(1000) + F.col("k")).alias("volume"),
    )
    df = with_position(bars_1h(spark, sf).unionByName(calm))
    return va.verdict(df, va.issues(df))


# ---- features ---------------------------------------------------------------

MARKET_STATES = [f"state_{v}_vol_{t}" for v in ("low", "medium", "high") for t in ("ranging", "weak_trend", "strong_trend")]
FEATURE_COLUMNS = {
    "f01_sma": ("moving_averages", [f"sma_{n}" for n in (5, 10, 20, 50, 200)]),
    "f02_ema": ("ema", [f"ema_{n}" for n in (5, 10, 20, 50, 200)]),
    "f03_rate_of_change": ("rate_of_change", [f"roc_{n}" for n in (1, 5, 10, 20, 60)]),
    "f04_atr": ("average_true_range", ["atr"]),
    "f05_bollinger": ("bollinger_bands", ["std", "sma_20", "upper_band", "lower_band", "bb_width"]),
    "f06_support_resistance": ("support_resistance", ["distance_from_high", "distance_from_low"]),
    "f07_volume_averages": (
        "volume_moving_averages",
        [f"{p}_{n}" for n in (7, 15, 30, 60) for p in ("vma", "relative_volume")],
    ),
    "f08_volume_roc": ("volume_rate_of_change", [f"vroc_{n}" for n in (1, 5, 10, 20)]),
    "f09_obv": ("on_balance_volume", ["obv"]),
    "f10_volume_profile": ("volume_profile", [f"vol_bin_{k}" for k in range(10)]),
    "f11_point_of_control": ("volume_profile", ["vol_poc", "close_to_poc_pct"]),
    "f12_value_area": ("volume_profile", ["vol_va_high", "vol_va_low", "vol_va_width", "in_value_area"]),
    "f14_concentration": ("volume_profile", ["vol_concentration"]),
    "f15_vwap": ("vwap", ["vwap"]),
    "f15_vwap_session": ("vwap_session", ["vwap_session"]),
    "f16_mfi": ("money_flow_index", ["mfi"]),
    "f17_rsi": ("relative_strength_index", ["rsi_14"]),
    "f18_macd": ("macd", ["macd_line", "macd_signal", "macd_histogram"]),
    "f19_adx": ("average_directional_index", ["+di", "-di", "adx"]),
    "f20_stochastic": ("stochastic_oscillator", ["stoch_k", "stoch_d"]),
    "f21_cci": ("commodity_channel_index", ["cci"]),
    "f22_ichimoku": (
        "ichimoku_cloud",
        [f"ichimoku_{n}" for n in ("tenkan", "kijun", "senkou_a", "senkou_b", "chikou")],
    ),
    "f23_time_of_day": ("time_of_day", ["hour_sin", "hour_cos", "session"]),
    "f24_day_of_week": ("day_of_week", ["day_of_week_sin", "day_of_week_cos"]),
    "f25_time_of_week": ("time_of_week", ["hour_of_week_sin", "hour_of_week_cos", "is_weekend"]),
    "f26_time_of_month": (
        "time_of_month",
        ["month_progress_sin", "month_progress_cos", "month_period", "month_of_year_sin", "month_of_year_cos"],
    ),
    "f27_seasonal": (
        "seasonal_decompose",
        [f"seasonal_{n}" for n in ("trend", "seasonal", "residual", "norm")],
    ),
    "f28_stl": (
        "stl_decomposition",
        [f"stl_{n}" for n in ("trend", "seasonal", "residual", "seasonal_strength", "trend_strength")],
    ),
    "f29_mstl": (
        "mstl_decomposition",
        ["mstl_trend", "mstl_seasonal_24", "mstl_seasonal_160", "mstl_residual"],
    ),
    "f32_volatility": (
        "volatility_regimes",
        ["returns", "volatility_short", "volatility_long", "volatility_ratio"],
    ),
    "f34_volatility_regime": (
        "volatility_regimes",
        ["volatility_regime", "vol_regime_low", "vol_regime_medium", "vol_regime_high"],
    ),
    "f36_volatility_change": ("volatility_regimes", ["volatility_zscore", "volatility_change"]),
    "f37_adx_regime": (
        "trend_strength_indicators",
        ["adx_trend_regime", "adx_regime_trending", "adx_regime_ranging"],
    ),
    "f38_sma_distance": (
        "trend_strength_indicators",
        [f"dist_from_sma_{n}" for n in (20, 50, 200)] + [f"sma_{n}_slope" for n in (20, 50, 200)],
    ),
    "f39_ma_cross": ("trend_strength_indicators", ["ma_cross_50_200"]),
    "f40_regression": (
        "trend_strength_indicators",
        ["regression_slope", "r_squared", "norm_regression_slope"],
    ),
    "f41_trend_strength": (
        "trend_strength_indicators",
        ["trend_strength", "trend_regime"] + [f"trend_regime_{n}" for n in ("ranging", "weak_trend", "strong_trend")],
    ),
    "f42_market_state": (
        "market_state_indicators",
        ["vol_regime_num", "trend_regime_num", "market_state", "market_state_desc", *MARKET_STATES],
    ),
    "f43_state_duration": ("market_state_indicators", ["market_state", "state_duration"]),
    "f44_log_return": ("log_returns", ["log_return"]),
    "f45_cycles": ("fast_fourier_transforms", ["fft_dominant_periods", "fft_cycles"]),
}


def _feature_query(feature: str, cols: list[str]) -> Query:
    return lambda spark, sf: emit(generate(bars_1h(spark, sf), [feature]), "symbol", "ts", *cols)


for _name, (_feature, _cols) in FEATURE_COLUMNS.items():
    QUERIES[_name] = _feature_query(_feature, _cols)


@query("f27_seasonal")
def _(spark, sf):
    """Means over 320 halves of cents end in 5 at many places; the nudge keeps rounding
    from depending on the last bit."""
    cols = FEATURE_COLUMNS["f27_seasonal"][1]
    df = generate(bars_1h(spark, sf), ["seasonal_decompose"])
    return emit(df.withColumns({n: c(n) + 1e-9 for n in cols}), "symbol", "ts", *cols)


@query("f45_cycles")
def _(spark, sf):
    df = _told_cycles(generate(bars_1h(spark, sf), ["fast_fourier_transforms"]))
    return emit(df, "symbol", "ts", "periods", "n_cycles", "sin_sum", "cos_sum")


def _told_cycles(df: DataFrame) -> DataFrame:
    """Periods as text, and sums over the cycles of a row, which every language rounds alike."""
    total = lambda part: F.aggregate("fft_cycles", F.lit(0.0), lambda a, x: a + x[part])
    periods = F.array_join(F.transform("fft_dominant_periods", lambda p: p.cast("string")), ",")
    new = {"periods": periods, "n_cycles": F.size("fft_cycles"), "sin_sum": total("sin"), "cos_sum": total("cos")}
    return df.withColumns(new).drop("fft_cycles", "fft_dominant_periods")


@query("f28_stl_sum")
def _(spark, sf):
    """The parts of each decomposition add up to the close again."""
    df = generate(bars_1h(spark, sf), ["stl_decomposition", "mstl_decomposition"])
    stl = sum((c(f"stl_{n}") for n in ("seasonal", "residual")), c("stl_trend"))
    mstl = sum((c(f"mstl_{n}") for n in ("seasonal_24", "seasonal_160", "residual")), c("mstl_trend"))
    return emit(df.withColumns({"stl": stl, "mstl": mstl}), "symbol", "ts", "stl", "mstl", dp=4)


@query("f30_holidays")
def _(spark, sf):
    df = generate(bars_1d(spark, sf), ["holiday_features"])
    return emit(df, "symbol", "ts", "is_holiday", "days_to_next_holiday")


@query("f30_far_holidays")
def _(spark, sf):
    """Dates moved 200 years on and 250 back: the rules know no years."""
    df = bars_1d(spark, sf)
    for shift in (200, -250):
        moved = df.withColumn("ts", F.col("ts") + F.make_interval(F.lit(shift)))
        out = moved if shift == 200 else out.unionByName(moved)
    return emit(generate(out.withColumn("symbol", F.concat_ws(" ", "symbol", F.year("ts") > 2100)), ["holiday_features"]), "symbol", "ts", "is_holiday", "days_to_next_holiday")


@query("f33_two_regimes")
def _(spark, sf):
    out = generate(bars_1h(spark, sf), {"volatility_regimes": {"n_regimes": 2}})
    return emit(out, "symbol", "ts", "volatility_regime", "vol_regime_low", "vol_regime_high")


@query("f46_feature_list")
def _(spark, sf):
    return generated_features(generate(bars_1h(spark, sf), ["moving_averages", "time_of_day"], keep_position=True))


@query("f47_preconditions")
def _(spark, sf):
    return preconditions(dirty(spark, sf))


@query("f47_all_features")
def _(spark, sf):
    """Cycles as in ``f45_cycles``; the classical parts nudged as in ``f27_seasonal``."""
    df = _told_cycles(generate(bars_1h(spark, sf)))
    return emit(df.withColumns({n: c(n) + 1e-9 for n in FEATURE_COLUMNS["f27_seasonal"][1]}))


# ---- transformation ---------------------------------------------------------


def _small_features(spark, sf, keep=False):
    names = ["moving_averages", "rate_of_change", "on_balance_volume", "money_flow_index", "time_of_day"]
    return generate(bars_1h(spark, sf), names, keep_position=keep)


@query("t01_null_shares")
def _(spark, sf):
    return emit(tr.null_shares(_small_features(spark, sf)))


@query("t01_drop_sparse")
def _(spark, sf):
    df = _small_features(spark, sf).withColumn("mostly", F.when(F.hour("ts") == 0, c("close")))
    kept = tr.drop_sparse(df)
    return emit(kept, "symbol", "ts", *[n for n in kept.columns if n.startswith(("sma", "mostly"))])


@query("t02_drop_warmup")
def _(spark, sf):
    return emit(tr.drop_warmup(_small_features(spark, sf)), "symbol", "ts", "sma_200")


@query("t03_fill_scattered")
def _(spark, sf):
    df = with_position(dirty(spark, sf), order=["ts", "seq"])
    return emit(tr.fill_scattered(df.drop("ts").withColumnRenamed("seq", "ts")), "symbol", "ts", *OHLCV)


@query("t04_unique_names")
def _(spark, sf):
    df = bars_1h(spark, sf)
    return emit(tr.unique_names(df.select("symbol", "ts", "close", "open", "close", "close")))


@query("t05_column_groups")
def _(spark, sf):
    return emit(tr.group_profile(_small_features(spark, sf)), dp=4)


@query("t06_log_volume")
def _(spark, sf):
    return emit(tr.log_volume(bars_1h(spark, sf), ["volume"], True), "symbol", "ts", "volume_log")


@query("t07_z_score")
def _(spark, sf):
    df = tr.rolling_scale(bars_1h(spark, sf), ["close", "volume"], preserve=True)
    return emit(df, "symbol", "ts", "close_norm", "volume_norm")


@query("t08_minmax")
def _(spark, sf):
    df = tr.rolling_scale(bars_1h(spark, sf), minmax=["close"], backfill=True)
    return emit(df, "symbol", "ts", "close")


@query("t09_one_hot")
def _(spark, sf):
    df = generate(bars_1h(spark, sf), ["time_of_day"])
    df = tr.one_hot_columns(df, {"session": ["asian_session", "european_session", "us_session"]})
    return emit(df, "symbol", "ts", *[n for n in df.columns if n.startswith("session_")])


@query("t10_transform")
def _(spark, sf):
    df = generate(bars_1h(spark, sf), ["moving_averages", "rate_of_change", "money_flow_index"], keep_position=True)
    return emit(tr.transform(df), "symbol", "ts", "close", "close_og", "volume", "sma_20", "roc_5", "mfi")


# ---- selection --------------------------------------------------------------


def _selection_table(spark, sf, keys=()):
    names = ["rate_of_change", "bollinger_bands", "support_resistance", "volume_moving_averages", "money_flow_index"]
    return materialize(generate(bars_1h(spark, sf), names).drop(*{"symbol", "ts"} - set(keys)))


@query("l01_correlations")
def _(spark, sf):
    df = _selection_table(spark, sf)
    return emit(sel.correlations(df, ["close", *sorted(sel.features_of(df, "close"))]))


@query("l02_cfs")
def _(spark, sf):
    names = sel.cfs(_selection_table(spark, sf), "close", 15)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("l03_tree_importance")
def _(spark, sf):
    """Features are rounded first, so that equal ones are equal in every engine; their sums are whole numbers."""
    return emit(sel.tree_importance(emit(_selection_table(spark, sf)), "close"))


@query("l04_rfecv")
def _(spark, sf):
    """Every round of every fold, with a feature that follows the target; it must be the strongest in all of them."""
    planted = _selection_table(spark, sf, ("symbol", "ts")).withColumn("signal", c("close") * 1.05)
    return sel.rfecv_rounds(planted, "close").select("fold", "n_features", "train_rows", "test_rows", "strongest")


@query("l04_rfecv_scores")
def _(spark, sf):
    return sel.rfecv(_selection_table(spark, sf, ("symbol", "ts")), "close")[1]


@query("l04_time_folds")
def _(spark, sf):
    return emit(sel.time_folds(bars_1h(spark, sf), 5).withColumnRenamed("_fold", "fold"), "symbol", "ts", "fold")


@query("l05_votes")
def _(spark, sf):
    """Three ways to rank features by correlation, and what two of them agree on."""
    df = _selection_table(spark, sf)
    chosen = {
        "strict": sel.cfs(df, "close", 15, 0.5),
        "loose": sel.cfs(df, "close", 15, 0.9),
        "volume": sel.cfs(df, "volume", 15, 0.9),
    }
    return sel.votes(spark, chosen, "close")


@query("l06_correlation_report")
def _(spark, sf):
    return emit(sel.correlation_report(_selection_table(spark, sf), "close"))


def _listed(spark, sf):
    """A list column of whole numbers per customer, standing for dominant periods."""
    orders = table(spark, sf, "orders")
    days = F.sort_array(F.collect_set(F.day("o_orderdate")))
    return orders.groupBy("o_custkey").agg(days.alias("fft_dominant_periods"))


@query("l07_expand_periods")
def _(spark, sf):
    return emit(mp.expand_periods(_listed(spark, sf)))


@query("l08_one_hot_categories")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return mp.encode_categories(df, keep=[])


@query("l08_label_codes")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    return mp.encode_categories(df, keep=[])


@query("l09_numeric_only")
def _(spark, sf):
    return emit(mp.numeric_only(table(spark, sf, "orders"), keep=[]), dp=2)


# ---- the whole way ----------------------------------------------------------


@query("p01_engineer")
def _(spark, sf):
    """All features and all three ways to select; what every stage holds of each symbol."""
    return emit(stage_profile(engineer(bars_1h(spark, sf), now=NOW)), dp=4)


@query("p02_processors")
def _(spark, sf):
    """Steps are plain functions, chained with ``DataFrame.transform``."""
    return emit(dirty(spark, sf).transform(cl.consistent_types).transform(cl.repair_ohlc), "symbol", "seq", *OHLCV)


# ---- streaming --------------------------------------------------------------


def _stream(spark, sf) -> DataFrame:
    """The events table as a stream of ticks."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return _ticks(raw)


def _in_turn(parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream over a growing folder: each part is appended, then drained by a run of its own on one checkpoint.

    So the order of the parts comes from the runs, whatever the number and names of their files.
    """
    spark = parts[0].sparkSession
    path = f"{scratch_dir(spark)}/arriving-{datetime.now().timestamp()}"
    for part in parts:
        part.write.mode("append").parquet(path)
        out = _drain(stream(spark.readStream.schema(parts[0].schema).parquet(path)), at=path + "-out")
    return out


def _closing(spark, sf, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream over the events in two time ranges. The second brings a marker far ahead: the watermark moves when its rows have
    been taken, then passes every event, and all windows close. The marker's own window stays open."""
    events = table(spark, sf, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    middle = first + (last - first) / 2
    marker = spark.createDataFrame([(-1, last + timedelta(days=365), MARKER)], "event_id long, ts timestamp_ntz, event_type string")
    marker = marker.select(*[c(f.name) if f.name in marker.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
    ranges = [events.where(F.col("ts") < F.lit(middle)), events.where(F.col("ts") >= F.lit(middle)).unionByName(marker)]
    return _in_turn(ranges, lambda raw: stream(_ticks(raw)))


def _ticks(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id",
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        *[F.col("value").alias(n) for n in PRICES],
        F.get_json_object("props", "$.k").cast("long").alias("volume"),
    )


def _drain(df: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run a stream over what there is, into a table (``at``: one that earlier runs began)."""
    spark = df.sparkSession
    path = at or f"{scratch_dir(spark)}/stream-{datetime.now().timestamp()}"
    q = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", path + "-state")
        .trigger(availableNow=True)
        .start(path)
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _messages(ticks_: DataFrame) -> DataFrame:
    """Ticks as live messages; some of another kind, some broken."""
    payload = F.struct(
        c("symbol").alias("epic"),
        F.when(c("event_id") % 2 == 0, "MINUTE").otherwise("HOUR").alias("resolution"),
        F.lit("bid").alias("priceType"),
        F.unix_millis("ts").alias("t"),
        c("open").alias("o"),
        c("high").alias("h"),
        c("low").alias("l"),
        c("close").alias("c"),
    )
    body = F.to_json(F.struct(F.lit("ohlc.event").alias("destination"), payload.alias("payload")))
    value = (
        F.when(c("event_id") % 17 == 3, F.concat(F.lit("{broken "), c("event_id").cast("string")))
        .when(c("event_id") % 17 == 5, '{"destination":"ping","status":"OK"}')
        .otherwise(body)
    )
    return ticks_.select("event_id", value.alias("value"))


@query("r01_parse_events")
def _(spark, sf):
    out = _drain(live.parse_events(_messages(_stream(spark, sf))))
    return emit(out, "event_id", "kind", "symbol", "resolution", "price_type", "ts", *PRICES, "raw")


@query("r02_subscribe")
def _(spark, sf):
    bars = live.bars_only(live.parse_events(_messages(_stream(spark, sf))))
    out = _drain(live.subscribe(bars, ["click", "view"], ["HOUR"]))
    return emit(out, "event_id", "symbol", "resolution", "ts", *PRICES)


@query("r03_handler")
def _(spark, sf):
    """A handler that keeps every batch."""
    path = f"{scratch_dir(spark)}/handled-{datetime.now().timestamp()}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = _stream(spark, sf)
    live.handle(stream, keep, path + "-state", availableNow=True).awaitTermination()
    return emit(spark.read.parquet(path), "event_id", "symbol", "ts", "close")


@query("r04_first_updates")
def _(spark, sf):
    """Stamps cut to the hour: of many updates one remains."""
    bars = _stream(spark, sf).withColumns({"ts": F.date_trunc("hour", "ts"), "resolution": F.lit("HOUR")})
    return emit(_drain(live.first_updates(bars)), "symbol", "resolution", "ts")


@query("r04_newest_updates")
def _(spark, sf):
    hourly = lambda t: t.withColumns({"ts": F.date_trunc("hour", "ts"), "resolution": F.lit("HOUR")})
    out = _closing(spark, sf, lambda t: live.newest_updates(hourly(t), "event_id"))
    return emit(out, "symbol", "resolution", "ts", *PRICES, "n_updates")


@query("r05_tumbling")
def _(spark, sf):
    return emit(_closing(spark, sf, lambda t: live.resample(t, "1 hour")), "symbol", "ts", *OHLCV, "n_bars")


@query("r05_sliding")
def _(spark, sf):
    return emit(_closing(spark, sf, lambda t: live.resample(t, "4 hours", "1 hour")), "symbol", "ts", *OHLCV, "n_bars")


@query("r06_live_indicators")
def _(spark, sf):
    """Bars in three time ranges. Each brings some of its bars again, with older numbers and other prices, and bars of
    the ranges before, which are late."""
    ind.use_rocksdb(spark)
    bars = materialize(bars_1h(spark, sf).withColumn("arrived", F.lit(2)))
    first, last = bars.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    edges = [None, *cuts, None]
    wrong = lambda df: df.withColumns({n: c(n) * 3 for n in PRICES} | {"arrived": F.lit(1)})
    parts = []
    for a, b in zip(edges, edges[1:]):
        own = bars.where((F.col("ts") >= F.lit(a)) if a else F.lit(True)).where((F.col("ts") < F.lit(b)) if b else F.lit(True))
        part = own.unionByName(wrong(own.where(F.hour("ts") % 3 == 0)))
        if a:
            late = bars.where(F.col("ts") < F.lit(a) - F.expr("INTERVAL 1 DAY"))
            part = part.unionByName(wrong(late.where(F.hour("ts") == 5)).withColumn("arrived", F.lit(3)))
        parts.append(part)
    marker = bars.where(F.col("ts") == F.lit(last)).limit(1).withColumns({"ts": F.lit(last + timedelta(days=365)), "symbol": F.lit(MARKER)})
    parts[-1] = parts[-1].unionByName(marker)
    out = _in_turn(parts, lambda b: ind.live_indicators(b, "1 hour", arrived="arrived"))
    return emit(out, "symbol", "ts", "ema_12", "macd_line", "macd_signal", "atr", "rsi_14", "obv", "run_length")


@query("r07_sessions")
def _(spark, sf):
    return emit(_closing(spark, sf, lambda t: live.trading_sessions(t, "30 minutes")))


def _broken_stream(spark, sf) -> DataFrame:
    return _stream(spark, sf).withColumns(
        {
            "high": F.when(c("event_id") % 11 == 0, c("high") - 1).otherwise(c("high")),
            "low": F.when(c("event_id") % 13 == 0, c("low") + 1).otherwise(c("low")),
            "close": F.when(c("event_id") % 19 == 0, 0.0).otherwise(c("close")),
            "volume": F.when(c("event_id") % 23 == 0, -1).otherwise(c("volume")),
        }
    )


@query("r08_live_issues")
def _(spark, sf):
    out = _drain(live.live_issues(live.observed(_broken_stream(spark, sf))))
    return emit(out, "symbol", "ts", "code")


@query("r08_live_counts")
def _(spark, sf):
    """Rows and findings by code, as a listener hears of them with the progress of the stream."""
    counts = live.IssueCounts("bars")
    spark.streams.addListener(counts)
    try:
        path = f"{scratch_dir(spark)}/counted-{datetime.now().timestamp()}"
        found = live.live_issues(live.observed(_broken_stream(spark, sf)))
        q = found.writeStream.format("parquet").option("checkpointLocation", path + "-state").trigger(availableNow=True).start(path)
        q.awaitTermination()
        counts.wait(q)
    finally:
        spark.streams.removeListener(counts)
    return counts.table(spark).groupBy("code").agg(F.sum("n").alias("n"))


# ---- user functions, quantiles ----------------------------------------------


@query("u01_own_feature")
def _(spark, sf):
    from tidebars.plans.registry import REGISTRY, register_feature

    def spread(fr, have):
        yield {"hl_spread": fr.roll(F.max, "high", 3) - fr.roll(F.min, "low", 3)}

    register_feature("hl_spread", spread, back=2)
    out = generate(bars_1h(spark, sf), ["hl_spread"])
    REGISTRY.pop("hl_spread")
    return emit(out, "symbol", "ts", "hl_spread")


@query("u02_rolling_function")
def _(spark, sf):
    """The median absolute deviation of the last seven closes, which no built-in aggregate gives."""
    from tidebars.functions.rolling import rolling_apply

    def mad(windows):
        return np.median(np.abs(windows - np.median(windows, axis=1, keepdims=True)), axis=1)

    return emit(rolling_apply(bars_1h(spark, sf), "close", "mad_7", 7, mad), "symbol", "ts", "mad_7")


@query("u03_exact_quantiles")
def _(spark, sf):
    probs = {"q1": 0.25, "q2": 0.5, "q99": 0.99}
    return emit(quantiles(ticks(spark, sf), ["price", "size"], probs))
