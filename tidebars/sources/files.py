"""Reading bars from files, writing the feature table, and naming data sets."""

from __future__ import annotations

import os
import re
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.columns import OHLCV

# Date formats accepted for a range (fixed values).
DATE_FORMATS = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%Y-%m-%dT%H:%M:%S"]


def lower_names(df: DataFrame) -> DataFrame:
    """Column names in lower case."""
    return df.toDF(*[n.lower() for n in df.columns])


def read_bars(spark: SparkSession, source: str | DataFrame, symbol: str | None = None) -> DataFrame:
    """Bars as strings from CSV with a header, from Parquet, or a frame as it is.

    The price columns of a CSV stay strings until cleaning has turned null tokens into
    NULL. Without a symbol column, ``symbol`` or else the file name tells them apart.
    """
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, str) and source.lower().rstrip("/").endswith((".csv", ".csv.gz")):
        df = spark.read.option("header", True).csv(source)
    elif isinstance(source, str) and source.lower().rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(source)
    elif isinstance(source, str):
        raise ValueError(f"not a .csv or .parquet path: {source}")
    else:
        raise ValueError(f"expected a path or a DataFrame, not {type(source).__name__}")
    df = lower_names(df)
    if "symbol" not in df.columns:
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        from_name = F.regexp_extract(name, r"^(?:raw|processed)_(.+?)_[0-9a-z]+_\d{8}_\d{8}", 1)
        named = F.lit(symbol) if symbol else F.when(from_name != "", from_name).otherwise(name)
        df = df.withColumn("symbol", named)
    if "date" in df.columns and "ts" not in df.columns:
        df = df.withColumnRenamed("date", "ts")
    return df


def _as_date(value: str | date | datetime) -> date:
    if not isinstance(value, str):
        return value
    for fmt in DATE_FORMATS:
        try:
            return datetime.strptime(value, fmt)
        except ValueError:
            pass
    raise ValueError(f"cannot read the date {value!r}")


def dataset_name(
    symbol: str,
    timeframe: str,
    start,
    end,
    raw: bool = True,
    source: str | None = None,
    info: str | None = None,
    ext: str = "parquet",
) -> str:
    """``raw|processed[_info]_SYMBOL_timeframe_YYYYMMDD_YYYYMMDD[_source].ext``."""

    def safe(s):
        return re.sub(r"\W", "_", s)

    frame = timeframe.lower()
    for word, short in (("minute", "m"), ("hour", "h"), ("day", "d"), ("_", "")):
        frame = frame.replace(word, short)
    stage = "raw" if raw else "processed" + (f"_{safe(info)}" if info else "")
    parts = [stage, safe(symbol), frame, f"{_as_date(start):%Y%m%d}", f"{_as_date(end):%Y%m%d}"]
    if source:
        parts.append(safe(source))
    return "_".join(parts) + f".{ext}"


def dataset_names(bars: DataFrame, timeframe: str, raw: bool = True, ext: str = "parquet") -> DataFrame:
    """The standard name of every symbol's data set, from the time range it covers."""
    frame = dataset_name("S", timeframe, "2000-01-01", "2000-01-01").split("_")[2]
    span = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return span.select(
        "symbol",
        "first_ts",
        "last_ts",
        F.concat_ws(
            "_",
            F.lit("raw" if raw else "processed"),
            F.regexp_replace("symbol", r"\W", "_"),
            F.lit(frame),
            F.date_format("first_ts", "yyyyMMdd"),
            F.concat(F.date_format("last_ts", "yyyyMMdd"), F.lit(f".{ext}")),
        ).alias("dataset"),
    )


def processed_path(path: str) -> str:
    """Sibling ``processed/`` folder, with ``raw`` in the name replaced."""
    folder, name = os.path.split(path)
    name = name.replace("raw", "processed") if "raw" in name else f"processed_{name}"
    return os.path.join(os.path.dirname(folder), "processed", name)


def write_bars(
    df: DataFrame, path: str, fmt: str = "parquet", with_date: bool = True, mode: str = "overwrite", by=("symbol",)
) -> str:
    """Write a feature table partitioned by series and day, so later reads prune both.

    Rows are spread by ranges of series and stamp, so every task writes about as much however large one
    series or day is, and few files to each folder.
    """
    parts = list(by)
    if with_date:
        df = df.withColumn("date", F.to_date("ts"))
        parts.append("date")
    (
        df.repartitionByRange(*parts, "ts")
        .write.mode(mode)
        .option("header", True)
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy(*parts)
        .format(fmt)
        .save(path)
    )
    return path


def feature_list(df: DataFrame, base: list[str] | None = None) -> list[str]:
    """Columns that are not part of the bar itself."""
    base = base or ["symbol", "date", "ts", *OHLCV]
    return [n for n in df.columns if n not in base]
