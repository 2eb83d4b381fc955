"""Vendor JSON to bars and account tables.

Each function takes a frame with one JSON document per row (``spark.read.text`` with
``wholetext``, or a column that already holds the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.columns import c

PRICE_DECIMALS = 5
_QUOTE = "struct<bid:decimal(20,8),ask:decimal(20,8)>"
BROKER_PRICES = (
    "struct<errorCode:string,instrument:string,resolution:string,`from`:string,`to`:string,"
    f"prices:array<struct<snapshotTimeUTC:string,openPrice:{_QUOTE},highPrice:{_QUOTE},"
    f"lowPrice:{_QUOTE},closePrice:{_QUOTE},lastTradedVolume:bigint>>>"
)
ACCOUNTS = "struct<accounts:array<struct<accountId:string,accountName:string,balance:struct<available:double>>>>"
POSITIONS = "struct<positions:array<struct<position:struct<dealId:string>>>>"


def land_responses(spark: SparkSession, path: str, out: str, checkpoint: str | None = None, keys: str = "") -> DataFrame:
    """Land whole response files in a bronze table, each exactly once: its name, size and time, the body, and the
    request's metadata.

    A file stream remembers in ``checkpoint`` (``out`` with ``-state`` by default) which files it has taken; a run takes what
    has come since the last one. ``keys`` declares columns that folder names hold, as ``symbol string``. Returns the table.
    """
    schema = f"value string{', ' if keys else ''}{keys}"
    files = spark.readStream.schema(schema).option("wholetext", True).format("text").load(path)
    about = [F.col(f"_metadata.{n}").alias(n) for n in ("file_path", "file_size", "file_modification_time")]
    names = [n for n in files.columns if n != "value"]
    landed = with_metadata(files.select(*names, *about, F.col("value").alias("body")))
    q = landed.writeStream.format("parquet").option("checkpointLocation", checkpoint or f"{out}-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(landed.schema).parquet(out)


def with_metadata(responses: DataFrame, body: str = "body") -> DataFrame:
    """Request metadata of broker responses: instrument, resolution, range, points, outcome."""
    j = F.from_json(c(body), BROKER_PRICES)
    return (
        responses.withColumn("_j", j)
        .withColumns(
            {
                "instrument": F.col("_j.instrument"),
                "resolution": F.col("_j.resolution"),
                "from_ts": F.col("_j.`from`").try_cast("timestamp"),
                "to_ts": F.col("_j.`to`").try_cast("timestamp"),
                "n_points": F.coalesce(F.size("_j.prices"), F.lit(0)),
                "error_code": F.col("_j.errorCode"),
                "ok": F.coalesce(F.size("_j.prices") > 0, F.lit(False)),
            }
        )
        .drop("_j")
    )


def mid(quote: Column) -> Column:
    """Decimal mid price, half-even at five places."""
    return F.bround((quote["bid"] + quote["ask"]) / 2, PRICE_DECIMALS).cast("double")


def broker_bars(responses: DataFrame, symbol: str | Column, body: str = "body") -> DataFrame:
    """Broker price responses to bars; overlapping chunks keep one row per stamp."""
    one = (
        responses.select(c(symbol).alias("symbol"), F.from_json(c(body), BROKER_PRICES).alias("_j"))
        .select("symbol", F.explode("_j.prices").alias("p"))
        .select(
            "symbol",
            F.col("p.snapshotTimeUTC").try_cast("timestamp").alias("ts"),
            mid(F.col("p.openPrice")).alias("open"),
            mid(F.col("p.highPrice")).alias("high"),
            mid(F.col("p.lowPrice")).alias("low"),
            mid(F.col("p.closePrice")).alias("close"),
            F.col("p.lastTradedVolume").alias("volume"),
        )
    )
    return one


def equity_bars(responses: DataFrame, symbol: str | Column, body: str = "body") -> DataFrame:
    """Time-series responses with a dynamic key and string numbers; missing fields are 0."""
    series = F.from_json(c(body), "map<string,string>")
    entry = F.filter(F.map_entries(series), lambda e: e["key"].startswith("Time Series"))
    rows = F.from_json(F.get(entry, F.lit(0))["value"], "map<string,map<string,string>>")
    fields = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close"}
    bars = responses.select(c(symbol).alias("symbol"), F.explode(rows).alias("t", "f"))

    def number(key: str, kind: str) -> Column:
        # try_element_at: a missing field is NULL also under ANSI mode.
        return F.coalesce(F.try_element_at("f", F.lit(key)).try_cast(kind), F.lit(0).cast(kind))

    return bars.select(
        "symbol",
        F.col("t").try_cast("timestamp").alias("ts"),
        *[number(k, "double").alias(n) for n, k in fields.items()],
        number("5. volume", "long").alias("volume"),
    )


def concat_chunks(*chunks: DataFrame) -> DataFrame:
    """All chunks of one series; a stamp two chunks share keeps the earlier chunk's row."""
    every = None
    for n, chunk in enumerate(chunks):
        chunk = chunk.withColumn("_chunk", F.lit(n))
        every = chunk if every is None else every.unionByName(chunk)
    keep = [n for n in every.columns if n not in ("symbol", "ts", "_chunk")]
    row = F.min_by(F.struct(*keep), F.struct("_chunk", *keep))
    return every.groupBy("symbol", "ts").agg(row.alias("r")).select("symbol", "ts", "r.*")


def accounts(responses: DataFrame, body: str = "body") -> DataFrame:
    """Account rows: id, name, available balance."""
    return (
        responses.select(F.explode(F.from_json(c(body), ACCOUNTS)["accounts"]).alias("a"))
        .select(
            F.col("a.accountId").alias("account_id"),
            F.col("a.accountName").alias("account_name"),
            F.col("a.balance.available").alias("available"),
        )
    )


def account_by_name(responses: DataFrame, name: str, body: str = "body") -> DataFrame:
    """Id and balance of the named account; no row when there is none."""
    return accounts(responses, body).where(F.col("account_name") == name)


def deals(responses: DataFrame, body: str = "body") -> DataFrame:
    """Deal ids of open positions; entries without one are skipped."""
    deal = F.explode(F.from_json(c(body), POSITIONS)["positions"])
    out = responses.withColumn("_p", deal).withColumn("deal_id", F.col("_p.position.dealId"))
    return out.where(F.col("deal_id").isNotNull()).drop("_p", body)


def json_key(key: str, body: str = "body") -> Column:
    """One top-level key of a JSON document, as text."""
    return F.get_json_object(c(body), f"$.{key}")
