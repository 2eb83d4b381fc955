"""Live bars on Structured Streaming: parse, filter, de-duplicate, resample, sessions."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidebars.functions.columns import c
from tidebars.operators.blocks import SERIES
from tidebars.operators.validate import stateless_conditions, stateless_issues

LIVE_EVENT = (
    "destination string, status string, payload struct<epic:string,resolution:string,type:string,"
    "priceType:string,t:bigint,o:double,h:double,l:double,c:double>"
)
BAR_DESTINATION = "ohlc.event"


def parse_events(lines: DataFrame, body: str = "value") -> DataFrame:
    """Live messages to ``kind, symbol, resolution, price_type, ts, open, high, low, close``.

    ``kind`` is ``bar``, ``other`` for messages of another destination, or ``malformed``
    with the text kept in ``raw``.
    """
    j = F.from_json(c(body), LIVE_EVENT)
    df = lines.withColumn("_j", j)
    p = F.col("_j.payload")
    whole = (
        p["epic"].isNotNull() & p["t"].isNotNull() & p["o"].isNotNull() & p["h"].isNotNull()
        & p["l"].isNotNull() & p["c"].isNotNull()
    )
    destination = F.col("_j.destination")
    kind = (
        F.when(destination.isNull(), "malformed")
        .when(destination != BAR_DESTINATION, "other")
        .when(whole, "bar")
        .otherwise("malformed")
    )
    return df.withColumn("kind", kind).select(
        *[c(n) for n in lines.columns if n != body],
        "kind",
        p["epic"].alias("symbol"),
        p["resolution"].alias("resolution"),
        p["priceType"].alias("price_type"),
        F.timestamp_millis(p["t"]).alias("ts"),
        p["o"].alias("open"),
        p["h"].alias("high"),
        p["l"].alias("low"),
        p["c"].alias("close"),
        F.when(F.col("kind") != "bar", c(body)).alias("raw"),
    )


def bars_only(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") == "bar").drop("kind", "raw")


def side_output(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") != "bar").select("kind", "raw")


def subscribe(bars: DataFrame, symbols: list[str], resolutions: list[str]) -> DataFrame:
    """Only the instruments and resolutions asked for."""
    return bars.where(F.col("symbol").isin(symbols) & F.col("resolution").isin(resolutions))


def handle(bars: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Run a handler of your own on every micro-batch."""
    writer = bars.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def first_updates(bars: DataFrame, late: str = "10 minutes", by=SERIES) -> DataFrame:
    """One row per series, resolution and stamp; repeats within the lateness are dropped."""
    return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark([*by, "resolution", "ts"])


def newest_updates(bars: DataFrame, arrived: str, late: str = "10 minutes", by=SERIES) -> DataFrame:
    """The update that arrived last for each series, resolution and stamp."""
    df = bars.withWatermark("ts", late) if bars.isStreaming else bars
    rest = ["open", "high", "low", "close"]
    # A window of one millisecond, the resolution of live messages, keeps the stamp an event-time column.
    return (
        df.groupBy(*by, "resolution", F.window("ts", "1 millisecond").alias("_w"))
        .agg(F.max_by(F.struct(*rest), c(arrived)).alias("_b"), F.count(F.lit(1)).alias("n_updates"))
        .select(*by, "resolution", F.col("_w.start").alias("ts"), "_b.*", "n_updates")
    )


def resample(
    bars: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", by=SERIES
) -> DataFrame:
    """Coarser bars over tumbling or sliding windows; late rows are dropped by the watermark."""
    df = bars.withWatermark("ts", late) if bars.isStreaming else bars
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    volume = [F.sum("volume").alias("volume")] if "volume" in bars.columns else []
    return (
        df.groupBy(*by, span.alias("_w"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            *volume,
            F.count(F.lit(1)).alias("n_bars"),
        )
        .select(
            *by,
            F.col("_w.start").alias("ts"),
            "open",
            "high",
            "low",
            "close",
            *["volume"][: len(volume)],
            "n_bars",
        )
    )


def trading_sessions(bars: DataFrame, gap: str, late: str = "10 minutes", by=SERIES) -> DataFrame:
    """Runs of bars without a pause of ``gap``."""
    df = bars.withWatermark("ts", late) if bars.isStreaming else bars
    return (
        df.groupBy(*by, F.session_window("ts", gap).alias("_s"))
        .agg(
            F.count(F.lit(1)).alias("n_bars"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
        )
        .select(*by, "first_ts", "last_ts", "n_bars", "high", "low")
    )


def live_issues(bars: DataFrame) -> DataFrame:
    """Row checks on a stream: ``symbol, ts, code, detail``."""
    return stateless_issues(bars)


def observed(bars: DataFrame, name: str = "bars") -> DataFrame:
    """Count the rows of every micro-batch and, by code, its findings of ``live_issues``; an ``IssueCounts``
    listener collects the counts."""
    found = [F.count_if(F.coalesce(broken, F.lit(False))).alias(code) for code, broken in stateless_conditions(bars).items()]
    return bars.observe(name, F.count(F.lit(1)).alias("n_bars"), *found)


class IssueCounts(StreamingQueryListener):
    """Counts of ``observed`` streams, batch by batch: what each query reports with its progress."""

    def __init__(self, name: str = "bars"):
        self.name, self.rows, self.ended = name, [], {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        metrics = progress.observedMetrics.get(self.name)
        if metrics is not None:
            self.rows += [(str(progress.runId), progress.batchId, code, int(n)) for code, n in metrics.asDict().items()]

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query, seconds: float = 60) -> None:
        """Until the listener has heard all of a query that has ended: events reach it later than the query's end."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError("the query's end has not been reported")

    def table(self, spark) -> DataFrame:
        """``run, batch, code, n``: a few rows for each micro-batch."""
        return spark.createDataFrame(self.rows, "run string, batch long, code string, n long")
