"""Which chunks of a time range are planned, and which of them hold bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.sources.ticks import RESOLUTION_MINUTES

MAX_POINTS = 900


def chunk_plan(ranges: DataFrame, resolution: str, max_points: int = MAX_POINTS) -> DataFrame:
    """Chunks of at most ``max_points`` bars: ``symbol, from_ts, to_ts`` to one row per chunk.

    A symbol may have several ranges; chunks are numbered within each.
    """
    step = RESOLUTION_MINUTES[resolution] * 60 * max_points
    start, end = F.unix_micros("from_ts"), F.unix_micros("to_ts")
    micros = F.lit(step * 1_000_000)
    return (
        ranges.where(F.col("from_ts") < F.col("to_ts"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((end - start - 1) / micros))))
        .select(
            "symbol",
            "from_ts",
            "chunk",
            F.timestamp_micros(start + F.col("chunk") * micros).alias("chunk_start"),
            F.timestamp_micros(F.least(start + (F.col("chunk") + 1) * micros, end)).alias("chunk_end"),
        )
    )


def coverage(
    bars: DataFrame, ranges: DataFrame, resolution: str, max_points: int = MAX_POINTS
) -> DataFrame:
    """Planned chunks with bar count, first and last stamp, and whether any bar came.

    Time is cut into bins as long as a chunk, so a chunk touches two bins at most. Bars meet the chunks of
    their own bin by an equi-join: however many ranges a symbol has, a bar is paired with those chunks only that
    hold it or border on its bin.
    """
    step = RESOLUTION_MINUTES[resolution] * 60 * max_points * 1_000_000
    plan = chunk_plan(ranges, resolution, max_points)
    keys = ["symbol", "from_ts", "chunk", "chunk_start", "chunk_end"]
    bin_of = lambda micros: F.floor(micros / F.lit(step))
    first, last = bin_of(F.unix_micros("chunk_start")), bin_of(F.unix_micros("chunk_end") - 1)
    binned = plan.distinct().withColumn("_bin", F.explode(F.sequence(first, last)))
    held = (
        bars.select("symbol", "ts", bin_of(F.unix_micros("ts")).alias("_bin"))
        .join(binned, ["symbol", "_bin"])
        .where((F.col("ts") >= F.col("chunk_start")) & (F.col("ts") < F.col("chunk_end")))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    return plan.join(held, keys, "left").select(
        "symbol",
        "from_ts",
        "chunk",
        "chunk_start",
        "chunk_end",
        F.coalesce("n", F.lit(0)).alias("n_points"),
        "first_ts",
        "last_ts",
        F.col("n").isNotNull().alias("ok"),
    )


def coverage_summary(cover: DataFrame) -> DataFrame:
    """Per symbol: chunks that came and that failed, points, first and last stamp."""
    return cover.groupBy("symbol").agg(
        F.count_if("ok").alias("successful_chunks"),
        F.count_if(~F.col("ok")).alias("failed_chunks"),
        F.sum("n_points").alias("total_points"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
