"""Validation: a table of issues, the rows behind them, and a verdict per series."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.columns import PRICES, c, join_small, present, tdiv
from tidebars.operators.blocks import SERIES, Frames, own_rows, with_halo, with_position
from tidebars.operators.clean import NULL_TOKENS, bar_interval, ohlc_faults

MIN_ROWS = 30
MAX_MOVE = 0.50
GAP_FACTOR = 3

# Issue code -> type and description (fixed texts).
ISSUES = {
    "high_below": ("OHLC Relationship", "Found %d records where high < max(open, close)"),
    "low_above": ("OHLC Relationship", "Found %d records where low > min(open, close)"),
    "open_price": ("Invalid Prices", "Found %d records with open <= 0"),
    "high_price": ("Invalid Prices", "Found %d records with high <= 0"),
    "low_price": ("Invalid Prices", "Found %d records with low <= 0"),
    "close_price": ("Invalid Prices", "Found %d records with close <= 0"),
    "duplicate": ("Duplicate Timestamps", "Found %d duplicate timestamps"),
    "gap": ("Time Series Gaps", "Found %d large gaps in time series"),
    "future": ("Future Timestamps", "Found %d records with future timestamps"),
    "negative_volume": ("Invalid Volume", "Found %d records with negative volume"),
    "high_volume": ("Suspicious Volume", "Found %d records with extremely high volume"),
    "move": ("Extreme Price Movement", "Found %d records with >50%% price moves"),
    "missing_columns": ("Missing Required Columns", "Missing columns: "),
    "few_rows": ("Insufficient Data", "Only %d data points available, minimum 30 required"),
}


def stateless_conditions(df: DataFrame) -> dict[str, Column]:
    checks = {}
    if len(present(df, PRICES)) >= 2:
        faults = ohlc_faults(df)
        checks |= {k: faults[k] for k in ("high_below", "low_above") if k in faults}
        checks |= {f"{n}_price": c(n) <= 0 for n in present(df, PRICES)}
    if "volume" in df.columns:
        checks["negative_volume"] = F.col("volume") < 0
    return checks


def _instant(now: datetime) -> Column:
    """A moment; without a zone it is UTC, whatever the zone of the driver's host."""
    return F.lit(now if now.tzinfo else now.replace(tzinfo=timezone.utc))


def stateless_issues(df: DataFrame, now: datetime | None = None, by=SERIES) -> DataFrame:
    """The checks that need one row only, one output row per finding. Works on a stream."""
    checks = stateless_conditions(df)
    if now is not None:
        checks["future"] = F.col("ts") > _instant(now)
    return _explode(df, checks, by=by)


def _explode(df: DataFrame, checks: dict[str, Column], detail: Column | None = None, by=SERIES) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in checks.items()]))
    keep = [n for n in df.columns if n in (*by, "ts")]
    if detail is None:
        detail = F.lit(None).cast("string")
    found = df.select(*keep, detail.alias("_gap"), F.explode(codes).alias("code"))
    return found.select(
        *keep, "code", F.when(F.col("code") == "gap", F.col("_gap")).alias("detail")
    )


def affected_rows(
    df: DataFrame, now: datetime | None = None, by=SERIES, rows: int | None = None
) -> DataFrame:
    """One row per bar and issue: ``symbol, ts, code, detail``.

    Bars stay one row each, however many a series has; nothing is gathered into lists.
    All checks share one pass over the blocks.
    """
    df = with_position(df, by)
    checks = stateless_conditions(df)
    fr = Frames(tuple(by))
    new = {"_step": F.unix_micros("ts") - fr.lag(F.unix_micros("ts"))}
    if "close" in df.columns:
        new["_move"] = F.abs(tdiv("close", fr.lag("close")) - 1)
        checks["move"] = F.col("_move") > MAX_MOVE
    steps = own_rows(with_halo(df, 1, 0, rows).withColumns(new), 1, 0, rows)
    stats = bar_interval(df, by, rows).select(*by, "interval_us")
    if "volume" in df.columns:
        log_v = F.when(F.col("volume") > 0, F.log1p("volume"))
        volumes = df.groupBy(*by).agg(
            (F.avg(log_v) + 6 * F.stddev_samp(log_v)).alias("_limit")
        )
        stats = join_small(stats, volumes, list(by))
        checks["high_volume"] = (F.col("volume") > 0) & (F.log1p("volume") > F.col("_limit"))
    checks["duplicate"] = F.col("_step") == 0
    checks["gap"] = F.col("_step") > GAP_FACTOR * F.col("interval_us")
    if now is not None:
        checks["future"] = F.col("ts") > _instant(now)
    full = join_small(steps, stats, list(by))
    return _explode(full, checks, (F.col("_step") / 1e6).cast("string"), by)


def with_texts(counts: DataFrame) -> DataFrame:
    """Issue type and description for the codes of a count table."""
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for code, (k, t) in ISSUES.items():
        hit = F.col("code") == code
        kind = F.when(hit, k).otherwise(kind)
        said = F.format_string(t, F.col("n_rows")) if "%d" in t else F.concat(F.lit(t), "detail")
        text = F.when(hit, said).otherwise(text)
    return counts.withColumns({"issue_type": kind, "description": text})


def issues(
    df: DataFrame, now: datetime | None = None, by=SERIES, rows: int | None = None
) -> DataFrame:
    """The report: ``symbol, code, issue_type, description, n_rows, first_ts, last_ts``."""
    missing = [n for n in PRICES if n not in df.columns]
    df = with_position(df, by)
    found = affected_rows(df, now, by, rows)
    counts = found.groupBy(*by, "code").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).withColumn("detail", F.lit(None).cast("string"))
    sizes = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    few = sizes.where(F.col("n_rows") < MIN_ROWS).withColumns(
        {"code": F.lit("few_rows"), "detail": F.lit(None).cast("string")}
    )
    report = counts.unionByName(few)
    if missing:
        lacking = {"code": F.lit("missing_columns"), "detail": F.lit(", ".join(missing))}
        report = report.unionByName(sizes.withColumns(lacking))
    return with_texts(report).select(
        *by, "code", "issue_type", "description", "n_rows", "first_ts", "last_ts"
    )


def verdict(df: DataFrame, report: DataFrame, by=SERIES) -> DataFrame:
    """``symbol, is_valid, n_issues`` for every series of the table."""
    per = report.groupBy(*by).agg(F.count(F.lit(1)).alias("n_issues"))
    every = df.select(*by).distinct()
    out = join_small(every, per, list(by), "left")
    return out.select(
        *by,
        F.col("n_issues").isNull().alias("is_valid"),
        F.coalesce("n_issues", F.lit(0)).alias("n_issues"),
    )


def unreadable_timestamps(raw: DataFrame, col: str = "ts", by=SERIES) -> DataFrame:
    """Rows whose stamp has text that is no timestamp."""
    text = c(col).cast("string")
    bad = text.try_cast("timestamp").isNull() & text.isNotNull() & ~text.isin(NULL_TOKENS)
    return raw.where(bad)
