"""Cleaning bars: fill, de-duplicate, align to a grid, cap outliers, repair.

Every step works on whichever of the bar columns exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.functions.columns import OHLCV, PRICES, c, join_small, present
from tidebars.operators.blocks import SERIES, running, with_position
from tidebars.operators.quantiles import quantiles
from tidebars.session import materialize
from tidebars.sources.files import lower_names

# Strings that mean "no value" (fixed values).
NULL_TOKENS = ["", "NA", "N/A", "null", "Null", "NULL", "None", "NaN"]
GRID_BLOCK = 65_536


def null_tokens(df: DataFrame) -> DataFrame:
    """Null tokens to NULL, bar columns to numbers; text that is no number is NULL too."""
    new = {}
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            value = F.when(~c(f.name).isin(NULL_TOKENS), c(f.name))
            new[f.name] = value.try_cast("double") if f.name in OHLCV else value
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            new[f.name] = F.when(~F.isnan(c(f.name)), c(f.name))
    return df.withColumns(new) if new else df


def parse_timestamps(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """``ts`` as UTC. Text with an offset keeps its instant; other stamps are in ``zone``."""
    kind = df.schema["ts"].dataType
    if isinstance(kind, T.TimestampType):
        return df
    ts = c("ts").try_cast("timestamp")
    if zone != "UTC":
        local = F.to_utc_timestamp(ts, zone)
        if isinstance(kind, T.StringType):
            has_offset = F.trim("ts").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
            ts = F.when(has_offset, ts).otherwise(local)
        else:
            ts = local
    return df.withColumn("ts", ts)


def _point(x: str) -> Column:
    return F.when(c(x).isNotNull(), F.struct(c(x).alias("v"), F.col("_i").alias("i")))


def interpolate(df: DataFrame, cols: list[str], by=SERIES, rows: int | None = None) -> DataFrame:
    """Straight lines by row position; later gaps keep the last value, leading ones stay."""
    cols = present(df, cols)
    marked = df.withColumns({f"_k_{n}": _point(n) for n in cols})
    specs = {}
    for n in cols:
        specs[f"_p_{n}"] = ("last", f"_k_{n}")
        specs[f"_f_{n}"] = ("next", f"_k_{n}")
    out = running(marked, specs, by, rows)

    def value(n):
        p, f = F.col(f"_p_{n}"), F.col(f"_f_{n}")
        between = p["v"] + (f["v"] - p["v"]) * (F.col("_i") - p["i"]) / F.nullif(
            f["i"] - p["i"], F.lit(0)
        )
        return F.coalesce(c(n), between, p["v"])

    return out.withColumns({n: value(n) for n in cols}).select(*[c(n) for n in df.columns])


def fill_missing(df: DataFrame, by=SERIES, rows: int | None = None) -> DataFrame:
    """Fill NULL bars in time order. ``df`` is positioned, or has ``ts`` (and ``seq``)."""
    if "_i" not in df.columns:
        # Without ``seq`` all columns order the copies of a stamp, so that the result does not depend on the shuffle.
        ties = ["seq"] if "seq" in df.columns else [n for n in df.columns if n not in (*by, "ts")]
        df = with_position(df, by, [*present(df, ["ts"]), *ties])
    order = df.columns
    cols = present(df, OHLCV)
    df = df.withColumns({n: c(n).cast("double") for n in cols})
    if "close" in cols:
        df = running(df, {"_c": ("last", "close"), "_pc": ("prior", "close")}, by, rows)
        if "open" in cols:
            df = df.withColumn("open", F.coalesce("open", "_pc"))
        df = df.withColumn("close", F.col("_c")).drop("_c", "_pc")
    if "open" in cols:
        df = interpolate(df, ["open"], by, rows)
    # Each running step reads its input twice; a table here keeps that from compounding.
    df = materialize(df)
    ends = [c(n) for n in present(df, ["open", "close"])]
    edges = {}
    for n, pick in (("high", F.greatest), ("low", F.least)):
        if n in cols and ends:
            edges[n] = F.coalesce(c(n), pick(*ends) if len(ends) > 1 else ends[0])
    if edges:
        df = df.withColumns(edges)
    if present(df, ["high", "low"]):
        df = interpolate(df, ["high", "low"], by, rows)
    if "volume" in cols:
        if "high" in cols and "low" in cols:
            still = F.col("volume").isNull() & (F.col("high") == F.col("low"))
            df = df.withColumn("volume", F.when(still, 0.0).otherwise(F.col("volume")))
        df = df.withColumn("_kv", _point("volume"))
        df = running(df, {"_p": ("last", "_kv"), "_f": ("next", "_kv")}, by, rows)
        p, f = F.col("_p"), F.col("_f")
        between = p["v"] + (f["v"] - p["v"]) * (F.col("_i") - p["i"]) / F.nullif(
            f["i"] - p["i"], F.lit(0)
        )
        # Before the first known volume the next one counts.
        volume = F.coalesce("volume", between, p["v"], f["v"], F.lit(0.0))
        df = df.withColumn("volume", volume)
    return df.select(*[c(n) for n in order])


def drop_duplicates(df: DataFrame, by=SERIES, first: str | None = None) -> DataFrame:
    """One row per series and stamp, the one with the smallest ``first`` column (NULL last).

    An aggregate, not a window: a stamp copied a billion times is reduced before the
    shuffle. Without a ``ts`` column only identical rows go.
    """
    if "ts" not in df.columns:
        return df.dropDuplicates()
    rest = [n for n in df.columns if n not in (*by, "ts")]
    # The order is never NULL, so copies without ``first`` keep their values; ties go by all columns.
    lead = [c(first).isNull().alias("_no"), c(first).alias("_first")] if first else []
    order = F.struct(*lead, *[c(n) for n in rest])
    kept = df.groupBy(*by, "ts").agg(F.min_by(F.struct(*[c(n) for n in rest]), order).alias("_r"))
    return kept.select(*by, "ts", "_r.*").select(*[c(n) for n in df.columns])


def bar_interval(df: DataFrame, by=SERIES, rows: int | None = None, copies: bool = True) -> DataFrame:
    """Per series: the commonest step (the smallest on ties), the largest, first and last stamp.

    ``df`` has ``_i`` in time order; it may have holes. Without ``copies`` steps of 0 do not count.
    """
    steps = running(df.select(*by, "ts", "_i"), {"_before": ("prior", "ts")}, by, rows)
    steps = steps.withColumn("_step", F.unix_micros("ts") - F.unix_micros("_before"))
    counts = steps.groupBy(*by, "_step").agg(
        F.count(F.lit(1)).alias("_c"), F.min("ts").alias("_first"), F.max("ts").alias("_last")
    )
    counts_ = F.col("_step").isNotNull() if copies else F.col("_step") > 0
    common = F.max_by("_step", F.when(counts_, F.struct("_c", -F.col("_step"))))
    return counts.groupBy(*by).agg(
        common.alias("interval_us"),
        F.max("_step").alias("largest_us"),
        F.min("_first").alias("first_ts"),
        F.max("_last").alias("last_ts"),
    )


def time_grid(spans: DataFrame, by=SERIES) -> DataFrame:
    """Regular stamps first..last for each series, with ``_i``.

    Built in two steps with a shuffle between, so that a long series is written out by
    many tasks and no array exceeds ``GRID_BLOCK`` stamps.
    """
    start, end = F.unix_micros("first_ts"), F.unix_micros("last_ts")
    n = F.floor((end - start) / F.col("interval_us")).cast("long") + 1
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (
        spans.select(*by, start.alias("_s"), "interval_us", n.alias("_n"))
        .withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / GRID_BLOCK))))
        .repartition(tasks, *by, "_g")
    )
    first = F.col("_g") * GRID_BLOCK
    last = F.least(first + GRID_BLOCK, F.col("_n")) - 1
    return pieces.withColumn("_i", F.explode(F.sequence(first, last))).select(
        *by, F.timestamp_micros(F.col("_s") + F.col("_i") * F.col("interval_us")).alias("ts"), "_i"
    )


def fill_gaps(
    df: DataFrame, by=SERIES, rows: int | None = None, factor: float = 1.5
) -> DataFrame:
    """Put series that have a step over ``factor`` intervals on a regular grid.

    Rows off the grid are dropped (``grid_report`` counts them), prices are carried forward, volume is 0
    in gaps. Series without such a gap stay as they are.
    """
    order = [n for n in df.columns if n not in ("_i", "_n")]
    # Positions with holes will do here: only their order counts.
    df = materialize(df) if "_i" in df.columns else with_position(df, by)
    df = df.drop("_n")
    info = materialize(_grids(df, by, rows, factor))
    marked = join_small(df, info.select(*by, "_gappy"), list(by))
    grid = time_grid(info.where("_gappy"), by)
    bars = marked.where("_gappy").drop("_gappy", "_i")
    on_grid = join_small(grid, bars, [*by, "ts"], "left")
    both = on_grid.unionByName(marked.where(~F.col("_gappy")).drop("_gappy"))
    both = materialize(both)
    prices = present(both, PRICES)
    filled = running(both, {f"_l_{n}": ("last", n) for n in prices}, by, rows)
    filled = filled.withColumns({n: F.col(f"_l_{n}") for n in prices})
    if "volume" in order:
        filled = filled.withColumn("volume", F.coalesce("volume", F.lit(0)))
    return filled.select(*[c(n) for n in order])


def _grids(df: DataFrame, by, rows: int | None, factor: float) -> DataFrame:
    return bar_interval(df, by, rows, copies=False).withColumn(
        "_gappy", F.coalesce(F.col("largest_us") > F.col("interval_us") * factor, F.lit(False))
    )


def grid_report(df: DataFrame, by=SERIES, rows: int | None = None, factor: float = 1.5) -> DataFrame:
    """Per series what ``fill_gaps`` does: the interval, rows there are, rows it drops because they lie off
    the grid, and stamps it adds."""
    df = materialize(df) if "_i" in df.columns else with_position(df, by)
    info = materialize(_grids(df, by, rows, factor))
    at = F.unix_micros("ts") - F.unix_micros("first_ts")
    marked = join_small(df, info, list(by)).withColumn("_on", at % F.col("interval_us") == 0)
    counts = marked.groupBy(*by).agg(
        F.first("interval_us").alias("interval_us"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_gappy") & ~F.col("_on")).alias("n_off_grid"),
        F.max(F.when(F.col("_gappy"), (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.col("interval_us"))).alias("_steps"),
    )
    held = marked.where(F.col("_gappy") & F.col("_on")).select(*by, "ts").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_held"))
    added = F.floor("_steps") + 1 - F.coalesce("_held", F.lit(0))
    out = join_small(counts, held, list(by), "left")
    return out.select(*by, "interval_us", "n_rows", "n_off_grid", F.coalesce(added, F.lit(0)).alias("n_added"))


def outlier_bounds(df: DataFrame, by=SERIES) -> DataFrame:
    """Per series: price bounds Q1-2*IQR and Q3+2*IQR, and the cap of positive volumes."""
    prices = present(df, PRICES)
    cols = list(prices)
    if "volume" in df.columns:
        df = df.withColumn("_pv", F.when(F.col("volume") > 0, F.col("volume").cast("double")))
        cols.append("_pv")
    q = quantiles(df.select(*by, *cols), cols, {"q1": 0.25, "q3": 0.75}, by)
    out = []
    for n in prices:
        q1, q3 = F.col(f"{n}_q1"), F.col(f"{n}_q3")
        out += [(q1 - 2 * (q3 - q1)).alias(f"{n}_low"), (q3 + 2 * (q3 - q1)).alias(f"{n}_high")]
    if "volume" not in df.columns:
        return q.select(*by, *out)
    logs = df.groupBy(*by).agg(
        F.avg(F.log1p("_pv")).alias("_m"), F.stddev_samp(F.log1p("_pv")).alias("_s")
    )
    spread = F.col("_pv_q3") + 3 * (F.col("_pv_q3") - F.col("_pv_q1"))
    cap = F.least(spread, F.expm1(F.col("_m") + 2.5 * F.col("_s"))).alias("volume_cap")
    return join_small(q, logs, list(by)).select(*by, *out, cap)


def cap_outliers(df: DataFrame, by=SERIES) -> DataFrame:
    """Winsorise prices; negative volumes to 0, large ones to the cap, as whole numbers.

    The bounds look at the whole series, later rows included.
    """
    bounds = outlier_bounds(df, by)
    order = df.columns
    out = join_small(df, bounds, list(by))
    new = {
        n: F.when(c(n).isNotNull(), F.least(F.greatest(c(n), c(f"{n}_low")), c(f"{n}_high")))
        for n in present(df, PRICES)
    }
    if "volume" in order:
        v = F.greatest(c("volume"), F.lit(0))
        capped = F.least(c("volume"), F.col("volume_cap")).cast("long")
        new["volume"] = F.when(c("volume") > 0, capped).when(c("volume").isNotNull(), v.cast("long"))
    return out.withColumns(new).select(*[c(n) for n in order])


def consistent_types(df: DataFrame) -> DataFrame:
    """Prices double; volume rounded half-even to a whole number."""
    new = {n: c(n).cast("double") for n in present(df, PRICES)}
    if "volume" in df.columns:
        new["volume"] = F.bround(c("volume").cast("double")).cast("long")
    return df.withColumns(new) if new else df


def ohlc_faults(df: DataFrame) -> dict[str, Column]:
    """Row conditions that break open/high/low/close order, for the columns there are."""
    have, out = set(df.columns), {}
    if {"high", "open", "close"} <= have:
        out["high_below"] = F.col("high") < F.greatest("open", "close")
    if {"low", "open", "close"} <= have:
        out["low_above"] = F.col("low") > F.least("open", "close")
    if "volume" in have:
        out["negative_volume"] = F.col("volume") < 0
    return out


def repair_ohlc(df: DataFrame) -> DataFrame:
    """High and low to contain open and close; volume at least 0."""
    if len(present(df, PRICES)) < 2:
        return df
    faults, new = ohlc_faults(df), {}
    if "high_below" in faults:
        new["high"] = F.greatest("high", "open", "close")
    if "low_above" in faults:
        new["low"] = F.least("low", "open", "close")
    if "volume" in df.columns:
        new["volume"] = F.when(F.col("volume") < 0, 0).otherwise(F.col("volume"))
    return df.withColumns(new) if new else df


def repair_counts(df: DataFrame, by=SERIES) -> DataFrame:
    """Per series: rows each repair touches, and broken rows that remain after it."""
    before = [F.count_if(cond).alias(n) for n, cond in ohlc_faults(df).items()]
    fixed = repair_ohlc(df)
    left = fixed.groupBy(*by).agg(
        F.count_if(
            (F.col("high") < F.greatest("low", "open", "close"))
            | (F.col("low") > F.least("open", "close"))
        ).alias("remaining")
    )
    return join_small(df.groupBy(*by).agg(*before), left, list(by))


def clean(
    df: DataFrame, by=SERIES, zone: str = "UTC", first: str | None = None, rows: int | None = None
) -> DataFrame:
    """All cleaning steps in order. Rows without a readable stamp have no place in a
    series and are left out; ``validate.unreadable_timestamps`` lists them."""
    df = lower_names(df)
    if "date" in df.columns and "ts" not in df.columns:
        df = df.withColumnRenamed("date", "ts")
    df = parse_timestamps(null_tokens(df), zone).where(F.col("ts").isNotNull())
    if first and first != "seq":
        df = df.withColumnRenamed(first, "seq")
    df = fill_missing(df, by, rows)
    # The fill order breaks ties between copies, so the earliest copy stays.
    df = drop_duplicates(df.drop("_n", "seq"), by, "_i")
    df = fill_gaps(df, by, rows)
    return repair_ohlc(consistent_types(cap_outliers(df, by)))
