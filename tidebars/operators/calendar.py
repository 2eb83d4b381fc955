"""Clock and calendar features, and the US holiday calendar as rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.columns import join_small

TAU = 2 * math.pi


def _cycle(name: str, share: Column) -> dict[str, Column]:
    return {f"{name}_sin": F.sin(TAU * share), f"{name}_cos": F.cos(TAU * share)}


def time_of_day(df: DataFrame) -> DataFrame:
    hour = F.hour("ts")
    session = (
        F.when(hour <= 6, "asian_session").when(hour <= 14, "european_session").otherwise("us_session")
    )
    return df.withColumns({**_cycle("hour", hour / 24), "session": F.when(hour.isNotNull(), session)})


def day_of_week(df: DataFrame) -> DataFrame:
    return df.withColumns(_cycle("day_of_week", F.weekday("ts") / 7))


def time_of_week(df: DataFrame) -> DataFrame:
    hour_of_week = F.weekday("ts") * 24 + F.hour("ts")
    return df.withColumns(
        {**_cycle("hour_of_week", hour_of_week / 168), "is_weekend": (F.weekday("ts") >= 5).cast("int")}
    )


def time_of_month(df: DataFrame) -> DataFrame:
    share = F.day("ts") / F.day(F.last_day("ts"))
    third = (
        F.when(share <= 0.33, "start_of_month").when(share <= 0.66, "mid_month").otherwise("end_of_month")
    )
    return df.withColumns(
        {
            **_cycle("month_progress", share),
            "month_period": F.when(share.isNotNull(), third),
            **_cycle("month_of_year", F.month("ts") / 12),
        }
    )


def is_us_holiday(d: Column) -> Column:
    """US federal holidays on their day, and on the weekday that observes them."""
    year, month, day, wday = F.year(d), F.month(d), F.day(d), F.weekday(d)

    def fixed(m: int, n: int, since: int = 0) -> Column:
        on = (month == m) & (day == n)
        eve, morrow = F.date_add(d, 1), F.date_sub(d, 1)
        friday = (wday == 4) & (F.month(eve) == m) & (F.day(eve) == n)
        monday = (wday == 0) & (F.month(morrow) == m) & (F.day(morrow) == n)
        return (on | friday | monday) & (year >= since)

    def nth(m: int, weekday: int, n: int, since: int = 0) -> Column:
        return (month == m) & (wday == weekday) & (F.ceil(day / 7) == n) & (year >= since)

    last_monday_of_may = (month == 5) & (wday == 0) & (day > 24)
    return (
        fixed(1, 1)
        | nth(1, 0, 3, 1986)
        | nth(2, 0, 3, 1971)
        | last_monday_of_may
        | fixed(6, 19, 2021)
        | fixed(7, 4)
        | nth(9, 0, 1)
        | nth(10, 0, 2)
        | fixed(11, 11)
        | nth(11, 3, 4)
        | fixed(12, 25)
    )


def holiday_calendar(days: DataFrame) -> DataFrame:
    """For a table of dates ``_day``: whether it is a holiday, and the days to the next one within 29, else 0."""
    day = F.col("_day")
    ahead = F.filter(F.sequence(F.lit(1), F.lit(29)), lambda k: is_us_holiday(F.date_add(day, k)))
    return days.select(
        "_day",
        is_us_holiday(day).cast("int").alias("is_holiday"),
        F.coalesce(F.array_min(ahead), F.lit(0)).alias("days_to_next_holiday"),
    )


def holiday_features(df: DataFrame) -> DataFrame:
    """Holiday flag, and days to the next holiday within 29 days, else 0; 0 for rows without a stamp.

    The rules are looked up for the distinct dates of the table, whatever their years. ``df`` is read
    twice, so pass a table or a cheap plan.
    """
    dated = df.withColumn("_day", F.to_date("ts"))
    cal = holiday_calendar(dated.select("_day").where(F.col("_day").isNotNull()).distinct())
    out = join_small(dated, cal, ["_day"], "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("is_holiday", "days_to_next_holiday")}).drop("_day")
