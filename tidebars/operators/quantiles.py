"""Exact quantiles per group that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.columns import c, join_small
from tidebars.operators.blocks import SERIES, running, with_position


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: dict[str, float],
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Linearly interpolated quantiles: one row per series, columns ``{col}_{name}``.

    Equal values are counted before the shuffle, the distinct values are put in order
    by a range shuffle, and the running count picks the ranks that are asked for.
    """
    by = list(by)
    keys = [*by, "_col"]
    values = (
        df.select(
            *by,
            F.explode(
                F.array(*[F.struct(F.lit(n).alias("k"), c(n).cast("double").alias("v")) for n in cols])
            ).alias("_kv"),
        )
        .select(*by, F.col("_kv.k").alias("_col"), F.col("_kv.v").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    placed = with_position(values, keys, ["_v"])
    ranked = running(placed, {"_upto": ("sum", "_cnt")}, keys)
    totals = placed.groupBy(*keys).agg(F.sum("_cnt").alias("_total"))
    asked = F.array(
        *[F.struct(F.lit(n).alias("name"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("at"))
          for n, p in probs.items()]
    )
    # Rows whose ranks [upto-cnt, upto) cover the floor or the ceiling of an asked place.
    near = F.filter(
        asked,
        lambda q: (F.floor(q["at"]) < F.col("_upto"))
        & (F.ceil(q["at"]) >= F.col("_upto") - F.col("_cnt")),
    )
    hits = join_small(ranked, totals, keys).withColumn("_q", F.explode(near))
    at, first = F.col("_q.at"), F.col("_upto") - F.col("_cnt")
    low = F.when((F.floor(at) >= first) & (F.floor(at) < F.col("_upto")), F.col("_v"))
    high = F.when((F.ceil(at) >= first) & (F.ceil(at) < F.col("_upto")), F.col("_v"))
    each = hits.groupBy(*keys, F.col("_q.name").alias("_name")).agg(
        F.max(low).alias("_lo"), F.max(high).alias("_hi"), F.max(at - F.floor(at)).alias("_f")
    )
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    return each.groupBy(*by).agg(
        *[
            F.max(F.when((F.col("_col") == n) & (F.col("_name") == p), value)).alias(f"{n}_{p}")
            for n in cols
            for p in probs
        ]
    )
