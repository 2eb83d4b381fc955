"""Time order at scale: row positions, bounded blocks, halos and running values.

A window over a whole symbol is one task. No operator here does that; instead

* ``with_position`` numbers the rows of every symbol by a range shuffle, which
  spreads a hot symbol over many tasks,
* ``with_halo`` cuts each symbol into blocks of at most ``rows`` rows and copies
  the few neighbouring rows a bounded window needs into each block,
* ``running`` carries sums, maxima and last or next values over block borders
  through one summary row per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.columns import c, join_small
from tidebars.session import materialize

BLOCK_ROWS = 16_384
SERIES = ("symbol",)


def with_position(
    df: DataFrame, by: Sequence[str] = SERIES, order: Sequence[str] = ("ts",), tasks: int | None = None
) -> DataFrame:
    """Add ``_i``, the row's zero-based place in its series, and ``_n``, the series length.

    ``order`` should order the rows of a series without ties; every row needs its ``by``
    columns, and one without them is an error rather than a row lost. The range shuffle gives
    every task a contiguous run of about equal size whatever the keys look like; the
    runs are written once, because the bounds of a range shuffle are sampled anew
    each time it is planned. ``tasks``, or the setting ``tidebars.rangePartitions``, is the number of runs
    (the number of shuffle partitions otherwise); a run should fit in a task's memory, say 256 MB.

    A table that has positions keeps them if they were made for the same series and order; positions
    of an unknown order (a table read from elsewhere) are trusted.
    """
    by, order = list(by), list(order)
    if "_i" in df.columns:
        made = df.schema["_i"].metadata.get("series")
        if made and made != by:
            raise ValueError(f"the table is positioned within {made}, not {by}")
        return df
    conf = df.sparkSession.conf
    tasks = tasks or int(conf.get("tidebars.rangePartitions", conf.get("spark.sql.shuffle.partitions")))
    named = {k: F.coalesce(c(k), F.raise_error(F.lit(f"a row has no {k}"))) for k in by}
    placed = materialize(
        df.withColumns(named).repartitionByRange(tasks, *by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_run", F.shiftright("_id", 33))
    )
    runs = placed.groupBy(*by, "_run").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # At most one row per task and series: this window stays small for any data size.
    w = Window.partitionBy(*by)
    before = w.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *by,
        "_run",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(w).alias("_n"),
    )
    out = join_small(placed, runs, [*by, "_run"])
    at = (F.col("_id") + F.col("_shift")).alias("_i", metadata={"series": by})
    return out.select("*", at).drop("_id", "_run", "_shift")


def home_block(rows: int) -> Column:
    return F.floor(F.col("_i") / F.lit(rows))


def with_halo(df: DataFrame, back: int, ahead: int = 0, rows: int | None = None) -> DataFrame:
    """Put each row in its block, and in the neighbour that looks ``back`` or ``ahead`` at it."""
    rows = block_rows(back, ahead, rows)
    home, at = home_block(rows), F.col("_i") % rows
    seats = [home]
    if back:
        after = (at >= rows - back) & ((home + 1) * rows < F.col("_n"))
        seats.append(F.when(after, home + 1))
    if ahead:
        seats.append(F.when((at < ahead) & (home > 0), home - 1))
    if len(seats) == 1:
        return df.withColumn("_blk", home)
    return df.withColumn("_blk", F.explode(F.array_compact(F.array(*seats))))


def own_rows(
    df: DataFrame, back: int, ahead: int = 0, rows: int | None = None, keep_block: bool = False
) -> DataFrame:
    """Drop the halo copies again."""
    rows = block_rows(back, ahead, rows)
    own = df.where(F.col("_blk") == home_block(rows))
    return own if keep_block else own.drop("_blk")


def block_rows(back: int, ahead: int = 0, rows: int | None = None) -> int:
    return max(rows or BLOCK_ROWS, back, ahead, 1)


@dataclass(frozen=True)
class Frames:
    """Window frames over one block; all share one partitioning and one sort."""

    by: tuple[str, ...] = SERIES
    rows_per_block: int = BLOCK_ROWS

    @property
    def base(self):
        return Window.partitionBy(*self.by, "_blk").orderBy("_i")

    def rows(self, first: int, last: int):
        return self.base.rowsBetween(first, last)

    def last(self, n: int):
        """The current row and the n-1 before it."""
        return self.rows(-(n - 1), 0)

    def prior(self, n: int):
        """The n rows before the current one."""
        return self.rows(-n, -1)

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(c(x), n).over(self.base)

    def lead(self, x, n: int = 1) -> Column:
        return F.lead(c(x), n).over(self.base)

    def roll(self, agg, x, n: int) -> Column:
        """Aggregate of the last n rows, NULL unless all n are non-null."""
        w = self.last(n)
        return F.when(F.count(c(x)).over(w) == n, agg(c(x)).over(w))


def running(
    df: DataFrame,
    specs: dict[str, tuple[str, str]],
    by: Sequence[str] = SERIES,
    rows: int | None = None,
) -> DataFrame:
    """Running values over whole series: ``{new column: (kind, column)}``.

    Kinds: ``sum`` and ``max`` up to the row; ``last`` and ``next``, the nearest
    non-null value at or before, at or after the row; ``prior``, the nearest strictly
    before it. Each block is scanned on its
    own and reduced to one summary row; only the summaries are combined in order.
    ``df`` is read twice, so pass a table or a cheap plan.
    """
    if "_blk" not in df.columns:
        # With blocks of its own, a table from the window stage needs no second shuffle.
        df = df.withColumn("_blk", home_block(block_rows(0, 0, rows)))
    return carried(df.withColumns(running_within(specs, by)), df, specs, by)


def running_within(specs: dict[str, tuple[str, str]], by: Sequence[str] = SERIES, own: Column | None = None) -> dict[str, Column]:
    """The running values of ``running`` within each block (``_l_…``), over its ``own`` rows if it holds others."""
    start = Window.unboundedPreceding
    inner = Window.partitionBy(*by, "_blk").orderBy("_i")
    upto, before = inner.rowsBetween(start, 0), inner.rowsBetween(start, -1)
    # Looking ahead is looking back in reverse order: a frame that ends at the last row
    # is built anew for every row, one that starts at the first row only grows.
    onward = Window.partitionBy(*by, "_blk").orderBy(F.desc("_i")).rowsBetween(start, 0)
    frames = {"sum": upto, "max": upto, "last": upto, "prior": before, "next": onward}
    out = {}
    for name, (kind, col) in specs.items():
        if kind not in frames:
            raise ValueError(f"unknown running kind {kind!r}")
        x = c(col) if own is None else F.when(own, c(col))
        value = {"sum": F.sum, "max": F.max}.get(kind, lambda v: F.last(v, ignorenulls=True))(x)
        out[f"_l_{name}"] = value.over(frames[kind])
    return out


def carried(local: DataFrame, df: DataFrame, specs: dict[str, tuple[str, str]], by: Sequence[str] = SERIES) -> DataFrame:
    """Running values over whole series from those within blocks (``local``, as ``running_within`` makes them) and the
    blocks' summaries, one row each, from the rows of ``df``. The blocks' numbers go, with what is left of ``_l_…``."""
    by = list(by)
    start = Window.unboundedPreceding
    earlier = Window.partitionBy(*by).orderBy("_blk").rowsBetween(start, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("_blk")).rowsBetween(start, -1)
    summary, carry, final = [], [], {}
    for out, (kind, col) in specs.items():
        x, s, k, v = c(col), f"_s_{out}", f"_c_{out}", f"_l_{out}"
        known = F.when(x.isNotNull(), F.col("_i"))
        if kind == "sum":
            summary.append(F.sum(x).alias(s))
            carry.append(F.sum(c(s)).over(earlier).alias(k))
            final[out] = F.coalesce(c(v) + c(k), c(v), c(k))
        elif kind == "max":
            summary.append(F.max(x).alias(s))
            carry.append(F.max(c(s)).over(earlier).alias(k))
            final[out] = F.greatest(c(v), c(k))
        else:
            ahead = kind == "next"
            summary.append((F.min_by if ahead else F.max_by)(x, known).alias(s))
            carry.append(F.last(c(s), ignorenulls=True).over(later if ahead else earlier).alias(k))
            final[out] = F.coalesce(c(v), c(k))
    keep = [n for n in local.columns if n != "_blk" and n not in specs and n.removeprefix("_l_") not in specs]
    borders = df.groupBy(*by, "_blk").agg(*summary).select(*by, "_blk", *carry)
    out = join_small(local, borders, [*by, "_blk"])
    return out.select(*[c(n) for n in keep], *[x.alias(n) for n, x in final.items()])
