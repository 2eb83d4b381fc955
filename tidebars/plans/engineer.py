"""The whole way from raw bars to a selected feature table."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.columns import OHLCV, c
from tidebars.operators.blocks import SERIES, with_position
from tidebars.operators.clean import clean
from tidebars.operators.model_prep import model_matrix
from tidebars.operators.select import chosen_by, select_features, votes
from tidebars.operators.transform import transform
from tidebars.operators.validate import issues, verdict
from tidebars.plans.registry import generate
from tidebars.plans.stages import Stages, content
from tidebars.session import scratch_dir
from tidebars.sources.files import write_bars

log = logging.getLogger(__name__)


def engineer(
    bars: DataFrame,
    features: Iterable[str] | None = None,
    target: str = "close",
    methods: tuple[str, ...] = ("cfs", "trees", "rfe"),
    k: int = 5,
    trees: int = 100,
    now: datetime | None = None,
    out: str | None = None,
    by=SERIES,
    rows: int | None = None,
    folder: str | None = None,
    rfe: dict | None = None,
) -> dict[str, DataFrame]:
    """Clean, validate, generate, transform, select and, with ``out``, write.

    Validation only reports: a failed verdict is logged and the run goes on. Each stage is a table in
    ``folder`` (a new one in the shared folder by default). A run that is given the folder of one that was lost, with the same
    bars and arguments, takes over the stages that had ended, each selection method one of its own.
    """
    spark, by = bars.sparkSession, list(by)
    stages = Stages(spark, folder or f"{scratch_dir(spark)}/engineer-{datetime.now().timestamp()}", content(bars) if folder else "")
    features = None if features is None else list(features) if not isinstance(features, dict) else features

    cleaned = stages.table("cleaned", lambda: with_position(clean(bars, by=by, rows=rows).select(*by, "ts", *OHLCV), by), by=by, rows=rows)
    report = stages.table("issues", lambda: issues(cleaned, now, by, rows), now=now)
    valid = verdict(cleaned, report, by)
    bad = valid.where(~F.col("is_valid")).limit(5).collect()
    if bad:
        log.warning("validation found issues, for example in %s", [r.asDict() for r in bad])
    table = stages.table("features", lambda: generate(cleaned, features, by, rows, keep_position=True), features=features)
    ready = stages.table("transformed", lambda: transform(table, by=by, rows=rows))
    matrix = stages.table("matrix", lambda: model_matrix(ready, target, keep=by), target=target)
    chosen: dict[str, list[str] | None] = {}
    for method in methods:
        of = lambda m=method: named(spark, chosen_by(matrix, m, target, k, trees, by, rfe))
        got = stages.table(f"chosen-{method}", of, k=k, trees=trees, rfe=rfe).orderBy("place").collect()
        chosen[method] = [r["feature"] for r in got if r["feature"] is not None] if got else None
    picked = select_features(matrix, target, methods, keys=[*by, "ts"], chosen=chosen)
    selected = stages.table("selected", lambda: picked, methods=methods)
    if out:
        write_bars(selected, out, by=by)
    return {
        "cleaned": cleaned.drop("_i", "_n"),
        "issues": report,
        "verdict": valid,
        "features": table.drop("_i", "_n"),
        "transformed": ready.drop("_i", "_n"),
        "votes": votes(spark, chosen, target),
        "selected": selected,
        "manifest": stages.manifest(),
    }


def named(spark, features: list[str] | None) -> DataFrame:
    """A list of features as rows; a list that is empty has one row without a feature, a method that failed has none."""
    rows = None if features is None else list(enumerate(features)) or [(0, None)]
    return spark.createDataFrame(rows or [], "place int, feature string")


def stage_profile(tables: dict[str, DataFrame], names: Iterable[str] = ("cleaned", "features", "transformed", "selected"), by=SERIES, value: str = "close") -> DataFrame:
    """What each stage holds of every series: rows, first and last stamp, known values and their sum."""
    parts = [
        tables[n].groupBy(*by).agg(
            F.lit(n).alias("stage"), F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            F.count(c(value)).alias("n_known"), F.sum(c(value)).alias("total"),
        )
        for n in names
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
