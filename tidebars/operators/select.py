"""Feature selection: correlation, tree importance, recursive elimination, votes."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.columns import c, join_small, numeric_columns
from tidebars.operators import trees as boosted
from tidebars.operators.blocks import SERIES, with_position
from tidebars.operators.model_prep import model_matrix
from tidebars.session import materialize

log = logging.getLogger(__name__)
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def features_of(df: DataFrame, target: str, by=SERIES) -> list[str]:
    return [n for n in numeric_columns(df) if n not in (target, "close_og", "_i", "_n", *by)]


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair over rows where both are known: ``a, b, corr``.

    Each task reduces its rows to six sums per pair with one matrix product; the sums
    are shifted by the column means, so that large levels cost no precision. A pair
    with a constant column has NULL.
    """
    means = df.agg(*[F.avg(c(n)).alias(n) for n in cols]).first()
    centre = np.array([means[n] if means[n] is not None else 0.0 for n in cols], dtype=float)
    names = list(cols)
    left, right = np.triu_indices(len(names))

    def partial(batches):
        acc = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float, na_value=np.nan) - centre
            known = np.isfinite(x).astype(float)
            x = np.where(known > 0, x, 0.0)
            # n, sum of x where y is known, sum of y where x is known, and so on.
            part = np.stack(
                [
                    known.T @ known,
                    x.T @ known,
                    known.T @ x,
                    (x * x).T @ known,
                    known.T @ (x * x),
                    x.T @ x,
                ]
            )[:, left, right]
            acc = part if acc is None else acc + part
        if acc is not None:
            out = pd.DataFrame(acc.T, columns=SUMS)
            out.insert(0, "b", right)
            out.insert(0, "a", left)
            yield out

    schema = "a int, b int, " + ", ".join(f"{s} double" for s in SUMS)
    sums = (
        df.select(*[c(n).cast("double").alias(n) for n in cols])
        .mapInPandas(partial, schema)
        .groupBy("a", "b")
        .agg(*[F.sum(s).alias(s) for s in SUMS])
    )
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    # A spread this far below the raw sums is rounding: the column is constant there.
    real = (n > 1) & (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    corr = F.when(real, cov / F.sqrt(F.nullif(vx, F.lit(0.0))) / F.sqrt(F.nullif(vy, F.lit(0.0))))
    label = F.array(*[F.lit(x) for x in names])
    return sums.where(n > 0).select(
        F.get(label, F.col("a")).alias("a"), F.get(label, F.col("b")).alias("b"), corr.alias("corr")
    )


def correlation_lookup(df: DataFrame, cols: list[str]) -> dict[tuple[str, str], float]:
    """The matrix on the driver: its size depends on the number of columns only."""
    out = {}
    for r in correlations(df, cols).collect():
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["corr"]
    return out


def cfs(
    df: DataFrame, target: str = "close", k: int = 15, corr_threshold: float = 0.7
) -> list[str]:
    """Up to k features most correlated with the target, dropping near copies of the target
    (over 0.95) and those too close to one already chosen. The target comes last."""
    cols = features_of(df, target)
    corr = correlation_lookup(df, [*cols, target])
    strength = {n: abs(corr[n, target]) for n in cols if corr.get((n, target)) is not None}
    chosen: list[str] = []
    for name in sorted(strength, key=lambda n: (-strength[n], n))[:k]:
        if strength[name] > 0.95:
            continue
        if all(abs(corr.get((name, o)) or 0.0) <= corr_threshold for o in chosen):
            chosen.append(name)
    return [*chosen, target]


def correlation_report(df: DataFrame, target: str = "close", top: int = 20) -> DataFrame:
    """The ``top`` features by strength, and their correlations with each other."""
    cols = features_of(df, target)
    pairs = correlations(df, [*cols, target])
    both = pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    best = (
        both.where((F.col("b") == target) & (F.col("a") != target) & F.col("corr").isNotNull())
        .orderBy(F.abs("corr").desc(), "a")
        .limit(top)
        .select(F.col("a").alias("feature"))
    )
    matrix = both.join(best.withColumnRenamed("feature", "a"), "a", "left_semi")
    others = best.withColumnRenamed("feature", "b").unionByName(
        df.sparkSession.createDataFrame([(target,)], "b string")
    )
    return matrix.join(others, "b", "left_semi").select("a", "b", "corr")


def tree_nodes(
    df: DataFrame, target: str = "close", trees: int = 100, depth: int = 6, seed: int = 42, fit_rows: int = 100_000, rate: float = 0.3
) -> DataFrame:
    """Boosted trees for the target as a table of nodes: tree, node, feature, threshold, gain, n, value.

    Fitted on 80 % of the rows, at most about ``fit_rows``, chosen by a hash of the row. Rows of a node with
    ``feature <= threshold`` go to its left child (2 * node), others to the right; a leaf has a value and no feature.
    The prediction is the sum of the values that a row reaches, that of tree -1 (the mean) included.
    """
    cols = features_of(df, target)
    rows = boosted.numbers(df, cols, target)
    how = boosted.binning(rows, cols)
    table = materialize(boosted.binned(rows, how, seed=seed))
    share = min(0.8, fit_rows / max(1, table.count()))
    chosen = table.where(F.col("draw") < int(share * boosted.DRAWS)).withColumn("fit", F.lit(0))
    boosting = boosted.Boosting(trees, depth, rate)
    nodes = boosted.fit_each(chosen, "fit", lambda _, x, y: boosted.fit(x, y, boosting), boosted.NODES)
    nodes = materialize(nodes)
    names = df.sparkSession.createDataFrame(
        [(k, b, n, float(t)) for k, (n, at) in enumerate(zip(cols, how.cuts, strict=True)) for b, t in enumerate(at)], "feature int, bin int, name string, threshold double"
    )
    split = join_small(nodes, names, ["feature", "bin"], "left")  # leaves have neither and keep NULL
    unit = F.lit(how.unit)
    return split.select("tree", "node", F.col("name").alias("feature"), "threshold", (F.col("gain") * unit * unit).alias("gain"), "n", (F.col("value") * unit).alias("value"))


def tree_importance(df: DataFrame, target: str = "close", **fit) -> DataFrame:
    """Importance of each feature in boosted trees (``tree_nodes``): its share of all gain; 0 if no tree uses it."""
    names = df.sparkSession.createDataFrame([(n,) for n in features_of(df, target)], "feature string")
    gains = tree_nodes(df, target, **fit).where(F.col("feature").isNotNull()).groupBy("feature").agg(F.sum("gain").alias("gain"))
    # At most one row per feature.
    shares = gains.select("feature", F.try_divide("gain", F.sum("gain").over(Window.partitionBy(F.lit(0)))).alias("importance"))
    return names.join(shares, "feature", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def select_by_trees(df: DataFrame, target: str = "close", threshold: float = 0.01, **kw) -> list[str]:
    scores = tree_importance(df, target, **kw).where(F.col("importance") > threshold)
    return [r["feature"] for r in scores.orderBy(F.desc("importance"), "feature").collect()]


def time_folds(df: DataFrame, splits: int = 5, by=SERIES, order: str = "ts") -> DataFrame:
    """Add ``_fold`` 0..splits: equal runs of time order over all series.

    Fold k is tested by a model trained on all folds before it.
    """
    df = df.drop("_i", "_n")
    placed = with_position(df.withColumn("_all", F.lit(0)), ["_all"], [order, *by])
    size = F.floor(F.col("_n") / (splits + 1))
    first = F.col("_n") - splits * size
    fold = F.when(F.col("_i") < first, 0).otherwise(F.floor((F.col("_i") - first) / size) + 1)
    return placed.withColumn("_fold", fold.cast("int")).drop("_all", "_i", "_n")


def rfecv_rounds(
    df: DataFrame,
    target: str = "close",
    min_features: int = 5,
    step: int | float = 2,
    splits: int = 5,
    trees: int = 100,
    depth: int = 4,
    fit_rows: int = 100_000,
    rate: float = 0.3,
    by=SERIES,
) -> DataFrame:
    """Recursive elimination within each time fold: one row per fold and round.

    ``fold`` k is trained on all folds before k and tested on fold k; the last, ``splits + 1``, is trained on all
    rows and tested on none. A round fits boosted trees on the features left and drops the ``step`` of least
    importance (that share of them if below 1; of equal ones the later). Trees see at most about ``fit_rows`` rows
    of a training part, chosen by a hash of the row; every row of a test fold is scored by every round's trees.
    Folds are tasks side by side. Columns: fold, n_features, train_rows, test_rows, score (negative
    mean squared error), strongest, features.
    """
    cols = features_of(df, target, by)
    rows = boosted.numbers(time_folds(df, splits, by), cols, target, ["_fold"])
    how = boosted.binning(rows, cols)
    table = materialize(boosted.binned(rows, how, ["_fold"]))
    sizes = {r["_fold"]: r["count"] for r in table.groupBy("_fold").count().collect()}
    before = {k: sum(n for f, n in sizes.items() if f < k) for k in range(1, splits + 2)}
    into = [
        F.when((F.col("_fold") < k) & (F.col("draw") < int(min(1.0, fit_rows / max(1, before[k])) * boosted.DRAWS)), k) for k in before
    ]
    parts = table.withColumn("fold", F.explode(F.array_compact(F.array(*into))))
    boosting, p = boosted.Boosting(trees, depth, rate), len(cols)

    def eliminate(fold: int, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        at, out = np.arange(p), []
        while True:
            nodes = boosted.fit(x[:, at], y, boosting)
            worth = boosted.importance(nodes, len(at))
            nodes["feature"] = nodes["feature"].map(lambda f, at=at: at[int(f)], na_action="ignore")
            out.append((fold, len(at), int(at[worth.argmax()]) if len(at) else None, at.tolist(), boosted.Ensemble.of(nodes).to_bytes()))
            if len(at) <= min_features:
                return pd.DataFrame(out, columns=["fold", "n_features", "strongest", "features", "model"])
            n = max(1, int(len(at) * step)) if step < 1 else int(step)
            weak = np.lexsort((-np.arange(len(at)), worth))[: min(n, len(at) - min_features)]
            at = np.delete(at, weak)

    schema = "fold int, n_features int, strongest int, features array<int>, model binary"
    # Ensembles are bounded by folds, rounds, trees and depth (35 KB each with the defaults), whatever the rows.
    fitted = [r.asDict() for r in boosted.fit_each(parts, "fold", eliminate, schema).collect()]
    models: dict[int, list] = {}
    for r in fitted:
        models.setdefault(r["fold"], []).append((r["n_features"], bytes(r["model"])))
    shared = df.sparkSession.sparkContext.broadcast(models)

    def judge(batches):
        known = {k: [(n, boosted.Ensemble.from_bytes(m)) for n, m in of] for k, of in shared.value.items()}
        for batch in batches:
            folds, y = batch.column("_fold").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "u1").reshape(batch.num_rows, p)
            out = []
            for k in np.unique(folds):
                here = folds == k
                for n, model in known.get(int(k), []):
                    miss = (model.predict(x[here]) - y[here]) * how.unit
                    out.append((int(k), n, int(here.sum()), float(miss @ miss)))
            if out:
                yield pd.DataFrame(out, columns=["fold", "n_features", "n", "miss"])

    def judge_frames(batches):
        for frame in judge(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    test = table.where(F.col("_fold") > 0).select("_fold", "x", "y").mapInArrow(judge_frames, "fold long, n_features long, n long, miss double")
    errors = test.groupBy("fold", "n_features").agg((-F.sum("miss") / F.sum("n")).alias("score"))
    score = {(r["fold"], r["n_features"]): r["score"] for r in errors.collect()}
    report = [
        (r["fold"], r["n_features"], before[r["fold"]], sizes.get(r["fold"], 0), score.get((r["fold"], r["n_features"])), cols[r["strongest"]] if r["features"] else None, [cols[i] for i in r["features"]])
        for r in fitted
    ]
    return df.sparkSession.createDataFrame(report, "fold int, n_features int, train_rows long, test_rows long, score double, strongest string, features array<string>")


def rfecv(df: DataFrame, target: str = "close", min_features: int = 5, **fit) -> tuple[list[str], DataFrame]:
    """Drop the weakest features round by round (``rfecv_rounds``); the best mean score over time folds wins.

    The features chosen are those that an elimination over all folds leaves at the best size. Returns them
    and a report ``n_features, score`` (the mean over folds of the negative mean squared error).
    """
    rounds = rfecv_rounds(df, target, min_features, **fit)
    mean = rounds.where(F.col("score").isNotNull()).groupBy("n_features").agg(F.avg("score").alias("score"))
    best = mean.orderBy(F.desc("score"), "n_features").first()
    last = rounds.where(F.col("n_features") == (best["n_features"] if best else min_features)).orderBy(F.desc("fold")).first()
    return (list(last["features"]) if last else []), mean


def votes(spark, chosen: dict[str, list[str] | None], target: str) -> DataFrame:
    """``feature, n_votes, selected``: kept when named by more than half of the methods.

    A method that failed (None) counts as a method without votes.
    """
    named = [(m, f) for m, fs in chosen.items() for f in (fs or []) if f != target]
    need = len(chosen) // 2 + 1
    table = spark.createDataFrame(named, "method string, feature string")
    counts = table.groupBy("feature").agg(F.count_distinct("method").alias("n_votes"))
    return counts.withColumn("selected", F.col("n_votes") >= need)


def chosen_by(
    x: DataFrame, method: str, target: str = "close", k: int = 5, trees: int = 100, by=SERIES, rfe: dict | None = None
) -> list[str] | None:
    """What one method chooses from a model matrix; None if it fails. ``rfe``: arguments of ``rfecv``."""
    plain = x.drop(*by)  # keys that are numbers are no features
    run = {
        "cfs": lambda: cfs(plain, target, k),
        "trees": lambda: select_by_trees(plain, target, trees=trees),
        "rfe": lambda: rfecv(x, target, k, **{"trees": trees, "by": by, **(rfe or {})})[0],
    }
    try:
        return run[method]()
    except (ValueError, ArithmeticError) as e:
        log.error("selection method %s failed: %s", method, e)
        return None


def select_features(
    df: DataFrame,
    target: str = "close",
    methods: tuple[str, ...] = ("cfs", "trees", "rfe"),
    k: int = 5,
    trees: int = 100,
    keys: list[str] = ("symbol", "ts"),
    rfe: dict | None = None,
    chosen: dict[str, list[str] | None] | None = None,
) -> DataFrame:
    """Keys, the features most methods agree on, and the target. ``rfe``: arguments of ``rfecv``; ``chosen``: what
    each method has chosen from ``df``, which is a model matrix then."""
    by = [n for n in keys if n != "ts"]
    x = df if chosen else model_matrix(df, target, keep=by)
    chosen = chosen or {m: chosen_by(x, m, target, k, trees, by, rfe) for m in methods}
    if len(methods) > 1:
        picked = votes(df.sparkSession, chosen, target).where("selected").orderBy("feature")
        names = [r["feature"] for r in picked.collect()]
    else:
        names = [n for n in chosen[methods[0]] or [] if n != target]
    return x.select(*[c(n) for n in keys if n in x.columns], *[c(n) for n in names if n not in keys], c(target))
