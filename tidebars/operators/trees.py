"""Gradient-boosted regression trees over binned features.

Features are cut into at most ``BINS`` bins at their quantiles, and the target is a whole number of small
units, so every sum over rows is exact: a fit gives the same trees on any cluster, whatever the order of its rows. Trees
grow level by level from histograms (node, feature, bin), as gradient boosting on histograms does.

A fit sees at most ``fit_rows`` rows, chosen by a hash of the row; that bounds its task. Any number of
fits run side by side, one task each (``fit_each``). Bins are found on all rows, and all rows are scored.
A fitted ensemble is a table with one row per node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.columns import c

BINS = 32  # per feature
BLOCK = 1 << 17  # cells (rows x features, rows x trees) of a pass: few enough for a processor's cache
FIT_TASKS = 61  # fits are spread by a hash; more tasks than fits, so that few share one
DRAWS = 1 << 20  # five hex digits
#: One row per node: its place in the tree (root 1, children 2i and 2i+1), the split (rows with a bin up to ``bin`` go left)
#: with its gain, or a leaf's value in units of the target. ``feature`` is NULL in leaves.
NODES = "tree int, node int, feature int, bin int, gain double, n long, value double"


@dataclass(frozen=True)
class Binning:
    """Cut points of each feature and the unit of the target."""

    cols: list[str]
    cuts: list[np.ndarray]
    unit: float

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(at, x, "left") for at, x in zip(self.cuts, columns, strict=True)], axis=1).astype("u1")

    def threshold(self, feature: int, bin_: int) -> float:
        """Rows up to this value are in ``bin_`` or below it."""
        return float(self.cuts[feature][bin_])


@dataclass(frozen=True)
class Boosting:
    """Squared error; ``rate`` shrinks a tree's leaves, ``l2`` draws small leaves to zero."""

    trees: int = 100
    depth: int = 6
    rate: float = 0.3
    l2: float = 1.0


def numbers(df: DataFrame, cols: list[str], target: str, extra: list[str] = ()) -> DataFrame:
    """Rows with a target; NULL features count as 0."""
    return df.where(c(target).isNotNull()).select(*extra, *[F.coalesce(c(n).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, n in enumerate(cols)], c(target).cast("double").alias("y"))


def binning(rows: DataFrame, cols: list[str], bins: int = BINS) -> Binning:
    """From quantiles over all rows of ``numbers``; the driver gets ``bins`` numbers a feature."""
    at = [k / bins for k in range(1, bins)]
    cuts = [F.percentile_approx(f"x{k}", at, 100_000).alias(f"x{k}") for k in range(len(cols))]
    found = rows.agg(*cuts, F.max(F.abs("y")).alias("most")).first()
    # A power of two, such that a sum over some 2**22 rows is exact in a double.
    unit = 2.0 ** (int(np.ceil(np.log2((found["most"] or 0.0) + 1.0))) - 30)
    return Binning(list(cols), [np.unique(np.array(found[f"x{k}"] or [], "f8")) for k in range(len(cols))], unit)


def binned(rows: DataFrame, how: Binning, extra: list[str] = (), seed: int = 42) -> DataFrame:
    """``extra``, ``x`` (one byte a feature), ``y`` (the target in whole units) and ``draw`` (20 bits of a hash of both)."""
    schema = rows.select(*extra).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    p = len(how.cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = how.bins([batch.column(f"x{k}").to_numpy(zero_copy_only=False) for k in range(p)])
            y = np.rint(batch.column("y").to_numpy(zero_copy_only=False) / how.unit).astype("i8")
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in extra], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y)], names=[*extra, "x", "y"])

    out = rows.mapInArrow(run, f"{fields}{', ' if fields else ''}x binary, y long")
    told = F.concat_ws(":", F.lit(str(seed)), F.hex("x"), F.col("y").cast("string"))
    return out.withColumn("draw", F.conv(F.substring(F.md5(told), 1, 5), 16, 10).cast("long"))


# ---- one fit, in numpy over a bounded number of rows --------------------------


def histograms(x: np.ndarray, r: np.ndarray, rows: np.ndarray, node: np.ndarray, nodes: int, bins: int) -> np.ndarray:
    """Number of ``rows`` and their sum of ``r`` by (node, feature, bin); one buffer serves all passes."""
    p = x.shape[1]
    size = nodes * p * bins
    out = np.zeros((2, size))
    step = max(1, BLOCK // max(1, p))
    cell, weight = np.empty((step, p), np.intp), np.empty((step, p))
    offset = np.arange(p, dtype=np.intp) * bins
    for a in range(0, len(rows), step):
        some = rows[a : a + step]
        k = len(some)
        np.add(x[some], offset, out=cell[:k])
        if nodes > 1:
            cell[:k] += (node[a : a + step] * (p * bins))[:, None]
        weight[:k] = r[some][:, None]
        flat = cell[:k].ravel()
        out[0] += np.bincount(flat, minlength=size)
        out[1] += np.bincount(flat, weight[:k].ravel(), minlength=size)
    return out.reshape(2, nodes, p, bins)


def grow(x: np.ndarray, r: np.ndarray, how: Boosting, bins: int = BINS) -> tuple[list[tuple], np.ndarray]:
    """One tree on residuals ``r``: its nodes, and what it adds to each row's prediction (whole units)."""
    out, add = [], np.zeros(len(r), "i8")
    rows, at = np.arange(len(r)), np.zeros(len(r), np.intp)  # rows still on the way, and their node within the level
    ids, above = np.array([1]), None

    def leaf(k: int, n: float, g: float) -> int:
        value = int(np.floor(how.rate * g / (n + how.l2) + 0.5))
        out.append((int(ids[k]), None, None, None, int(n), value))
        return value

    for level in range(how.depth + 1):
        if level == how.depth or x.shape[1] == 0:
            n, g = np.bincount(at, minlength=len(ids)), np.bincount(at, r[rows].astype("f8"), minlength=len(ids))
            values = np.array([leaf(k, n[k], g[k]) for k in range(len(ids))], "i8")
            add[rows] = values[at]
            break
        if above is None:
            sums = histograms(x, r, rows, at, 1, bins)
        else:
            # Only the smaller child of each pair is counted; the other is what is left of their parent.
            small = np.bincount(at, minlength=len(ids)).reshape(-1, 2).argmin(1)
            mine = small[at >> 1] == (at & 1)
            counted = histograms(x, r, rows[mine], at[mine] >> 1, len(small), bins)
            sums = np.empty((2, len(small), 2, *counted.shape[2:]))
            pair = np.arange(len(small))
            sums[:, pair, small] = counted
            sums[:, pair, 1 - small] = above - counted
            sums = sums.reshape(2, len(ids), *counted.shape[2:])
        n, g = sums[:, :, 0].sum(2)
        (left_n, left_g) = np.cumsum(sums, 3)[..., :-1]
        right_n, right_g = n[:, None, None] - left_n, g[:, None, None] - left_g
        gain = left_g * left_g / (left_n + how.l2) + right_g * right_g / (right_n + how.l2) - (g * g / (n + how.l2))[:, None, None]
        gain[(left_n < 1) | (right_n < 1)] = -1.0
        gain = gain.reshape(len(ids), -1)
        best = gain.argmax(1)  # the first of equal gains: lowest feature, then lowest bin
        gains = gain[np.arange(len(ids)), best]
        feature, cut = best // (bins - 1), best % (bins - 1)
        split = gains > 0
        values = np.zeros(len(ids), "i8")
        for k in range(len(ids)):
            if split[k]:
                out.append((int(ids[k]), int(feature[k]), int(cut[k]), float(gains[k]), int(n[k]), None))
            else:
                values[k] = leaf(k, n[k], g[k])
        ended = ~split[at]
        add[rows[ended]] = values[at[ended]]
        rows, at = rows[~ended], at[~ended]
        if not len(rows):
            break
        right = x[rows, feature[at]] > cut[at]
        rank = np.cumsum(split) - 1
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], 1).ravel()
        at, above = 2 * rank[at] + right, sums[:, split]
    return out, add


def fit(x: np.ndarray, y: np.ndarray, how: Boosting, bins: int = BINS) -> pd.DataFrame:
    """The ensemble as a node table; tree -1 is the mean, from which the trees go on. Values are in whole units."""
    base = int(np.floor(y.sum() / max(1, len(y)) + 0.5))
    rest, out = y - base, [(-1, 1, None, None, None, len(y), base)]
    for tree in range(how.trees):
        nodes, add = grow(x, rest, how, bins)
        out += [(tree, *row) for row in nodes]
        rest = rest - add
        if len(nodes) == 1 and not nodes[0][-1]:
            break  # nothing is left to learn: all further trees are empty
    return pd.DataFrame(out, columns=["tree", "node", "feature", "bin", "gain", "n", "value"])


def importance(nodes: pd.DataFrame, p: int) -> np.ndarray:
    """The gain of each feature's splits, as shares that add up to 1 (all 0 without a split)."""
    split = nodes.dropna(subset=["feature"])
    total = np.bincount(split["feature"].to_numpy("i8"), split["gain"].to_numpy("f8"), minlength=p)
    return total / total.sum() if total.sum() else total


class Ensemble:
    """A node table as arrays by (tree, node), small enough to send to every task."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.feature, self.cut, self.value = feature, cut, value

    @staticmethod
    def of(nodes: pd.DataFrame) -> Ensemble:
        shape = int(nodes["tree"].max()) + 2, 1 << int(nodes["node"].max()).bit_length()
        t, k, split = nodes["tree"].to_numpy("i8") + 1, nodes["node"].to_numpy("i8"), nodes["feature"].notna().to_numpy()
        out = Ensemble(np.full(shape, -1, "i2"), np.zeros(shape, "u1"), np.zeros(shape, "i8"))
        out.feature[t[split], k[split]] = nodes["feature"][split].to_numpy("i8")
        out.cut[t[split], k[split]] = nodes["bin"][split].to_numpy("i8")
        out.value[t[~split], k[~split]] = nodes["value"][~split].to_numpy("i8")
        return out

    def to_bytes(self) -> bytes:
        return np.array(self.feature.shape, "i8").tobytes() + self.feature.tobytes() + self.cut.tobytes() + self.value.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Ensemble:
        shape, at, out = tuple(np.frombuffer(data, "i8", 2)), 16, []
        for kind in ("i2", "u1", "i8"):
            n = int(np.prod(shape))
            out.append(np.frombuffer(data, kind, n, at).reshape(shape))
            at += n * np.dtype(kind).itemsize
        return Ensemble(*out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions in whole units for rows of bins."""
        trees, wide = self.feature.shape
        each, out = np.arange(trees), np.empty(len(x), "i8")
        step = max(1, BLOCK // trees)
        for a in range(0, len(x), step):
            part = x[a : a + step]
            row, at = np.arange(len(part))[:, None], np.ones((len(part), trees), np.intp)
            for _ in range(wide.bit_length() - 2):
                f = self.feature[each, at]
                at = np.where(f < 0, at, 2 * at + (part[row, f] > self.cut[each, at]))
            out[a : a + step] = self.value[each, at].sum(1)
        return out


# ---- many fits on Spark -------------------------------------------------------


def fit_each(rows: DataFrame, key: str, work: Callable[[int, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``work(key, x, y)`` on the rows of each key, one task for each: rows of a key must be few enough for one."""

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["x"]), "u1").reshape(len(pdf), -1)
        return work(int(k[0]), x, pdf["y"].to_numpy("i8"))

    # An explicit number of tasks, which the adaptive plan does not merge: the work is in the fits, not in the bytes.
    spread = rows.select(key, "x", "y").repartition(FIT_TASKS, key)
    return spread.groupBy(key).applyInPandas(run, schema)
