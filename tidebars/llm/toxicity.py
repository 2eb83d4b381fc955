"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are taken as labelled; all other text is unlabelled, not clean. A linear
classifier over distinct words minimises

    prior * E_toxic[loss(f)] + max(0, E_unlabelled[loss(-f)] - prior * E_toxic[loss(-f)])

where the second part estimates the risk on clean text; when it falls below zero the classifier has
begun to learn the unlabelled rows by heart, and its step is reversed (Kiryo et al. 2017). The class
prior is the share of toxic rows among the labels that may be used, unless it is given.

It is fitted on about ``most_toxic`` and ``most_unlabelled`` rows, chosen by a hash of the id; every
text is scored whole.

Defined results: NULL and empty texts get the score of a text without known words; so does every text
if no toxic row is given, then with score 0; repeated rows are scored each; labels that repeat a
document count once; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import held_out, map_arrow, slices, texts

DIMS = 1 << 20
STEM = 4  # bytes
#: ASCII letters to lower case, other ASCII to space; longer characters stay.
LETTERS = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def words(text: bytes) -> np.ndarray:
    """Hashed distinct words and beginnings of words."""
    found = set(text.translate(LETTERS).split())
    found.update([w[:STEM] + b"-" for w in found if len(w) > STEM])
    return np.unique(np.fromiter(map(zlib.crc32, found), "u4", len(found)) & np.uint32(DIMS - 1)).astype("i4")


@dataclass
class Classifier:
    weight: np.ndarray  # of each hashed word
    bias: float

    def scores(self, docs: list[bytes]) -> np.ndarray:
        z = np.array([self.weight[words(t)].sum(dtype="f8") for t in docs]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit_rows(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4, least_z: float = 4.0) -> Classifier:
    """Full-batch Adam on the non-negative risk.

    Only words whose share among toxic rows differs from that among the others by ``least_z`` standard
    errors carry a weight; the rest would be learned by heart.
    """
    if not toxic or not unlabelled:
        return Classifier(np.zeros(DIMS, "f4"), -745.0)
    rows = toxic + unlabelled
    ids, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n_ids = np.cumsum([len(r) for r in rows])[len(toxic) - 1]
    in_toxic, in_rest = np.bincount(ids[:n_ids], minlength=DIMS), np.bincount(ids[n_ids:], minlength=DIMS)
    share = (in_toxic + in_rest + 1) / (len(rows) + 2)
    error = np.sqrt(share * (1 - share) * (1 / len(toxic) + 1 / len(unlabelled)))
    used = np.flatnonzero(np.abs(in_toxic / len(toxic) - in_rest / len(unlabelled)) >= least_z * error)
    place = np.full(DIMS, -1)
    place[used] = np.arange(len(used))
    keep = place[ids] >= 0
    ids, owner = place[ids][keep], owner[keep]
    is_toxic = np.arange(len(rows)) < len(toxic)
    n_toxic, n_rest = len(toxic), len(unlabelled)
    w = np.zeros(len(used) + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(owner, w[:-1][ids], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        soft = np.logaddexp(0, z)  # loss(-f) of the logistic loss
        clean_risk = soft[~is_toxic].mean() - prior * soft[is_toxic].mean()
        on_toxic = np.where(is_toxic, prior * (p - 1) / n_toxic, 0)
        on_clean = np.where(is_toxic, -prior * p / n_toxic, p / n_rest)
        slope = on_toxic + on_clean if clean_risk >= 0 else -on_clean
        grad = np.append(np.bincount(ids, slope[owner], len(used)), slope.sum())
        grad[:-1] += decay * w[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    weight = np.zeros(DIMS, "f4")
    weight[used] = w[:-1]
    return Classifier(weight, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, most_toxic: int = 4000, most_unlabelled: int = 12_000) -> Classifier:
    """Learn from rows that are not held out."""
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_toxic, n_labels = usable.agg(F.coalesce(F.sum(F.expr("if(toxic = 1, 1, 0)")), F.lit(0)), F.count("*")).first()
    if not n_toxic:
        return fit_rows([], [], 0.0)
    n_docs = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20))
    toxic = usable.where((F.col("toxic") == 1) & (draw < int(min(1, most_toxic / n_toxic) * (1 << 20))))
    # About most_toxic ids, so the hint has a bound.
    marked = docs.where(~held_out()).join(F.broadcast(toxic.select("doc_id", F.lit(True).alias("toxic"))), "doc_id", "left")
    other = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(min(1, most_unlabelled / max(1, n_docs)) * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(0), "other": batch.column(1), "x": [words(t).tobytes() for t in texts(batch)]}, schema=pa.schema([("toxic", pa.bool_()), ("other", pa.bool_()), ("x", pa.binary())]))

    picked = marked.select(F.coalesce("toxic", F.lit(False)).alias("toxic"), F.coalesce(other, F.lit(False)).alias("other"), "text").where("toxic or other")
    rows = sorted(picked.mapInArrow(run, "toxic boolean, other boolean, x binary").collect())
    x = [np.frombuffer(r["x"], "i4") for r in rows]
    return fit_rows([v for v, r in zip(x, rows, strict=True) if r["toxic"]], [v for v, r in zip(x, rows, strict=True) if r["other"]], prior or n_toxic / n_labels)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """One row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value.scores(texts(batch))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype("i4"))], names=["doc_id", "held_out", "score", "predicted"])

    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_arrow(data, run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
