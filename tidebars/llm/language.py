"""Language identification in two steps: the family first, then the languages within it.

Features are hashed letter trigrams. Families are learned: the languages' mean profiles are merged by
average linkage until about the square root of their number is left. A linear support vector machine
per family (one against the rest) picks the family; within it one machine for each pair of languages
votes, margins deciding ties.

The machines are fitted on a sample of labelled rows, about ``per_language`` of each language and
``most`` in all, chosen by a hash of the id. Every text is judged whole.

Defined results: a NULL text, or one without a letter, is ``und`` with score 0, and so is every text
if there is nothing to learn from; repeated rows are judged each; an empty table gives an empty table.
"""

from __future__ import annotations

import collections
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import held_out, map_arrow, slices, texts

DIMS = 4096
UNKNOWN = "und"
ASCII_LETTER, LETTER = re.compile(rb"[A-Za-z]"), regex.compile(r"\p{L}")


def _classes() -> np.ndarray:
    """Bytes to lower case, other than letters to space; bytes of longer characters stay."""
    table = np.full(256, 32, "u4")
    table[128:] = np.arange(128, 256)
    for b in range(97, 123):
        table[b] = table[b - 32] = b
    return table


CLASSES = _classes()


def profiles(docs: list[bytes]) -> np.ndarray:
    """Row for each text: square roots of the shares of its hashed trigrams."""
    out = np.empty((len(docs), DIMS), "f4")
    for at in range(0, len(docs), 64):
        some = docs[at : at + 64]
        # Two spaces stand before each text and behind the last: no trigram reaches into another text's count.
        data = CLASSES[np.frombuffer(b"  " + b"  ".join([*some, b""]), "u1")]
        code = data[:-2] * np.uint32(2654435761) ^ data[1:-1] * np.uint32(2246822519) ^ data[2:] * np.uint32(3266489917)
        code = (code >> np.uint32(9)) & np.uint32(DIMS - 1)
        lengths = np.array([len(d) + 2 for d in some])
        owner = np.repeat(np.arange(len(some), dtype="i4"), lengths) * DIMS
        inner = data[1:-1] != 32
        counts = np.bincount((owner + code.astype("i4"))[inner], minlength=len(some) * DIMS).reshape(len(some), DIMS)
        out[at : at + 64] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    return out


def sparse(row: np.ndarray) -> bytes:
    """A profile in half precision as its places that are not zero, then their values."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].tobytes()


def dense(body: bytes) -> bytes:
    """The whole profile behind ``sparse``."""
    n, row = len(body) // 4, np.zeros(DIMS, "f2")
    row[np.frombuffer(body, "<u2", n)] = np.frombuffer(body, "f2", n, 2 * n)
    return row.tobytes()


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, classes weighted alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype("f4")
    w = v = np.zeros(x.shape[1] + 1, "f4")
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * y * weight
        grad = np.append(-2 * (slack @ x), -2 * slack.sum()) + decay * v
        new = (v - 0.25 * grad).astype("f4")
        v = (new + k / (k + 3) * (new - w)).astype("f4")
        w = new
    return w


@dataclass
class Hierarchy:
    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    family_w: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_w: np.ndarray | None = None

    @staticmethod
    def fitted(x: np.ndarray, labels: list[str]) -> Hierarchy:
        names = sorted(set(labels))
        h = Hierarchy(names)
        if not names:
            return h
        y = np.array([names.index(v) for v in labels])
        h.families = families(np.stack([x[y == k].mean(0) for k in range(len(names))]))
        own = np.array([next(f for f, members in enumerate(h.families) if k in members) for k in range(len(names))])[y]
        h.family_w = np.stack([svm(x, np.where(own == f, 1, -1).astype("f4")) for f in range(len(h.families))])
        h.pairs = [(a, b) for m in h.families for a in m for b in m if a < b]
        ws = []
        for a, b in h.pairs:
            rows = (y == a) | (y == b)
            ws.append(svm(x[rows], np.where(y[rows] == a, 1, -1).astype("f4")))
        h.pair_w = np.stack(ws) if ws else np.zeros((0, x.shape[1] + 1), "f4")
        return h

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score from 0 to 1."""
        by_family = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
        by_pair = x @ self.pair_w[:, :-1].T + self.pair_w[:, -1]
        n, k = len(x), len(self.languages)
        votes, margin = np.zeros((n, k)), np.full((n, k), 4.0)
        for p, (a, b) in enumerate(self.pairs):
            m = by_pair[:, p]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            margin[:, a] = np.minimum(margin[:, a], m)
            margin[:, b] = np.minimum(margin[:, b], -m)
        family = by_family.argmax(1)
        member = np.zeros((len(self.families), k), bool)
        for f, members in enumerate(self.families):
            member[f, members] = True
        rank = np.where(member[family], votes + 1 / (1 + np.exp(-margin)) / 2, -1)
        best = rank.argmax(1)
        score = 1 / (1 + np.exp(-2 * by_family.max(1))) / (1 + np.exp(-2 * margin[np.arange(n), best]))
        return best, np.clip(score, 0, 1)


def families(centres: np.ndarray) -> list[list[int]]:
    """Languages grouped by average linkage of their profiles' distances."""
    groups = [[k] for k in range(len(centres))]
    distance = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    while len(groups) > math.ceil(math.sqrt(len(centres))):
        _, a, b = min((distance[np.ix_(groups[a], groups[b])].mean(), a, b) for a in range(len(groups)) for b in range(a))
        groups[b] += groups.pop(a)
    return [sorted(g) for g in groups]


def fit(docs: DataFrame, per_language: int = 1000, most: int = 12_000) -> Hierarchy:
    """Learn from the rows of ``docs`` that are not held out and have a language."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return Hierarchy()
    each = min(per_language, most // len(counts))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            x = profiles(texts(batch)).astype("f2")
            yield pa.RecordBatch.from_pydict({"lang": batch.column(0), "x": [sparse(r) for r in x]}, schema=pa.schema([("lang", pa.string()), ("x", pa.binary())]))

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, x binary").collect()
    if not rows:
        return Hierarchy()
    by_lang = collections.defaultdict(list)
    for row in rows:
        by_lang[row["lang"]].append(row["x"])
    # The driver holds short rows; they are widened one language at a time, in an order that does not depend on Spark's.
    x, labels = np.empty((len(rows), DIMS), "f4"), []
    del rows
    for lang in sorted(by_lang):
        for wide in sorted(dense(r) for r in by_lang.pop(lang)):
            x[len(labels)] = np.frombuffer(wide, "f2")
            labels.append(lang)
    return Hierarchy.fitted(x, labels)


def judge(model: Hierarchy, docs: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and score of texts."""
    known = [bool(model.languages) and bool(ASCII_LETTER.search(t) or LETTER.search(t.decode("utf-8", "replace"))) for t in docs]
    lang, score = [UNKNOWN] * len(docs), np.zeros(len(docs))
    rows = np.flatnonzero(known)
    if len(rows):
        best, score[rows] = model.predict(profiles([docs[k] for k in rows]))
        for k, b in zip(rows, best, strict=True):
            lang[k] = model.languages[b]
    return lang, score


def predict(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """One row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors for each pair of related languages

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = judge(shared.value, texts(batch))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_arrow(data, run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    return predict(docs, fit(docs, per_language))


def accepted(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """The documents whose language is known, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, _ = judge(shared.value, texts(batch))
        return batch.filter(pa.array([v != UNKNOWN for v in lang]))

    return map_arrow(docs, run, docs.schema)
