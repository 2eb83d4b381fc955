"""Periodic runs of words with a dictionary of basic factors.

Words are named by integers within their document. For m = 1, 2, 4, ... every stretch of m words gets a
name, two stretches the same name if they are equal; the names of 2m follow from pairs of names of m.
Where a stretch's next occurrence begins at most 2m words on, and the one after that at the same
distance, the three are terms of an arithmetic progression that proposes the distance as a period.
Proposals of neighbouring positions are one stretch; it is extended word by word to a run, and a run
already found from other names is not extended again.

Nothing is lost: a run of period q and length 4q or more is proposed by the names of m with q <= m < 2q,
as its first m words occur again after q and 2q words, and never sooner (a nearer copy would give the
run a smaller period). Nothing false comes out either, as the distance is that of the next occurrence.

A stretch that occurs once in its document is dropped, with all longer ones that begin there, so few are
left after two or three doublings of ordinary text. Each document is worked on by one task, several
short ones together (``HELD`` bytes); a document takes some 100 bytes of memory for each word.

Defined results: NULL and empty texts have no words; repeated rows get equal results; a NULL id has no
digits, so its text is never rewritten by ``periodic``; an empty table gives an empty table; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import byte_slices, texts

HELD = 2 << 20  # bytes of text that are named together
LEAST = 6  # words in a run
POWER = 4  # periods in a run

SPANS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]
)


def names(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all documents in one row of numbers, and the place of each document's first; a number is of one document."""
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype("i8")
    out, known = np.empty(first[-1], "i8"), 0
    for a, b, doc in zip(first[:-1], first[1:], words, strict=True):
        local: dict[bytes, int] = {}
        out[a:b] = [local.setdefault(w, len(local)) for w in doc]
        out[a:b] += known
        known += len(local)
    return out, first


def proposals(word: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first word, end, period): stretches whose words agree with those one period on, from the names of every power of two."""
    name, at, m = word, np.arange(len(word)), 1
    while len(at):
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        gap = np.zeros(len(word) + 1, "i8")
        step = at[order][1:] - at[order][:-1]
        near = same & (step <= 2 * m)
        gap[at[order][:-1][near]] = step[near]
        here = np.flatnonzero(gap)
        here = here[gap[here + gap[here]] == gap[here]]  # the next occurrence has the same distance to its next
        if len(here):
            cut = np.flatnonzero((np.diff(here) > 1) | (np.diff(gap[here]) != 0)) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(here)] - 1, strict=True):
                q = int(gap[here[a]])
                yield int(here[a]), int(here[b]) + m + q, q
        # Names of twice the length: pairs of names of stretches that occur twice.
        rank = np.empty(len(at), "i8")
        rank[order] = np.r_[0, np.cumsum(~same)]
        full = np.full(len(word) + m, -1, "i8")
        full[at[twice]] = rank[twice]
        at = at[twice]
        at = at[full[at + m] >= 0]
        name = full[at] * (len(word) + 1) + full[at + m]
        m *= 2


def reach(word: np.ndarray, a: int, b: int, q: int, step: int = 256) -> tuple[int, int]:
    """The longest stretch around [a, b) whose words agree with those ``q`` on."""
    size = step
    while a:
        low = max(0, a - size)
        bad = np.flatnonzero(word[low:a] != word[low + q : a + q])
        if len(bad):
            a = low + int(bad[-1]) + 1
            break
        a, size = low, 2 * size
    size = step
    while b < len(word):
        high = min(len(word), b + size)
        bad = np.flatnonzero(word[b:high] != word[b - q : high - q])
        if len(bad):
            b += int(bad[0])
            break
        b, size = high, 2 * size
    return a, b


def find(word: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. ``power`` is 4 or more, for the proposals to be complete."""
    known: dict[int, list[tuple[int, int]]] = {}
    for a, b, q in proposals(word):
        of = known.setdefault(q, [])
        k = bisect_right(of, (a, len(word) + 1))
        if k and of[k - 1][1] >= b:
            continue
        insort(of, reach(word, a, b, q))
    return sorted((a, b - a, q) for q, of in known.items() for a, b in of if b - a >= max(least, power * q))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, "i8")
        for a, n, q in runs:
            gone[a + q] += 1
            gone[a + n] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone[:-1]), strict=True) if not g]
    return b" ".join(words)


def periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a planted period, for one document in ten: a fixed rewriting by the crc32 of its id."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // len(part) + 1))[: n - a]


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, power: int = POWER) -> DataFrame:
    """For every row: its number of words, all runs by start, then period, and the text without repeated periods.

    ``rewrite`` changes the words before the search. A stretch is a run if it has ``least`` words and
    ``power`` periods (4 at least).
    """
    if power < 4:
        raise ValueError("runs of fewer than four periods are not all proposed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, HELD):
            ids = batch.column(0).to_pylist()
            # bytes.split() splits at exactly the six white space characters.
            words = [t.split() for t in texts(batch)]
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
            word, first = names(words)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for a, n, q in find(word, least, power):
                k = int(np.searchsorted(first, a, "right")) - 1
                runs[k].append((a - int(first[k]), n, q))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for r in runs], SCHEMA.field("runs").type),
                    pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string()),
                ],
                schema=SCHEMA,
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, n_words long, runs {SPANS}, collapsed string")


def report(docs: DataFrame) -> DataFrame:
    """Number and digest of the runs of the rewritten texts, the longest run, and the digest of what collapsing leaves."""
    found = periodic_runs(docs, periodic)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def line(run: Column) -> Column:
    return F.concat(F.concat_ws(",", run["start"].cast("string"), run["length"].cast("string"), run["period"].cast("string")), F.lit("\n"))
