"""Fill-in-the-middle texts, cut at code points found through a learned rank index.

The index maps the rank of a code point (its number) to its offset in the UTF-8 bytes. It is a list of
line segments, each fitted to as many boundaries as one line can follow within ``ERROR`` bytes (the
cone of admissible slopes from the segment's first boundary is narrowed until it is empty), and one
signed byte per boundary, the residual. A cut is predicted by the line of its segment and made exact by
its residual. Texts of one batch (``HELD`` bytes, or one longer text) share an index; boundaries are
held for ``BLOCK`` bytes at a time, so an index needs one byte a code point.

What comes out is ordinary text: ``<P>``prefix``<S>``suffix``<M>``middle (psm), ``<S>``suffix``<P>``prefix
``<M>``middle (spm), or the text as it is (plain). A text that contains a marker stays plain, so
``restored`` can split at the markers.

Defined results: NULL and empty texts give an empty plain text; a NULL id counts as one without digits;
repeated rows get equal results; an empty table gives an empty table; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import byte_slices, texts

HELD = 4 << 20  # bytes of text under one index
BLOCK = 1 << 20  # bytes whose boundaries are held as numbers at once
ERROR = 100  # bytes that a prediction may be off; residuals are signed bytes
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKER = "<[PSM]>"


class RankIndex:
    """Byte offsets of all code points of ``data``, and of its end."""

    def __init__(self, data: bytes, error: int = ERROR, block: int = BLOCK):
        if not 0 < error < 127:
            raise ValueError("residuals are signed bytes")
        self.error = error
        raw = np.frombuffer(data, "u1")
        ranks, offsets, slopes, residuals, n = [], [], [], [], 0
        for low in range(0, len(raw) + 1, block):
            at = np.flatnonzero((raw[low : low + block] & 0xC0) != 0x80) + low
            if low + block > len(raw):
                at = np.append(at, len(raw))
            for a, b, slope in self._segments(at):
                ranks.append(n + a)
                offsets.append(int(at[a]))
                slopes.append(slope)
                residuals.append((at[a:b] - self._line(at[a], slope, np.arange(b - a))).astype("i1"))
            n += len(at)
        self.ranks, self.offsets, self.slopes = np.array(ranks, "i8"), np.array(offsets, "i8"), np.array(slopes, "f8")
        self.residual = np.concatenate(residuals)

    def __len__(self) -> int:
        return len(self.residual) - 1

    @staticmethod
    def _line(offset, slope, steps):
        return offset + np.rint(slope * steps).astype("i8")

    def _segments(self, at: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first, end, slope) of lines that follow ``at`` within the error, each as long as it can be."""
        a, slack = 0, self.error - 1  # one byte is left for rounding
        while a < len(at):
            low, high, b, size = 0.0, np.inf, a + 1, 1024
            while b < len(at):
                steps = np.arange(b - a, min(b + size, len(at)) - a)
                rise = at[b : b + len(steps)] - at[a]
                lows = np.maximum(np.maximum.accumulate((rise - slack) / steps), low)
                highs = np.minimum(np.minimum.accumulate((rise + slack) / steps), high)
                empty = np.flatnonzero(lows > highs)
                k = int(empty[0]) if len(empty) else len(steps)
                if k:
                    low, high = float(lows[k - 1]), float(highs[k - 1])
                b += k
                if k < len(steps):
                    break
                size *= 2
            yield a, b, (low + high) / 2 if high < np.inf else 1.0
            a = b

    def find(self, ranks: np.ndarray) -> np.ndarray:
        """The byte offset of each rank: the line's prediction, put right by the residual."""
        k = np.searchsorted(self.ranks, ranks, "right") - 1
        return self._line(self.offsets[k], self.slopes[k], ranks - self.ranks[k]) + self.residual[ranks]

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """The number of code points before each offset, which must be a boundary: a search among the exact offsets of one segment."""
        k = np.searchsorted(self.offsets, offsets, "right") - 1
        low, high = self.ranks[k].copy(), np.append(self.ranks, len(self) + 1)[k + 1] - 1
        while (low < high).any():
            mid = (low + high + 1) // 2
            right = self.find(mid) <= offsets
            low, high = np.where(right, mid, low), np.where(right, high, mid - 1)
        return low


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers from the sha256 of seed and id."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[k : k + 8], 16) for k in (0, 8, 16, 24)]


def fill_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, error: int = ERROR) -> DataFrame:
    """For every row: n code points, form, lengths of prefix and middle, and the text that comes out.

    Of 100 texts some ``plain_from`` are cut, and ``spm_below`` of 100 that are cut have the suffix first.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, HELD):
            ids, bodies = batch.column(0).to_pylist(), texts(batch)
            index = RankIndex(b"".join(bodies), error)
            start = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype("i8")
            first = index.rank(start)
            n = np.diff(first)
            drawn = np.array([draws(i, seed) for i in ids], "i8")
            cuts = np.sort(drawn[:, :2] % (n[:, None] + 1), axis=1)
            byte = index.find(cuts + first[:-1, None]) - start[:-1, None]
            forms, out = [], []
            for body, (a, b), (h3, h4), chars in zip(bodies, byte.tolist(), drawn[:, 2:].tolist(), n.tolist(), strict=True):
                if not chars or h3 % 100 >= plain_from or PREFIX in body or SUFFIX in body or MIDDLE in body:
                    forms.append("plain")
                    out.append(body)
                elif h4 % 100 < spm_below:
                    forms.append("spm")
                    out.append(b"".join((SUFFIX, body[b:], PREFIX, body[:a], MIDDLE, body[a:b])))
                else:
                    forms.append("psm")
                    out.append(b"".join((PREFIX, body[:a], SUFFIX, body[b:], MIDDLE, body[a:b])))
            plain = np.array([f == "plain" for f in forms])
            lengths = [pa.array(x, pa.int64(), mask=plain) for x in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(forms), *lengths, pa.array(out, pa.binary()).cast(pa.string())], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from which an output was made, put together from the output and its form alone."""
    part = F.split(F.col(output), MARKER)
    return (
        F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
        .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(F.col(output))
    )


def report(docs: DataFrame) -> DataFrame:
    """The lengths and form of every row, with digests of its output and of the text restored from it."""
    out = fill_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
