"""Exact deduplication with an extendible-hash index on shared files.

The index maps a 64-bit key of the normalised text to entries (digest, first document, count). Its
directory has 2**depth slots for the top bits of a key; an overfull bucket is split by its next bit,
and the directory doubles when a bucket already uses all its bits. So a bucket is a range of keys.
Directory and buckets lie in the shared folder.

Copies within a task are folded before the shuffle, so a text that a third of all rows share sends one
row for each task and ``HELD`` bytes. The owner of a bucket reads its rows in key order and chains
texts of equal key, comparing bytes; it holds only the different texts of one key.

Defined results: NULL counts as empty, and empty texts are copies of each other; a row with a NULL id
stays only if no copy has an id; rows that repeat an id and text get the same verdict, and
``deduplicated`` keeps one of them; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import SPACE, one_of_each, slices
from tidebars.session import materialize, scratch_dir

CAPACITY = 1024  # keys in a bucket
MOST_BITS = 20  # of the directory; beyond, buckets only grow
LAST = 2**63 - 1  # stands for a NULL id
HELD = 64 << 20  # bytes of different texts that a task folds at once


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


@dataclass
class Directory:
    depth: int = 0
    slots: list[int] = field(default_factory=lambda: [0])
    buckets: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])  # (prefix, its bits)

    def split(self, k: int) -> int:
        """Split bucket ``k`` by one more bit, doubling the directory if it needs that bit."""
        prefix, bits = self.buckets[k]
        if bits == self.depth:
            self.slots = [b for b in self.slots for _ in range(2)]
            self.depth += 1
        self.buckets[k] = (2 * prefix, bits + 1)
        self.buckets.append((2 * prefix + 1, bits + 1))
        new, wide = len(self.buckets) - 1, self.depth - bits - 1
        for s in range((2 * prefix + 1) << wide, (2 * prefix + 2) << wide):
            self.slots[s] = new
        return new

    @staticmethod
    def grown(counts: np.ndarray, capacity: int) -> Directory:
        """For counts of keys by their top bits (2**n of them)."""
        bits, sums, d = len(counts).bit_length() - 1, np.concatenate([[0], np.cumsum(counts)]), Directory()
        full = [0]
        while full:
            k = full.pop()
            prefix, used = d.buckets[k]
            here = sums[(prefix + 1) << (bits - used)] - sums[prefix << (bits - used)]
            if here > capacity and used < bits:
                full += [k, d.split(k)]
        return d

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        top = keys.astype("u8") >> np.uint64(64 - self.depth) if self.depth else np.zeros(len(keys), "u8")
        return np.asarray(self.slots, "i4")[top.astype("i8")]


def directory(slots: DataFrame, capacity: int = CAPACITY) -> Directory:
    """From the number of different keys under each prefix: at most 2**MOST_BITS rows reach the driver."""
    bits = min(MOST_BITS, max(1, (slots.count() // capacity).bit_length() + 3))
    found = slots.select("h").distinct().groupBy(F.shiftrightunsigned("h", 64 - bits).alias("p")).count().collect()
    counts = np.zeros(2**bits, "i8")
    for row in found:
        counts[row["p"]] = row["count"]
    return Directory.grown(counts, capacity)


def build_index(docs: DataFrame, slots: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Write the index under ``path``; return its entries (bucket, h, sha, keep_id, group_size)."""
    spark = docs.sparkSession
    grown = directory(slots, capacity)
    spark.createDataFrame([(s, b, grown.depth) for s, b in enumerate(grown.slots)], "slot long, bucket int, depth int").coalesce(1).write.parquet(f"{path}/directory")
    shared = spark.sparkContext.broadcast(grown)  # at most 2**MOST_BITS slots

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            items = sorted(held.items(), key=lambda x: x[1][0])
            for at in range(0, len(items), 1024):
                some = items[at : at + 1024]
                keys = np.array([v[0] for _, v in some], "i8")
                yield pa.RecordBatch.from_pydict(
                    {"bucket": shared.value.bucket(keys), "h": keys, "body": [k for k, _ in some], "first": [v[1] for _, v in some], "n": [v[2] for _, v in some]}, schema=FOLDED
                )

        for batch in slices(batches):
            ids, keys, bodies = (batch.column(k).to_pylist() for k in range(3))
            for doc, h, body in zip(ids, keys, bodies, strict=True):
                entry = held.get(body)
                if entry is None:
                    held[body] = [h, doc, 1]
                    size += len(body) + 200
                else:
                    entry[1] = doc if entry[1] is None else entry[1] if doc is None else min(doc, entry[1])
                    entry[2] += 1
            if size > HELD:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain, bucket = None, [], 0  # chain: [text, first document, count] of each different text of the key

        def entries() -> list[tuple]:
            return [(bucket, key, hashlib.sha256(body).digest(), first, n) for body, first, n in chain]

        for batch in slices(batches):
            out = []
            for b, h, body, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != key:
                    out += entries()
                    key, chain, bucket = h, [], b
                for entry in chain:
                    if entry[0] == body:
                        entry[1] = first if entry[1] is None else entry[1] if first is None else min(first, entry[1])
                        entry[2] += n
                        break
                else:
                    chain.append([body, first, n])
            yield table(out)
        yield table(entries())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(ENTRY.names, r, strict=True)) for r in rows], schema=ENTRY)

    FOLDED = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("body", pa.binary()), ("first", pa.int64()), ("n", pa.int64())])
    ENTRY = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("body"))
    body = body.select("doc_id", F.xxhash64("body").alias("h"), F.col("body").cast("binary").alias("body"))
    folded = body.mapInArrow(fold, "bucket int, h long, body binary, first long, n long")
    owned = folded.repartition("bucket").sortWithinPartitions("bucket", "h")
    entries = owned.mapInArrow(own, "bucket int, h long, sha binary, keep_id long, group_size long")
    entries.write.parquet(f"{path}/buckets")
    return spark.read.schema(entries.schema).parquet(f"{path}/buckets")


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """For every row: the copy that stays, the number of copies, whether it is the one, and the digest."""
    path = f"{scratch_dir(docs.sparkSession)}/extendible-{uuid.uuid4().hex}"
    slots = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("body")).select(
            "doc_id", F.xxhash64("body").alias("h"), F.unhex(F.sha2("body", 256)).alias("sha")
        )
    )
    entries = build_index(docs, slots, path, capacity).select("h", "sha", "keep_id", "group_size")
    # Copies of one text are one key: the adaptive join splits its side, the entry is one row.
    joined = slots.join(entries, ["h", "sha"], "left")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the smallest id; of rows that repeat an id and text, one."""
    sha = F.unhex(F.sha2(normalised(), 256))
    stay = groups(docs).where("kept").select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.unhex("text_sha256").alias("_sha")).distinct()
    return one_of_each(docs, {"_id": F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), "_sha": sha}, stay)
