"""URL rules in a sorted array of digests.

Rules are strings of host and path (``example.com/en/``). Their xxhash64 keys lie in one sorted array
file, the strings behind them in another; every executor gets both files once and maps them into
memory, so all its tasks share the pages. A URL is asked for under each suffix of its host (whole
labels) with each prefix of its path that is as long as some rule's path; one vectorised binary
search answers a batch. A hit counts only if the stored string is equal, so collisions do no harm.

The longest rule that fits wins (ties: longer host); a URL that no rule fits gets ``default``.

Bound: the files grow with the rules, not with the pages; beyond ``most_bytes`` the rules are joined
by key instead, which gives the same rows.

Defined results: NULL URLs and such without ``://`` have an empty host and path and fit no rule; an
empty rule list fits nothing; repeated rows are judged each; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import mmap
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import map_arrow, put_bytes

MOST_BYTES = 64 << 20
RESULT = "page_id long, host string, path string, rule string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """What follows ``://`` of a column ``u``; host and path of a column ``rest``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    host = F.regexp_extract("rest", r"^([^/?#]*)", 1)
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    return rest, F.translate(host, UPPER, LOWER), path


def key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def pack(rules: Iterable[tuple[str, str]]) -> tuple[bytes, bytes]:
    """The two files: keys in ascending order; for each its verdict and string.

    A rule given twice keeps the last verdict.
    """
    items = sorted((key(r.encode()), r.encode(), v.encode()) for r, v in dict(rules).items())
    keys = np.array([k for k, _, _ in items], dtype="<u8").tobytes()
    bodies = [v + b" " + r for _, r, v in items]
    ends = np.cumsum([0] + [len(b) for b in bodies]).astype("<u8")
    return keys, ends.tobytes() + b"".join(bodies)


class DigestArray:
    """Read-only view of the two files."""

    def __init__(self, keys: memoryview | bytes, strings: memoryview | bytes) -> None:
        self.keys = np.frombuffer(keys, dtype="<u8")
        n = len(self.keys)
        self.ends = np.frombuffer(strings, dtype="<u8", count=n + 1)
        self.body = memoryview(strings)[8 * (n + 1) :]
        lengths = {len(self.rule(i).decode().partition("/")[2]) + 1 for i in range(n) if b"/" in self.rule(i)}
        self.path_lengths = sorted(lengths | ({0} if any(b"/" not in self.rule(i) for i in range(n)) else set()))

    def rule(self, i: int) -> bytes:
        return self.entry(i).partition(b" ")[2]

    def entry(self, i: int) -> bytes:
        return bytes(self.body[int(self.ends[i]) : int(self.ends[i + 1])])

    def find(self, wanted: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """(position in ``wanted``, rule, verdict) of every string that is a rule."""
        if not len(self.keys) or not wanted:
            return []
        asked = np.fromiter(map(key, wanted), dtype="<u8", count=len(wanted))
        at = np.searchsorted(self.keys, asked)
        found = []
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == asked):
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == asked[k]:  # a chain of equal keys
                verdict, _, rule = self.entry(i).partition(b" ")
                if rule == wanted[k]:
                    found.append((int(k), rule, verdict))
                i += 1
        return found


@functools.cache
def _mapped(keys: str, strings: str) -> DigestArray:
    def view(name: str) -> memoryview | bytes:
        with open(SparkFiles.get(name), "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    return DigestArray(view(keys), view(strings))


def candidates(host: str, path: str, lengths: Iterable[int]) -> list[tuple[int, bytes]]:
    """(length of the host's suffix, string) for all rules that could fit."""
    out, prefixes = [], [path[:n] for n in lengths if n <= len(path)]
    while host:
        out += [(len(host), (host + p).encode()) for p in prefixes]
        host = host.partition(".")[2]
    return out


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each page: host, path, the rule that decides and its verdict."""
    rules = dict(rules)
    rest, host, path = host_and_path(F.col("u"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("u")).select("page_id", rest.alias("rest")).select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys, strings = pack(rules.items())
    if len(keys) + len(strings) > most_bytes:
        return _judge_by_join(split, rules, default)
    spark = pages.sparkSession
    names = []
    for name, data in (("keys", keys), ("strings", strings)):
        at = put_bytes(spark, name, data)
        spark.sparkContext.addFile(at)
        names.append(at.rpartition("/")[2])

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        array = _mapped(*names)
        # A host has no slash, and a path that is not empty starts with one.
        pairs = pc.binary_join_element_wise(batch.column(1), batch.column(2), "").dictionary_encode()
        asked, owner, host_len = [], [], []
        for k, pair in enumerate(pairs.dictionary.to_pylist()):
            host, slash, rest = pair.partition("/")
            for n, text in candidates(host, slash + rest, array.path_lengths):
                asked.append(text)
                owner.append(k)
                host_len.append(n)
        best: dict[int, tuple] = {}
        for k, rule, verdict in array.find(asked):
            best[owner[k]] = max(best.get(owner[k], (0,)), (len(rule.decode()), host_len[k], rule, verdict))
        n = len(pairs.dictionary)
        rule = pa.array([best[k][2].decode() if k in best else None for k in range(n)], pa.string())
        verdict = pa.array([best[k][3].decode() if k in best else default for k in range(n)], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, rule.take(pairs.indices), verdict.take(pairs.indices)], names=["page_id", "host", "path", "rule", "verdict"])

    return map_arrow(split, probe, RESULT)


def _judge_by_join(split: DataFrame, rules: dict[str, str], default: str) -> DataFrame:
    """For rule lists beyond the bound: a join of every possible string with the rules."""
    spark = split.sparkSession
    table = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    lengths = sorted({len(r.partition("/")[2]) + 1 if "/" in r else 0 for r in rules})
    labels = F.split("host", r"\.")
    asked = (
        split.select("host", "path").distinct().select("host", "path", F.posexplode(labels).alias("k", "label"))
        .withColumn("suffix", F.expr("array_join(slice(split(host, '[.]'), k + 1, size(split(host, '[.]'))), '.')"))
        .withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where("n <= length(path) and suffix <> ''")
        .withColumn("rule", F.expr("concat(suffix, substring(path, 1, n))"))
    )
    best = asked.join(table, "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("suffix"))).alias("b"))
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
