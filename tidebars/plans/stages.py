"""Stages of a long run as tables that a later run can pick up.

A folder holds one table per stage and a manifest, itself a table, with a row for every stage that ended:
stage, fingerprint, path, rows, when. A stage's fingerprint covers its arguments, those of all stages before it, and the
content of the input, so a run takes a table over only if it would write the same one. A stage
that was cut short has no row and is written anew.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions.columns import c

MANIFEST = "stage string, fingerprint string, path string, n_rows long, ended timestamp"


def content(df: DataFrame) -> str:
    """A fingerprint of schema and rows, whatever the order of the rows: their number and two sums of hashes, in one pass."""
    row = F.struct(*[c(n) for n in df.columns])
    halves = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    found = df.agg(F.count(F.lit(1)).alias("n"), *halves).first()
    schema = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return json.dumps([schema, found["n"], str(found["h1"]), str(found["h2"])])


class Stages:
    """Tables under ``folder``; ``read`` lists the stages that were taken over, ``written`` those that ran."""

    def __init__(self, spark: SparkSession, folder: str, source: str):
        self.spark, self.folder, self.print = spark, folder, source
        self.read: list[str] = []
        self.written: list[str] = []
        self.known = {r["fingerprint"]: r["path"] for r in self.manifest().collect()}  # one row per stage and run

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def manifest(self) -> DataFrame:
        path = f"{self.folder}/manifest"
        if not self._exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(path)

    def table(self, stage: str, build: Callable[[], DataFrame], **arguments) -> DataFrame:
        """The table of a stage: read if an earlier run ended it, else built and written."""
        told = json.dumps([self.print, stage, arguments], sort_keys=True, default=str)
        self.print = hashlib.sha256(told.encode()).hexdigest()
        path = self.known.get(self.print)
        if path and self._exists(f"{path}/_SUCCESS"):
            self.read.append(stage)
            return self.spark.read.parquet(path)
        path = os.path.join(self.folder, f"{stage}-{self.print[:16]}")
        df = build()
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        row = [(stage, self.print, path, out.count(), datetime.now(timezone.utc))]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.known[self.print] = path
        self.written.append(stage)
        return out
