"""Session settings, and the shared folder for tables that cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tidebars", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, Arrow, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # A plan with all features compiles more classes than the default cache (100) holds.
        "spark.sql.codegen.cache.maxEntries": "4000",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SCOPES: list[str] = []
_OWN: dict[str, str] = {}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all tables that are written inside, removed at the end.

    Write or collect results before leaving: plans that read the tables end with them.
    """
    path = f"{scratch_dir(spark)}/scope-{uuid.uuid4().hex}"
    _SCOPES.append(path)
    try:
        yield path
    finally:
        _SCOPES.remove(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; on a cluster
    it is an error, since executors share no machine-local folder.
    """
    if _SCOPES:
        return _SCOPES[-1]
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # Spark refuses this setting at run time, so the folder is kept here, one for each context.
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidebars-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def tidy(spark: SparkSession) -> None:
    """Have the driver forget the plans of steps that are over.

    Spark removes shuffle files and broadcasts when the driver's objects for them are collected, and a driver with
    memory to spare collects rarely; after a step with many exchanges this frees the disk they took and the plans themselves.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a checkpoint the table is columnar, so the several passes that follow
    read only the columns they need, and a lost executor never recomputes what
    came before.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
