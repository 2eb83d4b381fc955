"""Small helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.session import scratch_dir

#: White space of all operators: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document may not be learned from: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def put_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file into the shared folder, whatever store that is on; return its path."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{uuid.uuid4().hex}-{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path.toString()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; NULL as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut batches so that few long texts are held as objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow of a function from one batch to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def byte_slices(batches: Iterator[pa.RecordBatch], most: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of at most ``most`` bytes of text, or one row if that alone is longer."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("i8"))
        at, past = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, past + most, "right")))
            yield batch.slice(at, end - at)
            at, past = end, int(ends[end - 1])


def row_id(doc_id: Column, text: Column) -> Column:
    """The id, or for a NULL id a number from 2**62 on that follows from the text."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62))


def one_of_each(docs: DataFrame, keys: dict[str, Column], stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` that occur in ``stay`` by the keys it has, with all columns; of rows that agree in all keys one.

    The join deals the rows by keys, so picking one of them needs no further shuffle.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_whole"), *[k.alias(n) for n, k in keys.items()])
    kept = whole.join(stay, stay.columns, "left_semi")
    one = kept.groupBy(*keys).agg(F.min_by("_whole", F.xxhash64("_whole.text")).alias("_whole"))
    return one.select(*[F.col("_whole").getField(c).alias(c) for c in docs.columns])
