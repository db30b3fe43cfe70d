"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.workers import reach as _reach
from quire.workers import shared_dir

#: Bytes of a batch that goes to a Python worker, unless the session says otherwise: Spark's own limit of 10,000 rows is
#: hundreds of MB where texts are long, twice over, once on either side.
BATCH_BYTES = 4 << 20
#: Bytes of text that a Python worker works on at a time, whatever Spark's batch holds.
CHUNK_BYTES = 256 << 10

#: Bytes of a shuffle's input for each of its parts, and a size that means that the optimizer knows none.
PART_BYTES, UNKNOWN_BYTES = 512 << 20, 1 << 55


def reach(spark: SparkSession) -> None:
    """Workers import this package from where the driver has it, and get batches of bounded size."""
    _reach(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs within go when it ends, not when the driver happens to collect its garbage. What
    is written doesn't need them any more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and lost executors cost nothing."""
    reach(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}"
    with passing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """Into how many parts an operator deals out rows made from df: as the session says, but at least one for each
    PART_BYTES that df's files are known to hold."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known_bytes(df) // PART_BYTES))


def known_bytes(df: DataFrame) -> int:
    """Bytes of the files that df is made from, as far as the optimizer knows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < UNKNOWN_BYTES)


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text, a null text as the empty one; whatever else the table has stays behind."""
    reach(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    ends = None
    array = batch.column(column)
    if len(array):
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
        ends = sizes.cumsum()
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
