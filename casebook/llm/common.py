"""What several operators share: stored intermediate tables, bounded slices of Arrow batches, safe column access."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.session import work_folder

SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that every executor reaches."""
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, Spark removes a query's shuffle files as soon as the query has ended, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: lineage ends, later joins see real sizes, and the shuffle files behind it go."""
    return stored_path(df, name)[0]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``stored``, and the folder, for tables that are removed before the job ends."""
    path = shared_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def give_back() -> None:
    """At the end of a task: return this Python worker's freed memory to the machine, since workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def keyed_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text (null: empty), under fixed names: other columns cannot clash with an operator's own."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose ``column`` holds about ``most`` bytes, so long texts never pile up."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < len(sizes):
            yield batch.slice(start)
