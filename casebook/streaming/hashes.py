"""Content hashes of what a stream has indexed, with a Bloom summary beside each stored file (R2).

Each micro-batch stores its hashes by bucket, one folder for each (batch, bucket), and beside them a row of summaries with a Bloom
filter for each folder. A later micro-batch holds its own hashes against the summaries and opens only the folders that may hold
one of them: for new content none, however much was indexed before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 8
BITS = 24  # for each hash; with PROBES this errs some four times in 100,000
PROBES = 8
SUMMARIES = "bucket int, bits binary, batch_id bigint"
STORED = "doc_id bigint, library string, sha256 string, bucket int, batch_id bigint"


def _places(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """The bits of each hash in a filter of ``size`` bits, a row for each hash."""
    one, two = one.view(np.uint64)[:, None], two.view(np.uint64)[:, None] | np.uint64(1)
    return (one + np.arange(PROBES, dtype=np.uint64) * two) % np.uint64(size)


def bloom(one: np.ndarray, two: np.ndarray, bits: int = BITS) -> bytes:
    filled = np.zeros(max(64, -(-len(one) * bits // 8) * 8), bool)
    filled[_places(one, two, len(filled)).ravel().astype(np.int64)] = True
    return np.packbits(filled).tobytes()


def may_hold(stored: bytes, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    filled = np.unpackbits(np.frombuffer(stored, np.uint8))
    return filled[_places(one, two, len(filled)).astype(np.int64)].all(axis=1)


def _hashed(rows: DataFrame) -> DataFrame:
    one, two = F.xxhash64("library", "sha256"), F.xxhash64("sha256", F.lit(1), "library")
    return rows.withColumn("one", one).withColumn("two", two)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class HashStore:
    """Documents (doc_id, library, sha256) below ``folder`` by batch and bucket; ``opened`` counts folders by batch."""

    def __init__(self, folder: str, buckets: int = BUCKETS):
        self.documents, self.summaries, self.buckets = f"{folder}/documents", f"{folder}/summaries", buckets
        self.opened: dict[int, int] = {}

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return _hashed(rows).withColumn("bucket", F.pmod(F.xxhash64("sha256"), F.lit(self.buckets)).cast("int"))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch's documents, then its summaries; a repeated batch replaces both."""
        dealt = self._bucketed(rows.select("doc_id", "library", "sha256"))
        dealt.drop("one", "two").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.documents}/batch_id={batch_id}")

        def summarise(table: pa.Table) -> pa.Table:
            one, two = (table.column(c).to_numpy() for c in ("one", "two"))
            return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([bloom(one, two)], pa.binary())})

        stored = rows.sparkSession.read.schema(STORED).parquet(f"{self.documents}/batch_id={batch_id}")
        hashes = _hashed(stored).select("bucket", "one", "two").distinct()
        hashes.groupBy("bucket").applyInArrow(summarise, "bucket int, bits binary").write.mode("overwrite").parquet(f"{self.summaries}/batch_id={batch_id}")

    def candidates(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """What earlier batches stored in the folders that may hold a hash of ``rows``; all true matches are in it."""
        spark = rows.sparkSession
        none = spark.createDataFrame([], "doc_id bigint, library string, sha256 string")
        if not _exists(spark, self.summaries):
            return none
        # A micro-batch's own hashes, each once, a bucket's share in one row.
        asked = self._bucketed(rows.select("library", "sha256")).groupBy("bucket").agg(F.collect_set(F.struct("one", "two")).alias("pairs"))
        asked = asked.select("bucket", F.col("pairs.one").alias("one"), F.col("pairs.two").alias("two"))
        kept = spark.read.schema(SUMMARIES).parquet(self.summaries).filter(F.col("batch_id") < batch_id)

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    row = batch.slice(i, 1)
                    one, two = (row.column(c).flatten().to_numpy() for c in ("one", "two"))
                    if may_hold(row.column("bits")[0].as_py(), one, two).any():
                        yield row.select(["batch_id", "bucket"])

        pairs = kept.join(asked, "bucket").mapInArrow(hits, "batch_id bigint, bucket int")
        # Names of the folders that are about to be opened.
        paths = [f"{self.documents}/batch_id={r.batch_id}/bucket={r.bucket}" for r in pairs.collect()]
        self.opened[batch_id] = len(paths)
        return spark.read.schema(none.schema).parquet(*paths) if paths else none
