"""Versions of a document index in buckets: an update rewrites the buckets of the documents it touches and shares the rest.

Rows of every part (passages, facts, ...) are dealt by a hash of their document to a fixed number of buckets. A bucket of a part is one
folder, written once and never changed. A version is a manifest: the list of bucket folders that belong to it. Its mark is
made last, by one new directory, so a reader always finds a whole version and an update that failed leaves none.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.plans.index import current_version, mark_published

BUCKETS = 64
MANIFEST = "part string, bucket int, path string, schema string"


def bucket(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class BucketedIndex:
    """An index below ``folder``. The number of buckets is fixed with the first version."""

    folder: str
    buckets: int = BUCKETS

    def version(self, spark: SparkSession) -> str | None:
        return current_version(spark, self.folder)

    def manifest(self, spark: SparkSession, version: str) -> list:
        """The bucket folders of a version: parts times buckets rows at most, whatever the index holds."""
        return spark.read.schema(MANIFEST).json(f"{self.folder}/manifests/{version}").collect()

    def read(self, spark: SparkSession, part: str, version: str | None = None, only: set[int] | None = None) -> DataFrame:
        """A part of a version (the current one), or those of its buckets that are in ``only``."""
        version = version or self.version(spark)
        rows = [r for r in self.manifest(spark, version) if r.part == part]
        if not rows:
            raise ValueError(f"version {version} has no part {part}")
        schema = T.StructType.fromJson(json.loads(rows[0].schema))
        paths = [r.path for r in rows if r.path and (only is None or r.bucket in only)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def update(self, version: str, fresh: dict[str, DataFrame], documents: DataFrame | None = None) -> set[int]:
        """Publish ``version``: the current one without the rows of ``documents`` (doc_id) and with ``fresh`` rows.

        ``fresh`` has every part of the index, each with a ``doc_id``; documents that ``fresh`` brings need not be named. A
        document that is named and brings no rows is gone. Returns the rewritten buckets; the first version writes all.
        """
        spark = next(iter(fresh.values())).sparkSession
        before = self.version(spark)
        held = self.manifest(spark, before) if before else []
        if before and {r.part for r in held} != set(fresh):
            raise ValueError("an update brings every part, and no other")
        touched = [df.select("doc_id") for df in fresh.values()] + ([] if documents is None else [documents.select("doc_id")])
        gone = touched[0]
        for ids in touched[1:]:
            gone = gone.unionByName(ids)
        gone = gone.distinct()
        # At most as many numbers as there are buckets.
        hit = {r[0] for r in gone.select(bucket(F.col("doc_id"), self.buckets)).distinct().collect()}
        rewritten = hit if before else set(range(self.buckets))
        entries = [(r.part, r.bucket, r.path, r.schema) for r in held if r.bucket not in rewritten]
        for part, rows in fresh.items():
            schema = rows.schema
            if before:
                old = self.read(spark, part, before, hit)
                rows = old.join(gone, "doc_id", "left_anti").select(*schema.names).unionByName(rows)
            path = f"{self.folder}/data/{part}/{uuid.uuid4().hex}"
            dealt = rows.withColumn("_bucket", bucket(F.col("doc_id"), self.buckets))
            dealt.repartition("_bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), self._spread(dealt))).write.partitionBy("_bucket").parquet(path)
            made = _folders(spark, path)
            kind = schema.json()
            entries += [(part, b, made.get(b, ""), kind) for b in sorted(rewritten)]
        spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifests/{version}")
        mark_published(spark, self.folder, version)
        return rewritten

    def _spread(self, rows: DataFrame) -> Column:
        """A bucket is written by as many tasks as keeps the cluster busy when there are fewer buckets than cores."""
        return F.lit(max(1, -(-rows.sparkSession.sparkContext.defaultParallelism // self.buckets)))

    def vacuum(self, spark: SparkSession, keep: list[str]) -> int:
        """Remove the folders that no version in ``keep`` lists; how many there were."""
        used = {r.path for v in keep for r in self.manifest(spark, v)}
        gone = 0
        for part in {r.part for v in keep for r in self.manifest(spark, v)}:
            for write in _list(spark, f"{self.folder}/data/{part}"):
                for path in _folders(spark, write).values():
                    if path not in used:
                        _delete(spark, path)
                        gone += 1
        return gone


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _list(spark: SparkSession, path: str) -> list[str]:
    place, files = _files(spark, path)
    return [s.getPath().toString() for s in files.listStatus(place) if s.isDirectory()]


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The bucket folders that a write made, by bucket: a listing of names, as many as buckets."""
    return {int(p.rpartition("_bucket=")[2]): p for p in _list(spark, path) if "_bucket=" in p.rpartition("/")[2]}


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.delete(place, True)
