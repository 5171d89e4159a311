"""Extracted fields kept by content and reader version (S20, P7): a document is read again only when one of the two changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.session import durable

KEY = ["sha256", "doc_type"]
DONE = "sha256 string, doc_type string, run string"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def extracted(documents: DataFrame, extract: Callable[[DataFrame], DataFrame], folder: str, version: str) -> DataFrame:
    """The fields of all documents, of which only those unknown to the cache are read.

    ``documents``: doc_id, doc_type, sha256. ``extract`` takes doc_id and doc_type of some documents and returns their rows,
    keyed by doc_id. Documents of equal content and type are read once. A run's fields count when the run is listed as done,
    which is written last: a run that failed in between leaves nothing behind that is read.
    """
    spark, place, run = documents.sparkSession, f"{folder.rstrip('/')}/reader={version}", uuid.uuid4().hex
    known = _read(spark, f"{place}/done", DONE)
    missing = documents.groupBy(*KEY).agg(F.min("doc_id").alias("doc_id")).join(known, KEY, "left_anti")
    missing = durable(missing)  # read twice, and the cache grows in between
    found = extract(missing.select("doc_id", "doc_type")).drop("doc_type")
    columns = [c for c in found.columns if c != "doc_id"]
    kept = found.join(missing, "doc_id").select(*KEY, *columns, F.lit(run).alias("run"))
    kept.write.mode("append").parquet(f"{place}/fields")
    missing.select(*KEY, F.lit(run).alias("run")).write.mode("append").parquet(f"{place}/done")
    held = spark.read.schema(kept.schema).parquet(f"{place}/fields").join(_read(spark, f"{place}/done", DONE), [*KEY, "run"], "left_semi")
    return documents.select("doc_id", *KEY).join(held, KEY).select("doc_id", "doc_type", *columns)
