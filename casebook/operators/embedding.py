"""Text vectors: the injected embedder contract and a deterministic default."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 24
ROWS_OUT = 40 * BATCH
DIMENSIONS = 768

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def hashed_words(dimensions: int = DIMENSIONS) -> Embedder:
    """Hashed bag of words, unit length: texts that share words are similar. Vectors are arrays, which leave a task without a number boxed."""

    buckets: dict[str, int] = {}

    def bucket_of(word: str) -> int:
        if len(buckets) > 100_000:
            buckets.clear()
        if word not in buckets:
            buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:15], 16) % dimensions
        return buckets[word]

    def embed(texts: list[str]) -> list[list[float]]:
        vectors = []
        for text in texts:
            counts: dict[int, int] = {}
            for word in re.findall(r"[a-z0-9][a-z0-9\-]*", text.lower()):
                bucket = bucket_of(word)
                counts[bucket] = counts.get(bucket, 0) + 1
            norm = math.sqrt(sum(v * v for v in counts.values())) or 1.0
            vector = np.zeros(dimensions, np.float32)
            for bucket, count in counts.items():
                vector[bucket] = count / norm
            vectors.append(vector)
        return vectors

    return embed


def with_vectors(
    df: DataFrame, text: str, embedder: Embedder | None = None, dimensions: int = DIMENSIONS, optional: bool = False, packed: bool = False
) -> DataFrame:
    """Add ``vector`` by calling the embedder on batches of 24 texts inside the tasks.

    A reply with the wrong count or length fails the task; with ``optional`` (questions) it leaves the
    vector null, and the search falls back to words. ``packed`` vectors are the bytes of their 32-bit numbers, which are
    written, moved and read as one value; ``matching.nearest`` takes either.
    """
    embed = embedder or hashed_words(dimensions)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # a few hundred rows leave at a time, so vectors never pile up, however many rows an Arrow batch holds
            for first in range(0, len(frame), ROWS_OUT):
                part = frame.iloc[first : first + ROWS_OUT]
                vectors: list[Sequence[float] | bytes | None] = []
                texts = part[text].fillna("").tolist()
                for start in range(0, len(texts), BATCH):
                    batch = texts[start : start + BATCH]
                    try:
                        reply = embed(batch)
                        if len(reply) != len(batch) or any(len(v) != dimensions for v in reply):
                            raise ValueError(f"embedder must return {len(batch)} vectors of {dimensions} numbers")
                    except Exception:
                        if not optional:
                            raise
                        reply = [None] * len(batch)
                    vectors.extend([None if v is None else np.asarray(v, "<f4").tobytes() for v in reply] if packed else reply)
                yield part.assign(vector=vectors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + (", vector binary" if packed else ", vector array<float>")
    return df.mapInPandas(run, schema)


class VectorStore:
    """Vectors by the hash of their text, below ``folder``: a text is embedded once, whichever document, run or question holds it.

    Every run writes a folder of its own with the texts that were new to it; one writer at a time.
    """

    def __init__(self, folder: str, embedder: Embedder | None = None, dimensions: int = DIMENSIONS):
        self.folder, self.embedder, self.dimensions = folder.rstrip("/"), embedder, dimensions

    def stored(self, spark: SparkSession) -> DataFrame:
        place = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        schema = "hash string, vector array<float>"
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.folder}/run-*")

    def attach(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with ``vector``; null texts get none. Copies of a text are combined before they move."""
        spark = rows.sparkSession
        keyed = rows.withColumn("_hash", F.sha2(F.col(text).cast("binary"), 256))
        texts = keyed.filter(F.col(text).isNotNull()).groupBy("_hash").agg(F.any_value(text).alias("_text"))
        known = self.stored(spark).withColumnRenamed("hash", "_hash")
        fresh = texts.join(known, "_hash", "left_anti")
        made = with_vectors(fresh, "_text", self.embedder, self.dimensions).select(F.col("_hash").alias("hash"), "vector")
        made.write.parquet(f"{self.folder}/run-{uuid.uuid4().hex}")
        return keyed.join(self.stored(spark).withColumnRenamed("hash", "_hash"), "_hash", "left").drop("_hash")
