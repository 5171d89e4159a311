"""The corpus pipeline: toxic documents go, then repeated lines, near duplicates and repeated passages; the rest is packed.

Each stage is one operator of ``casebook.llm`` over all that the stage before kept, written as Parquet in the shared folder and
reread. All but the last return the columns of documents, with ``n_chars`` following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import lines, packing, simhash, spans, toxicity
from casebook.llm.common import shared_folder


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, the length counted again where there is such a column."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects."""
    return toxicity.harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first of them only."""
    return _measured(lines.drop_lines(docs).select("doc.*"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest doc_id."""
    return simhash.first_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without bytes that a string of 50 shares with a document of smaller doc_id."""
    return _measured(spans.remove_repeats(docs).select("doc.*"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", harmless), ("lines", line_dedup), ("simhash", near_dedup), ("suffix", passage_dedup), ("packing", packed)]

# No SQL states a trained classifier or the packing; each stage is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
