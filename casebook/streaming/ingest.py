"""Incremental indexing and pairing over file streams, and the work-queue tables beside them.

Every micro-batch writes folders named after its batch id and reads only earlier ones, so a batch that is run again after a
failure replaces its own output and nothing is counted twice. What has to be remembered is either a summary
(``hashes``) or Spark's own keyed state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casebook.operators.chunking import CHUNKS, chunk_id, chunk_texts
from casebook.operators.embedding import Embedder, with_vectors
from casebook.sources.files import mark_duplicates
from casebook.streaming.hashes import HashStore

ATTEMPTS = 3
WAITS = "30 days"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def index_stream(
    documents: DataFrame, folder: str, checkpoint: str, embedder: Embedder | None = None, dimensions: int = 768,
    vectors: bool = True, overlap: int | None = None, store: HashStore | None = None,
) -> StreamingQuery:
    """Index arriving documents (doc_id, library, text), leaving out content a library already holds.

    Duplicates are decided against all that was ever indexed, so they are found however late they come; of the past, a
    micro-batch reads the Bloom summaries and the few folders that these name.
    """
    store = store or HashStore(folder)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("sha256", F.sha2(F.encode("text", "utf-8"), 256))
        held = store.candidates(hashed, batch_id)
        fresh = mark_duplicates(hashed, held).filter("NOT duplicate").drop("duplicate")
        store.add(fresh, batch_id)
        kept = spark.read.schema("doc_id bigint").parquet(f"{store.documents}/batch_id={batch_id}").select("doc_id")
        new = batch.join(kept, "doc_id", "left_semi")
        if overlap is not None:
            new = new.withColumn("overlap", F.lit(overlap))
        passages = chunk_texts(new).withColumn("chunk_id", chunk_id())
        if vectors:
            passages = with_vectors(passages, "content", embedder, dimensions)
        _write(passages, f"{folder}/chunks", batch_id)

    return (
        documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_passages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHUNKS + ", chunk_id bigint, vector array<float>").parquet(f"{folder}/chunks")


def pair_stream(turns: DataFrame, folder: str, checkpoint: str, waits: str = WAITS) -> StreamingQuery:
    """Question/answer pairs of arriving turns, which may come in any order.

    A question is a user turn, its answer the assistant turn numbered next. Both are keyed by (thread, number of the question) and
    wait for each other in the state of a stream-stream join: one entry for each open turn, spread by that key, so a
    thread that holds a third of all turns is no hot key, and nothing that was paired before is read again. A turn that
    stays alone for ``waits`` leaves the state.
    """
    arrived = turns.withColumn("_arrived", F.current_timestamp())
    asked = arrived.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.col("_arrived").alias("asked_at"))
    said = arrived.filter("role = 'assistant'").select(
        F.col("conv_id").alias("said_in"), (F.col("turn") - 1).alias("said_after"), F.col("text").alias("answer"), F.col("_arrived").alias("said_at"))
    meet = F.expr(f"""conv_id = said_in AND turn = said_after
        AND said_at BETWEEN asked_at - INTERVAL {waits} AND asked_at + INTERVAL {waits}""")
    pairs = asked.withWatermark("asked_at", "1 hour").join(said.withWatermark("said_at", "1 hour"), meet)

    def run(batch: DataFrame, batch_id: int) -> None:
        _write(batch.select("conv_id", "turn", "question", "answer"), f"{folder}/pairs", batch_id)

    return pairs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after_attempt(queue: DataFrame, failures: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Queue rows after a round: a failed row is tried again until its third attempt, then failed.

    ``queue``: doc_id, status, attempts, last_error - attempts counts the round just run. ``failures``: doc_id, error.
    """
    joined = queue.join(failures.select("doc_id", F.col("error").alias("_error")), "doc_id", "left")
    outcome = F.when(F.col("_error").isNull(), "done").when(F.col("attempts") < attempts, "queued").otherwise("failed")
    return (
        joined.withColumn("status", F.when(F.col("status") == "running", outcome).otherwise(F.col("status")))
        .withColumn("last_error", F.coalesce("_error", "last_error"))
        .drop("_error")
    )


def claimable(queue: DataFrame, now, idle: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Queued rows, and running ones unchanged for an hour."""
    stalled = (F.col("status") == "running") & (F.col("updated_at") < now - F.expr(idle))
    return queue.filter((F.col("status") == "queued") | stalled).withColumn("stalled", F.col("status") == "running")
