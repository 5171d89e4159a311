"""Streams over files, work-queue tables and job bookkeeping."""

import uuid

from pyspark.sql import functions as F

from casebook.catalog.base import given, inputs, query, table
from casebook.catalog.ingest import _LINES, _rejoined
from casebook.catalog.welding import _ALL_FINDINGS, _job_tables
from casebook.operators import checks as ck
from casebook.session import durable, work_folder
from casebook.streaming import ingest as st

inputs(
    work_queue="""
        SELECT event_id AS doc_id, ts AS updated_at, CAST(floor(value) AS INT) % 5 AS attempts,
          CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, event_type, user_id FROM {events}""",
)


def _folder(spark, name):
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


BATCHES = 3
FILES = 4


def _arriving(spark, sf, name, part):
    """A table as files that arrive one after the other; ``part`` says in which of the deliveries a row comes.

    A delivery is several files, written side by side; the stream takes a delivery at a time.
    """
    rows, folder = table(spark, sf, name), _folder(spark, "arriving")
    for i in range(BATCHES):
        rows.filter(part == i).repartition(FILES).write.mode("append").parquet(folder)
    return st.file_stream(spark, folder, rows.schema, files_per_batch=FILES)


def _indexed(spark, sf):
    folder = _folder(spark, "index")
    docs = _arriving(spark, sf, "documents", F.col("doc_id") % BATCHES).select("doc_id", F.col("source").alias("library"), "text")
    st.index_stream(docs, folder, f"{folder}/checkpoint", vectors=False, overlap=0).awaitTermination()
    return folder


_FIRST_ARRIVED = "SELECT doc_id, source AS library FROM {documents} QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id % 3, doc_id) = 1"


@query("stream_dedup", _FIRST_ARRIVED)
def stream_dedup(spark, sf):
    """Copies are held back within a micro-batch and across them."""
    return spark.read.parquet(f"{_indexed(spark, sf)}/documents").select("doc_id", "library")


@query("stream_index", f"""
    SELECT doc_id, md5(string_agg(line, ' ' ORDER BY ord)) AS content_md5 FROM ({_LINES})
    WHERE doc_id IN (SELECT doc_id FROM ({_FIRST_ARRIVED})) GROUP BY doc_id""")
def stream_index(spark, sf):
    return _rejoined(spark.read.parquet(f"{_indexed(spark, sf)}/chunks")).select("doc_id", "content_md5")


@query("stream_exchanges", """
    SELECT conv_id, turn, md5(text) AS question, md5(next) AS answer FROM (
      SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant'""")
def stream_exchanges(spark, sf):
    """Later turns are delivered first, and the turns of a pair in different deliveries."""
    folder = _folder(spark, "pairs")
    part = F.pmod(F.lit(BATCHES) - F.col("turn"), F.lit(BATCHES))
    st.pair_stream(_arriving(spark, sf, "conversations", part), folder, f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{folder}/pairs")
    return rows.select("conv_id", "turn", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("failure_routing", """
    SELECT doc_id, CASE WHEN status <> 'running' THEN status WHEN user_id > 75 THEN 'done' WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS status,
      CASE WHEN user_id > 75 THEN '' ELSE 'broken ' || event_type END AS last_error FROM {work_queue}""")
def failure_routing(spark, sf):
    queue = given(spark, sf, "work_queue").withColumn("last_error", F.lit(None).cast("string"))
    failures = queue.filter("user_id <= 75").select("doc_id", F.concat(F.lit("broken "), "event_type").alias("error"))
    return st.after_attempt(queue, failures).select("doc_id", "status", F.coalesce("last_error", F.lit("")).alias("last_error"))


@query("stalled_work", """
    SELECT doc_id, status = 'running' AS stalled FROM {work_queue}
    WHERE status = 'queued' OR (status = 'running' AND updated_at < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR)""")
def stalled_work(spark, sf):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return st.claimable(given(spark, sf, "work_queue"), now).select("doc_id", "stalled")


@query("stale_checks", """
    SELECT l_orderkey, l_linenumber, coalesce(l_shipdate > o_orderdate, false) AS stale, count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY ALL""")
def stale_checks(spark, sf):
    rows = given(spark, sf, "lineitem").join(given(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    dated = rows.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("updated_at"), F.col("o_orderdate").alias("checked_at"))
    return dated.groupBy("l_orderkey", "l_linenumber", ck.stale(dated).alias("stale")).agg(F.count(F.lit(1)).alias("n"))


@query("recheck_changed", f"""
    SELECT job_id, id, severity, kind, shown, check_name FROM ({_ALL_FINDINGS}) WHERE job_id IN (SELECT s_suppkey FROM {{supplier}} WHERE s_acctbal > 8000)""")
def recheck_changed(spark, sf):
    """Jobs that changed are checked again in full, the others are not read."""
    changed = given(spark, sf, "supplier").filter("s_acctbal > 8000").select(F.col("s_suppkey").alias("job_id"))
    found = ck.recheck(changed, *_job_tables(spark, sf), durable=durable)
    return found.select("job_id", "id", "severity", "kind", F.size("evidence").alias("shown"), F.col("check").alias("check_name"))
