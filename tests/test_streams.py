"""Streams end in the same tables as one batch, also when files arrive over several runs."""

import numpy as np
from pyspark.sql import functions as F

from casebook.operators.chunking import chunk_texts
from casebook.plans.conversations import exchanges
from casebook.sources.files import mark_duplicates
from casebook.streaming import hashes
from casebook.streaming import ingest as st


def put(df, folder, n):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/part{n}")


def test_index_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, "a" if i % 2 else "b", "same words" if i % 3 == 0 else f"text number {i}\nline two") for i in range(40)],
        "doc_id bigint, library string, text string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, low in enumerate((0, 15, 30)):
        put(docs.filter(F.col("doc_id").between(low, low + 14)), source, n)
        stream = st.file_stream(spark, f"{source}/part*", docs.schema, files_per_batch=1)
        st.index_stream(stream, out, str(tmp_path / "cp"), dimensions=8).awaitTermination()
    hashed = docs.withColumn("sha256", F.sha2(F.encode("text", "utf-8"), 256))
    kept = docs.join(mark_duplicates(hashed).filter("NOT duplicate").select("doc_id"), "doc_id", "left_semi")
    want = sorted((r.doc_id, r.chunk_index, r.content) for r in chunk_texts(kept).collect())
    got = st.read_passages(spark, out)
    assert sorted((r.doc_id, r.chunk_index, r.content) for r in got.collect()) == want
    assert got.filter(F.size("vector") != 8).count() == 0


def test_pairs_meet_across_batches(spark, tmp_path):
    roles = ["user", "assistant", "user", "user", "assistant", "assistant", "user", "assistant"]
    turns = spark.createDataFrame([(c, t, r, f"{c}-{t}") for c in (1, 2) for t, r in enumerate(roles)], st.TURNS)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, (low, high) in enumerate(((0, 2), (3, 3), (4, 7))):
        put(turns.filter(F.col("turn").between(low, high)), source, n)
        st.pair_stream(st.file_stream(spark, f"{source}/part*", turns.schema), out, str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted((r.conv_id, r.turn, r.answer) for r in df.collect())
    assert key(spark.read.parquet(f"{out}/pairs")) == key(exchanges(turns)) and exchanges(turns).count() == 6


def test_pairs_meet_in_any_order(spark, tmp_path):
    """Answers arrive runs before their questions, threads are mixed, and the stream is restarted in between."""
    roles = ["user", "assistant", "system", "user", "user", "assistant", "assistant", "user", "assistant"]
    turns = spark.createDataFrame([(c, t, r, f"{c}-{t}") for c in (1, 2, 3) for t, r in enumerate(roles)], st.TURNS)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rest in enumerate((2, 1, 0)):
        put(turns.filter((F.col("turn") + F.col("conv_id")) % 3 == rest), source, n)
        st.pair_stream(st.file_stream(spark, f"{source}/part*", turns.schema, files_per_batch=1), out, str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted((r.conv_id, r.turn, r.question, r.answer) for r in df.collect())
    assert key(spark.read.parquet(f"{out}/pairs")) == key(exchanges(turns)) and exchanges(turns).count() == 9


def test_summaries_name_the_folders_to_open(spark, tmp_path):
    """New content opens nothing, however many batches came before; a copy opens the folder that holds it."""
    store = hashes.HashStore(str(tmp_path / "store"), buckets=4)

    def batch(ids):
        rows = spark.createDataFrame([(i, f"l{i % 2}", f"text {i}") for i in ids], "doc_id bigint, library string, text string")
        return rows.withColumn("sha256", F.sha2(F.encode("text", "utf-8"), 256))

    for n in range(6):
        new = batch(range(50 * n, 50 * n + 50))
        assert store.candidates(new, n).count() == 0
        store.add(new, n)
    assert [store.opened.get(n, 0) for n in range(6)] == [0] * 6
    held = store.candidates(batch([60, 1000]), 6)
    assert 60 in {r.doc_id for r in held.collect()} and store.opened[6] == 1
    # a batch that runs again does not see itself, nor later ones
    assert store.candidates(batch([60]), 1).count() == 0
    store.add(batch(range(50, 100)), 1)
    assert spark.read.parquet(store.documents).count() == 300


def test_bloom_holds_what_was_put_in():
    rng = np.random.default_rng(0)
    one, two, other = (rng.integers(-(2**62), 2**62, 5000) for _ in range(3))
    stored = hashes.bloom(one, two)
    assert hashes.may_hold(stored, one, two).all() and hashes.may_hold(stored, other, two).sum() < 5


def test_third_failure_is_final(spark):
    queue = spark.createDataFrame([(1, "running", 1, None), (2, "running", 3, "old"), (3, "running", 2, None), (4, "queued", 0, None)],
                                  "doc_id bigint, status string, attempts int, last_error string")
    failures = spark.createDataFrame([(1, "x" * 2000), (2, "boom")], "doc_id bigint, error string")
    got = {r.doc_id: (r.status, r.last_error and len(r.last_error)) for r in st.after_attempt(queue, failures).collect()}
    assert got == {1: ("queued", 2000), 2: ("failed", 4), 3: ("done", None), 4: ("queued", None)}
