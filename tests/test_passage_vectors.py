"""Passages are embedded once a query, and their packed vectors give the same neighbours."""

import numpy as np

from casebook.catalog import search
from casebook.operators import embedding, matching


def test_packed_vectors_are_the_same_numbers(spark):
    rows = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} row {i}" if i % 11 else None) for i in range(200)], "item_id bigint, text string")
    plain, packed = (embedding.with_vectors(rows, "text", packed=p) for p in (False, True))
    one = {r.item_id: np.asarray(r.vector, "<f4").tobytes() for r in plain.collect()}
    assert one == {r.item_id: bytes(r.vector) for r in packed.collect()}
    asked = spark.createDataFrame([(i, f"row {i} of word{i % 7}") for i in range(20)], "question_id bigint, text string")
    questions = embedding.with_vectors(asked, "text")
    near = [{tuple(r) for r in matching.nearest(questions, items, 5, scoped=False).select("question_id", "item_id", "similarity", "rank").collect()} for items in (plain, packed)]
    assert near[0] == near[1] and len(near[0]) == 100


def test_passages_of_a_query_are_embedded_once(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)
    embed = embedding.hashed_words(8)

    def counting(texts):
        asked.add(len(texts))
        return embed(texts)

    monkeypatch.setattr(search, "with_vectors", lambda df, text, **more: embedding.with_vectors(df, text, counting, 8, **more))
    chunks = spark.createDataFrame([(i, f"word{i}") for i in range(30)], "chunk_id bigint, content string")
    vectors = search._vectors(chunks).withColumnRenamed("chunk_id", "item_id")
    questions = embedding.with_vectors(spark.createDataFrame([(1, "word3")], "question_id bigint, text string"), "text", dimensions=8)
    for _ in range(2):
        assert matching.nearest(questions, vectors, 3, scoped=False).count() == 3
    assert asked.value == 30


def test_short_rows_are_read_by_all_cores(spark):
    assert search._spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
