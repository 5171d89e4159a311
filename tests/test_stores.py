"""Vectors and extracted fields are made once for each content."""

from pyspark.sql import functions as F

from casebook.operators.embedding import VectorStore, hashed_words
from casebook.plans.extraction import extracted


def test_each_text_is_embedded_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    embed = hashed_words(8)

    def counting(texts):
        seen.add(len(texts))
        return embed(texts)

    store = VectorStore(str(tmp_path / "vectors"), counting, 8)
    rows = spark.createDataFrame([(i, f"text {i % 10}") for i in range(60)] + [(99, None)], "id int, content string")
    first = store.attach(rows, "content")
    assert first.count() == 61 and seen.value == 10 and first.filter("vector IS NULL").count() == 1
    more = rows.unionByName(spark.createDataFrame([(100, "text 3"), (101, "new"), (102, "new")], "id int, content string"))
    got = {r.id: r.vector for r in store.attach(more, "content").collect()}
    assert seen.value == 11 and len(got) == 64 and got[101] == got[102]
    assert [round(x, 5) for x in got[3]] == [round(x, 5) for x in embed(["text 3"])[0]]


def test_only_new_content_is_extracted(spark, tmp_path):
    asked = []

    def documents(rows):
        return spark.createDataFrame(rows, "doc_id bigint, doc_type string, sha256 string")

    def extract(some):
        asked.append(sorted(r.doc_id for r in some.collect()))
        return some.filter("doc_id <> 3").select("doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("key"), F.col("doc_type").alias("value"))

    folder = str(tmp_path / "cache")
    key = lambda df: sorted((r.doc_id, r.key, r.value) for r in df.collect())
    one = documents([(1, "wps", "x"), (2, "wps", "x"), (3, "wps", "empty"), (4, "pqr", "x")])
    want = [(d, k, t) for d, t in ((1, "wps"), (2, "wps"), (4, "pqr")) for k in "ab"]
    assert key(extracted(one, extract, folder, "1")) == want and asked == [[1, 3, 4]]
    two = documents([(1, "wps", "changed"), (2, "wps", "x"), (3, "wps", "empty"), (4, "pqr", "x")])
    assert key(extracted(two, extract, folder, "1")) == want and asked[1:] == [[1]]
    # another version of the reader reads everything again
    assert key(extracted(two, extract, folder, "2")) == want and asked[2:] == [[1, 2, 3, 4]]
    # fields of a run that was never listed as done are not read
    part = spark.read.parquet(f"{folder}/reader=1/fields").withColumn("run", F.lit("failed"))
    part.write.mode("append").parquet(f"{folder}/reader=1/fields")
    assert key(extracted(two, extract, folder, "1")) == want
