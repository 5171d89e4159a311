"""Small tables that hold nulls, empty and long texts, ties, repeated rows and clashing column names."""

from casebook.session import local_session  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    """A documents table of the texts, ids counted from 0 unless given, in several partitions."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clash(df, *names):
    """The same table with further columns of names that an operator uses itself."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df
