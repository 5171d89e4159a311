"""Lines that stand in many documents: hashed, counted by distinct document, dropped everywhere but in one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.llm.common import keyed_texts, slices, stored

BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
MIN_DOCS = 2


def line_keys(text: str, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """By position, the 128-bit hash of each line's key, or None where the key is too short to count.

    A key is the line without blanks at both ends, A-Z in lower case and all other letters as they are.
    """
    keys = (line.strip(BLANK) for line in text.encode().lower().decode().split("\n"))
    return [xxhash.xxh3_128_digest(k.encode()) if len(k) >= min_chars else None for k in keys]


def _part(text: Column) -> Column:
    """Tells rows of one doc_id (or of none) apart. Those that share a hash lose the same keys, so a collision changes no result."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def exploded(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, part, key``: each key of a row once; ``part`` is a hash of the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, parts, keys = [], [], []
            for doc, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text")), strict=True):
                own = set(line_keys(text, min_chars)) - {None}
                ids.extend([doc] * len(own))
                parts.extend([part] * len(own))
                keys.extend(own)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "part": pa.array(parts, pa.int64()), "key": pa.array(keys, pa.binary())})

    return keyed_texts(documents).withColumn("part", _part(F.col("text"))).mapInArrow(run, "doc_id long, part long, key binary")


def marked(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, part, keys``: for every doc_id and text that loses lines, the keys it loses.

    Distinct documents are counted in two steps, by (key, document) and then by key, so a line that a third of all
    documents hold is combined before it moves. The repeated keys are written, and the join back is between two
    plain shuffles, which the adaptive skew join can split. A list is at most as long as the lines of one row, however many rows share a doc_id.
    """
    lines = stored(exploded(documents, min_chars), "line-keys")
    holders = lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("n"), F.min("doc_id").alias("first"))
    repeated = stored(holders.filter(F.col("n") >= min_docs).select("key", "first"), "line-repeated")
    losing = lines.join(repeated, "key").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    return stored(losing.groupBy("doc_id", "part").agg(F.collect_set("key").alias("keys")), "line-marked")


def _kept(min_chars: int):
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_dropped", T.LongType())])

    @F.pandas_udf(kind)
    def kept(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out, dropped = [], []
        for text, gone in zip(texts, keys, strict=True):
            if text is None:
                out.append(None)
                dropped.append(0)
                continue
            gone = {bytes(k) for k in gone}
            lines = text.split("\n")
            left = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key not in gone]
            out.append("\n".join(left))
            dropped.append(len(lines) - len(left))
        return pd.DataFrame({"text": out, "n_dropped": dropped})

    return kept


def drop_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, n_lines, n_dropped``: each row as a struct of all its columns with the repeated lines taken out of ``text``.

    A key of ``min_chars`` code points or more that ``min_docs`` documents hold stays in the smallest doc_id only (all
    its lines there), in order of position. Null and empty texts are one empty line and stay as they are; a text all of
    whose lines go becomes empty. Rows of equal doc_id are one document; a null doc_id is a document of its own that
    comes after all others. Further columns ride inside the struct, so their names cannot clash.
    """
    marks = marked(documents, min_chars, min_docs)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _part(F.col("text")).alias("part"), F.struct("*").alias("doc"))
    text: Column = F.col("doc.text").cast("string")
    marks = marks.withColumnsRenamed({"doc_id": "losing", "part": "losing_part"})
    same = F.col("doc_id").eqNullSafe(F.col("losing")) & (F.col("part") == F.col("losing_part"))
    joined = rows.join(marks, same, "left")
    # Texts without a mark do not travel to Python.
    cut = joined.withColumn("kept", _kept(min_chars)(F.when(F.col("keys").isNotNull(), text), F.col("keys")))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return cut.select(
        F.when(F.col("keys").isNull(), F.col("doc")).otherwise(F.col("doc").withField("text", F.col("kept.text"))).alias("doc"),
        (F.coalesce(breaks, F.lit(0)) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.col("kept.n_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digests(documents: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    return drop_lines(documents.select("doc_id", "text")).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("doc.text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )
