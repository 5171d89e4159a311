"""Registered queries: each reads whole tables and, where SQL can say the same, carries the SQL to check it.

Stand-in inputs (questions, log rows, documents of a job) are derived from the tables by one SQL text that
Spark and the checking engine both run; the operators under test are written independently on each side.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
INPUTS: dict[str, str] = {}

_PLACE = re.compile(r"\{([a-z]\w+)\}")


# Tables whose rows take real work: long texts, and the rows that texts are built from.
_HEAVY = ("documents", "pages", "lineitem", "part")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as stored; a heavy one that would scan as fewer tasks than there are cores is spread first.

    A Parquet file is split at row groups only, so a small table in one file would keep one core busy.
    A table of many files has tasks enough and is left alone.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _HEAVY and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def given(spark: SparkSession, folder: str, name: str, read: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table, or an input derived from tables; ``read`` holds what this call has opened already."""
    read = {} if read is None else read
    if name not in read:
        if name in TABLES:
            read[name] = table(spark, folder, name)
        else:
            sql = INPUTS[name]
            read[name] = spark.sql(sql, **{n: given(spark, folder, n, read) for n in sorted(set(_PLACE.findall(sql)))})
    return read[name]


def _needed(sql: str, seen: dict[str, None]) -> dict[str, None]:
    for name in _PLACE.findall(sql):
        if name not in TABLES and name not in seen:
            _needed(INPUTS[name], seen)
            seen[name] = None
    return seen


def checked(sql: str) -> str:
    """The oracle with every input it names spelled out as a common table expression."""
    plain = lambda s: _PLACE.sub(r"\1", s)
    names = list(_needed(sql, {}))
    if not names:
        return plain(sql)
    body = ",\n".join(f"{n} AS ({plain(INPUTS[n])})" for n in names)
    text = plain(sql).strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(opening):
            return f"{opening}{body},\n{text[len(opening):]}"
    return f"WITH {body}\n{text}"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may use {table} and {input} places."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = checked(sql)
        return fn

    return keep


def inputs(**texts: str) -> None:
    INPUTS.update(texts)
