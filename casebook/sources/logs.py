"""Quoted rows of log files, read by many tasks a file.

A cell may hold line breaks, so whether a line begins a row depends on all quotes before it. Every split of a file therefore says
first in what state it ends and how many rows begin in it, for either state it may be entered in; these few numbers are
chained split by split, and then all splits are read in parallel, each knowing how it begins.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.session import work_folder


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind ``line``; a quote opens one only where a cell begins."""
    if '"' not in line:
        return inside
    at, fresh = 0, not inside
    while at < len(line):
        if inside:
            end = line.find('"', at)
            if end < 0:
                return True
            if line[end + 1 : end + 2] == '"':
                at = end + 2
            else:
                inside, fresh, at = False, False, end + 1
        elif fresh and line[at] == '"':
            inside, at = True, at + 1
        else:
            comma = at if line[at] == "," else line.find(",", at)
            if comma < 0:
                return False
            fresh, at = True, comma + 1
    return inside


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("line"),
    )


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: the state behind it and the rows begun in it, if entered outside and if entered inside a cell."""
    place, states, begun, out = None, [False, True], [0, 0], []
    for batch in batches:
        for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line")), strict=True):
            if (file, block) != place:
                out += [(*place, *states, *begun)] if place else []
                place, states, begun = (file, block), [False, True], [0, 0]
            text = line.decode(errors="replace")
            begun = [n + (not s) for n, s in zip(begun, states, strict=True)]
            states = [inside_after(text, s) for s in states]
    out += [(*place, *states, *begun)] if place else []
    names = ["file", "block", "after_outside", "after_inside", "begun_outside", "begun_inside"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def _chained(table: pa.Table) -> pa.Table:
    """The splits of one file in order, each with the state it is entered in and the rows begun before it."""
    inside, before, out = False, 0, []
    for row in sorted(table.to_pylist(), key=lambda r: r["block"]):
        out.append((row["file"], row["block"], inside, before))
        way = "inside" if inside else "outside"
        inside, before = row[f"after_{way}"], before + row[f"begun_{way}"]
    return pa.table([pa.array(c) for c in zip(*out, strict=True)], ["file", "block", "inside", "before"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line with the number of its row; lines of a split come in order."""
    place, inside, row = None, False, 0
    for batch in batches:
        numbers = []
        columns = (batch.column(c).to_pylist() for c in ("file", "block", "line", "inside", "before"))
        for file, block, line, entered, before in zip(*columns, strict=True):
            if (file, block) != place:
                place, inside, row = (file, block), entered, before
            row += not inside
            inside = inside_after(line.decode(errors="replace"), inside)
            numbers.append(row)
        kept = [batch.column(c) for c in ("file", "block", "id", "line")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32())], ["file", "block", "id", "line", "row"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = []
        for text in batch.column("text").to_pylist():
            found = list(csv.reader(io.StringIO(text.decode(errors="replace").removesuffix("\r"))))
            cells.append(found[0] if found else [])
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), pa.array(cells, pa.list_(pa.string()))], ["file", "row", "cells"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Weld-log CSV rows as (file, row, cells); quoted line breaks stay inside a cell, empty lines count as rows without cells.

    A file is read by as many tasks as it has splits. What is chained is one row for each split.
    """
    lines = _lines(spark, path)
    states = lines.mapInArrow(_states, "file string, block bigint, after_outside boolean, after_inside boolean, begun_outside bigint, begun_inside bigint")
    entries = states.groupBy("file").applyInArrow(_chained, "file string, block bigint, inside boolean, before bigint")
    # written, so that the join knows how small it is
    folder = f"{work_folder(spark).rstrip('/')}/splits-{uuid.uuid4().hex}"
    entries.write.parquet(folder)
    entered = lines.join(spark.read.parquet(folder), ["file", "block"]).sortWithinPartitions("file", "block", "id")
    numbered = entered.mapInArrow(_numbered, "file string, block bigint, id bigint, line binary, row int")
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "line")))
    joined = F.aggregate(F.slice(parts, 2, F.size(parts)), parts[0]["line"], lambda text, p: F.concat(text, F.lit(b"\n"), p["line"]))
    rows = numbered.groupBy("file", "row").agg(joined.alias("text"))
    return rows.mapInArrow(_parsed, "file string, row int, cells array<string>")
