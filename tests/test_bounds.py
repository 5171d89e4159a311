"""What a task holds and what a join copies stays bounded, whatever the size of the input."""

import datetime
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.functions import parsing as ps
from casebook.operators import checks, chunking, embedding, matching
from casebook.plans import lexical
from casebook.session import durable, joined_in_place
from casebook.sources import blocks


@pytest.fixture()
def task(spark, monkeypatch):
    """The function that a step would run in its tasks, by the name of the DataFrame method that takes it."""

    def caught(method, step, *args):
        kept = []
        monkeypatch.setattr(type(spark.range(0)), method, lambda self, fn, schema: kept.append(fn))
        step(*args)
        return kept[0]

    return caught


def test_vectors_leave_in_parts(spark, task):
    rows = spark.createDataFrame([("a",)], "t string")
    run = task("mapInPandas", embedding.with_vectors, rows, "t")
    sizes = [len(f) for f in run(iter([pd.DataFrame({"t": ["w"] * 3000})]))]
    assert sum(sizes) == 3000 and max(sizes) <= embedding.ROWS_OUT


def test_passages_leave_in_parts(spark, task):
    run = task("mapInArrow", chunking.chunk_texts, spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    lines = ["word " * 50] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([lines] * 1000), pa.array([60] * 1000, pa.int32())], ["doc_id", "lines", "overlap"])
    out = list(run(iter([batch])))
    assert len(out) > 5 and max(b.nbytes for b in out) < 2 * chunking.CHARS_OUT
    assert len(set(pa.concat_arrays([b.column("doc_id") for b in out]).to_pylist())) == 1000


def test_html_blocks_leave_in_parts(spark, task):
    run = task("mapInArrow", blocks.html, spark.createDataFrame([(1, "a")], "page_id bigint, html string"))
    batch = pa.RecordBatch.from_arrays([pa.array([*range(499), None]), pa.array(["<p>" + "word " * 3000 + "</p>"] * 499 + [None])], ["page_id", "html"])
    out = list(run(iter([batch])))
    assert len(out) > 5 and sum(len(b) for b in out) == 499


def test_segments_are_told_apart_without_a_call_for_each(spark):
    run = chunking._by_segment(lambda doc, seg, rows: [(doc, seg, len(rows))], lambda out: pa.RecordBatch.from_pylist([{"r": str(r)} for r in out]), lambda row: 8)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [1] * 1500, "seg": [0] * 1300 + [1] * 200, "n": list(range(1500))}),
               pa.RecordBatch.from_pydict({"doc_id": [1, 2], "seg": [1, 1], "n": [1500, 1]})]
    assert [r for b in run(iter(batches)) for r in b.column("r").to_pylist()] == ["(1, 0, 1300)", "(1, 1, 201)", "(2, 1, 1)"]


def test_a_shard_of_the_lexical_index_is_small():
    assert lexical.SHARD_ITEMS <= 4096


def test_copies_in_the_grid_grow_with_large_blocks_only(spark):
    questions = spark.range(20_000).select(F.col("id").alias("q"))
    items = spark.range(3).select(F.col("id").alias("i"))
    left, right = matching._grid(questions, items, "q", "i", False)
    assert left.count() == 20_000 and right.count() == 3 * matching.LEAST_BLOCKS


def test_training_rows_never_stand_side_by_side():
    from casebook.llm.features import Rows

    rng = np.random.default_rng(1)
    groups = [[rng.integers(0, 1 << 20, 4000).astype(np.int32) for _ in range(2000)] for _ in range(2)]
    tracemalloc.start()
    Rows(*groups, 20, 2000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # the rows as 64-bit numbers are 128 MB


def test_only_header_like_rows_of_a_log_are_mapped(spark):
    from casebook.operators import fields

    rows = spark.createDataFrame([(1, 1, ["Welder", "WPS no"]), (1, 2, ["W-1", "WPS-1"]), (1, 3, ["the welder", None])], "doc_id int, row int, cells array<string>")
    assert [r.row for r in rows.filter(fields._may_be_header(F.col("cells"))).collect()] == [1]
    log, errors = fields.weld_log(rows)
    assert [(r.row, r.welder, r.wps) for r in log.orderBy("row").collect()][:1] == [(2, "W-1", "WPS-1")] and errors.count() == 0


def test_what_a_report_does_not_show_does_not_travel(spark):
    from casebook.operators import checks

    found = spark.createDataFrame([(1, "a", "long", 1), (1, "a", "longer", 2)], "job_id int, id string, evidence string, seq bigint")
    assert [tuple(r) for r in checks.unique(found).collect()] == [(1, "a", "longer")]
    plan = checks.unique(found).select("job_id", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "evidence" not in plan.split("LogicalRDD")[0]


def _numbered_log(spark, rows):
    """Log rows numbered by job, as the registered log is, with one procedure and one welder's record for each job."""
    from pyspark.sql import Window

    lines = spark.createDataFrame(rows, "job_id bigint, joint string, welder string, wps string, day date, thickness double").repartition("job_id")
    row = F.row_number().over(Window.partitionBy("job_id").orderBy("joint"))
    none = F.array().cast("array<string>")
    log = lines.select("job_id", (F.col("job_id") + 1000).alias("doc_id"), F.lit("log.csv").alias("filename"), row.alias("row"), "joint", "welder", "wps", "day",
                       none.alias("positions"), none.alias("processes"), "thickness")
    jobs = sorted({r[0] for r in rows})
    documents = [(j, j + 1000, "log.csv", "weld_log") for j in jobs] + [(j, 1, "wps.docx", "wps") for j in jobs] + [(j, 2, "wpq.pdf", "wpq") for j in jobs]
    documents = spark.createDataFrame(documents, "job_id bigint, doc_id bigint, filename string, doc_type string").withColumns(
        {"status": F.lit("ready"), "added_at": F.lit(0), "log_error": F.lit(None).cast("string")})
    values = [(1, "number", "id", "WPS-1"), (1, "process", "processes", "SMAW"), (1, "thickness_range", "range_mm", "5 mm to 9 mm"),
              (2, "welder_id", "id", "W-1"), (2, "process", "processes", "SMAW"), (2, "test_date", "date", "2020-01-01")]
    raw = spark.createDataFrame([(j, *v) for j in jobs for v in values], "job_id bigint, doc_id bigint, key string, kind string, raw string")
    held = raw.select("job_id", "doc_id", "key", ps.read_value(F.col("kind"), F.col("raw")).alias("value"), F.lit(None).cast("int").alias("page"),
                      F.col("key").alias("locator"), F.col("raw").alias("snippet"), F.lit("table").alias("method"))
    return documents, held, log


def test_numbered_log_rows_do_not_move_for_lookups(spark):
    day = datetime.date(2020, 2, 1)
    documents, held, log = _numbered_log(spark, [(j, f"J{i}", "W-1", "WPS-1", day, 7.0) for j in (1, 2) for i in range(5)])
    docs = checks.wide(documents, held)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_in_place(spark):
            plan = checks.by_process(checks.gated(log, docs, docs))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # below the numbering of rows there is the one exchange that deals them; no exchange carries what the numbering makes
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    numbered = next(i for i, line in enumerate(lines) if "row_number()" in line and "Window" in line)
    above, least = [], depth(lines[numbered])
    for line in reversed(lines[:numbered]):
        if depth(line) < least:
            above, least = [*above, line], depth(line)
    assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)


def test_findings_of_rows_at_one_place_are_one(spark):
    day = datetime.date(2020, 2, 1)
    documents, held, log = _numbered_log(spark, [(1, f"J{i}", "W-1", "WPS-1", day, 20.0) for i in range(4)] + [(2, "J0", "W-9", "WPS-9", None, 1.0)])
    twice = log.unionByName(log.filter("row = 2 OR job_id = 2").withColumn("joint", F.lit("again")))
    found = [(r.job_id, r.id) for r in checks.cross_check(documents, held, twice, durable).collect() if r.check.startswith("log_")]
    want = [(1, f"log_thickness:1001:row {i}:1:thickness_range") for i in (1, 2, 3, 4)] + [(2, "log_welder_unqualified:1002:row 1"), (2, "log_wps_missing:1002:row 1")]
    assert sorted((j, ":".join([i.split(":")[0], *sorted(i.split(":")[1:])])) for j, i in found) == sorted((j, ":".join([i.split(":")[0], *sorted(i.split(":")[1:])])) for j, i in want)
