"""Golden job: planted problems are found, nothing else is."""

import pytest
from pyspark.sql import functions as F

from casebook.functions import parsing as ps
from casebook.operators import checks, fields
from casebook.session import durable
from tests import golden


@pytest.fixture(scope="module")
def job(spark):
    return tuple(durable(t) for t in golden.job(spark))


@pytest.fixture(scope="module")
def found(job):
    return durable(checks.cross_check(*job, durable=durable))


def shown(spark, job, name):
    documents, extracted, _ = job
    views = fields.field_views(documents, extracted, fields.field_spec(spark))
    rows = views.join(documents.filter(F.col("filename") == name).select("doc_id"), "doc_id").collect()
    return {r.key: r.display for r in rows}


def test_document_types(job):
    got = {r.filename: r.doc_type for r in job[0].collect()}
    assert got == {
        "Sample_PQR-017.pdf": "pqr", "Sample_TC-4471.pdf": "consumable", "Sample_WPQ-W14.pdf": "wpq",
        "Sample_WPQ-W22.pdf": "wpq", "Sample_WPS-SMAW-017.docx": "wps", "Sample_WeldLog_JOB-2025-118.xlsx": "weld_log",
    }


def test_fields_as_shown(spark, job):
    wps = shown(spark, job, "Sample_WPS-SMAW-017.docx")
    assert [wps[k] for k in ("number", "process", "filler", "thickness_range", "pqr_refs")] == [
        "WPS-SMAW-017", "SMAW", "E7018", "10–25 mm", "PQR-017"]
    pqr = shown(spark, job, "Sample_PQR-017.pdf")
    assert [pqr[k] for k in ("number", "test_thickness", "test_date")] == ["PQR-017", "10 mm", "2025-03-12"]
    w14 = shown(spark, job, "Sample_WPQ-W14.pdf")
    assert [w14[k] for k in ("welder_id", "positions", "test_date")] == ["W-14", "1G, 2G", "2025-01-20"]
    tc = shown(spark, job, "Sample_TC-4471.pdf")
    assert [tc[k] for k in ("classification", "batch")] == ["E7016", "4471"]
    assert job[2].count() == 7


def test_counts(job, found):
    row = checks.summary(job[0], found).first()
    assert (row.error, row.warning, row.note) == (7, 3, 0)
    assert (row.documents, row.wpq, row.weld_log, row.other, row.pending) == (6, 2, 1, 0, 0)


def test_each_planted_problem(found):
    rows = {(r.check, r.title.split()[1] if r.title.startswith("Joint") else None): r for r in found.collect()}
    assert {k[0] for k in rows} == {
        "thickness_over_2t", "consumable_mismatch", "log_welder_wrong_process", "log_welder_unqualified", "log_wps_missing",
        "log_thickness", "continuity_lapse", "log_position", "log_position_wps", "welder_process_unused"}
    by = {r.check: r for r in found.collect()}
    assert {e.filename for e in by["thickness_over_2t"].evidence} == {"Sample_WPS-SMAW-017.docx", "Sample_PQR-017.pdf"}
    assert by["thickness_over_2t"].kind == "code_rule" and "QW-451.1" in by["thickness_over_2t"].rule
    assert "J-104" in by["continuity_lapse"].title and by["continuity_lapse"].evidence[0].locator == "row 10"
    assert "J-102" in by["log_position"].title and "W-22" in by["welder_process_unused"].title


def test_report_order(found):
    order = [(r.severity, r.check, r.title) for r in checks.in_report_order(found).collect()]
    rank = {"error": 0, "warning": 1, "note": 2}
    assert order == sorted(order, key=lambda r: (rank[r[0]], r[1], r[2]))


def correct(spark, job, raw, key="classification", doc=5):
    documents, extracted, _ = job
    change = spark.createDataFrame([(golden.JOB, doc, key, raw, "QA")], "job_id string, doc_id bigint, key string, raw string, by string")
    judged = fields.judge_overrides(documents, change, fields.field_spec(spark))
    return judged, fields.with_overrides(extracted, judged)


def test_correction_round_trip(spark, job):
    documents, _, log = job
    judged, _ = correct(spark, job, "not a class")
    assert judged.first().verdict == "unreadable value"
    assert correct(spark, job, "x", key="nothing")[0].first().verdict == "unknown field"
    judged, fixed = correct(spark, job, "E7018")
    assert "consumable_mismatch" not in {r.check for r in checks.cross_check(documents, fixed, log, durable).collect()}
    judged, back = correct(spark, job, "")
    assert judged.first().verdict == "revert"
    assert "consumable_mismatch" in {r.check for r in checks.cross_check(documents, back, log, durable).collect()}
    _, removed = correct(spark, job, None)
    got = [r for r in checks.cross_check(documents, removed, log, durable).collect() if r.check == "missing_field"]
    assert [r.title for r in got] == ["Classification not found in Sample_TC-4471.pdf"]


def test_without_the_log(job):
    documents, extracted, log = job
    kept = documents.filter("doc_type <> 'weld_log'")
    got = {r.check for r in checks.cross_check(kept, extracted, log, durable).collect()}
    assert "no_log" in got and "continuity_lapse" not in got and not any(c.startswith("log_") for c in got)


def test_recheck_equals_full_check(spark, job, found):
    other = tuple(t.withColumn("job_id", F.lit("J2")) for t in job)
    both = tuple(a.unionByName(b) for a, b in zip(job, other))
    changed = spark.createDataFrame([(golden.JOB,)], "job_id string")
    again = checks.recheck(changed, *both, durable)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in found.collect())


def test_change_set(spark, job, found):
    documents, extracted, log = job
    assert checks.changes(found, found).count() == 0
    kept = checks.cross_check(documents.filter("doc_type <> 'weld_log'"), extracted, log, durable)
    renamed = kept.withColumn("title", F.when(F.col("check") == "welder_process_unused", "other").otherwise(F.col("title")))
    got = {r.id.split(":")[0]: r.change for r in checks.changes(found, renamed).collect()}
    assert got["no_log"] == "appeared" and got["continuity_lapse"] == "gone" and got["welder_process_unused"] == "changed"
    assert set(got) == {"no_log", "welder_process_unused"} | {r.check for r in found.collect() if r.check.startswith("log_") or r.check == "continuity_lapse"}


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("reader, text, want", [
    (ps.processes, "first 141, then tig again, capped by fcaw", ["GTAW", "FCAW"]),
    (ps.processes, "no. 1111 is not a process, 111 is", ["SMAW"]),
    (ps.classifications, "e 6010 root, E6010 again, E8018-G cap", ["E6010", "E8018-G"]),
    (ps.classifications, "E316L-17 or ER316S-3 or E81T1-Ni1, E7018", ["ER316S-3", "E81T1-NI1", "E316L-17", "E7018"]),
    (ps.classifications, "steel E275 and E3", []),
    (ps.positions, "tested in 5G, also PF and 2fr", ["5G", "PF", "2FR"]),
    (ps.celsius, "not under 15.5 C", 15.5),
    (ps.celsius, "-40 F at night", -40.0),
    (ps.references, "see pqr no. A-12, PQR#B/7 and PQR-A-12", ["PQR-A-12", "PQR-B/7"]),
    (ps.quantities, "2 1/4 of 7/8, then 16.5", [2.25, 0.875, 16.5]),
    (ps.identifier, " : B/22  shift two", "B/22"),
    (ps.millimetres, '3/4"', 19.05),
])
def test_readers(spark, reader, text, want):
    assert one(spark, reader, text) == want


@pytest.mark.parametrize("text, want", [
    ("07.11.2019", "2019-11-07"), ("3-Aug-2021", "2021-08-03"), ("30/02/2020 or 1 May 2020", None), ("October 9 2018", "2018-10-09"),
    ("on 2022-6-1 at noon", "2022-06-01"), ("22nd September 2023", "2023-09-22"), ("soon", None),
])
def test_dates(spark, text, want):
    got = one(spark, ps.day, text)
    assert (got.isoformat() if got else None) == want


@pytest.mark.parametrize("text, want", [
    ("18 – 6 mm", (6.0, 18.0)), ("1/8 in to 1/2 in", (3.18, 12.7)), ("up to 44 mm", (None, 44.0)), ("5.5 mm", (5.5, None)),
])
def test_ranges(spark, text, want):
    assert tuple(one(spark, ps.range_mm, text)) == want


def test_position_equivalents(spark):
    covers = lambda q: set(one(spark, lambda t: ps.with_equivalents(F.split(t, ",")), q))
    assert "PC" in covers("2G") and "3G" not in covers("1G,2G") and "3G" in covers("PG")


def test_table_label_wins_and_heading_is_no_label(spark):
    spec = fields.field_spec(spark)
    docs = spark.createDataFrame([(1, "wpq"), (2, "wps")], "doc_id bigint, doc_type string")
    facts = spark.createDataFrame(
        [(1, 1, 1, "t row 5", "Position of the test", "4G"), (1, 2, 1, "t row 6", "Positions qualified", "PE, 4F")],
        "doc_id bigint, fact_id bigint, page int, locator string, label string, value string")
    got = {r.key: r.value.texts for r in fields.from_facts(docs, facts, spec).collect()}
    assert got["positions"] == ["PE", "4F"]
    chunks = spark.createDataFrame(
        [(1, 0, "Crew = day shift\n  Welder_ID no. : B-7\nWelding process – 141\nWelder ID: B-9", 1),
         (2, 0, "WPS-TIG-3A2 - Welding Procedure Specification\nFor: pipe", None)],
        "doc_id bigint, chunk_index int, content string, page_start int")
    lines = {(r.doc_id, r.key): r for r in fields.from_lines(docs, chunks, spec).collect()}
    assert lines[(1, "welder_id")].value.text == "B-7" and lines[(1, "welder_id")].locator == "p. 1"
    assert lines[(1, "welder_id")].snippet == "Welder_ID no. : B-7" and lines[(1, "process")].value.texts == ["GTAW"]
    assert (2, "number") not in lines
    anywhere = {(r.doc_id, r.key): r for r in fields.from_anywhere(docs, chunks, spec).collect()}
    assert anywhere[(2, "number")].value.text == "WPS-TIG-3A2"


def test_proposals_must_be_in_the_document(spark):
    docs = spark.createDataFrame([(1, "wpq")], "doc_id bigint, doc_type string")
    chunks = spark.createDataFrame([(1, 0, "Passed by stamp B-7 on 03/08/2021.", 2)],
                                   "doc_id bigint, chunk_index int, content string, page_start int")
    asked = spark.createDataFrame([(1, "welder_id", "b-7"), (1, "test_date", "2021-08-03")], "doc_id bigint, key string, raw string")
    got = fields.verified(docs, chunks, fields.field_spec(spark), asked).collect()
    assert [(r.key, r.value.text, r.method, r.page) for r in got] == [("welder_id", "b-7", "model", 2)]


def test_log_without_header_is_reported(spark):
    rows = spark.createDataFrame([(9, 1, ["a", "b"]), (9, 2, ["1", "2"])], "doc_id bigint, row int, cells array<string>")
    log, errors = fields.weld_log(rows)
    assert log.count() == 0 and [r.doc_id for r in errors.collect()] == [9]
    logs = spark.createDataFrame([(9,), (10,)], "doc_id bigint")
    assert sorted(r.doc_id for r in fields.weld_log(rows, logs)[1].collect()) == [9, 10]


def test_log_header_may_stand_low(spark):
    above = [(1, i, [f"note {i}"]) for i in range(1, 40)]
    rows = spark.createDataFrame([*above, (1, 40, ["Welder ID", "WPS No."]), (1, 41, ["B-7", "P-1"]), (1, 42, ["", ""]), (1, 43, ["", "P-2"])],
                                 "doc_id bigint, row int, cells array<string>")
    log, errors = fields.weld_log(rows)
    assert [(r.row, r.welder, r.wps) for r in log.collect()] == [(41, "B-7", "P-1")] and errors.count() == 0
    assert fields.weld_log(rows, header_rows=15)[1].count() == 1


def test_later_rows_are_never_headers(spark):
    body = [(1, i, [f"J-{i}", f"WPS-{i % 3}", f"W-{i}", "none"]) for i in range(2, 40)]
    late = [(1, 40, ["joint 9", "WPS-3", "welder W-1", "position changed to 2G"]), (1, 41, ["Joint and date", "WPS", "Welder", "Position"]), (1, 42, ["J-42", "WPS-1", "W-42", ""])]
    rows = spark.createDataFrame([(1, 1, ["Joint", "WPS No.", "Welder ID", "Remarks"]), *body, *late], "doc_id bigint, row int, cells array<string>")
    log, errors = fields.weld_log(rows)
    read = {r.row for r in log.collect()}
    assert read >= {*range(2, 41), 42} and errors.count() == 0
    # one cell that names both columns is a title
    title = spark.createDataFrame([(1, 1, ["Welder and WPS register"]), (1, 2, ["Welder", "WPS"]), (1, 3, ["W-1", "WPS-1"])], "doc_id bigint, row int, cells array<string>")
    assert [r.row for r in fields.weld_log(title)[0].collect()] == [3]


def test_attachments_are_judged(spark):
    jobs = spark.createDataFrame([("J", 1)], "job_id string, library bigint")
    asked = spark.createDataFrame([("J", 1, None), ("J", 2, None), ("J", 3, None), ("X", 1, None), ("J", 4, "wps")], "job_id string, doc_id bigint, doc_type string")
    docs = spark.createDataFrame([(1, "scan.pdf", 1), (2, "scan.pdf", 2), (4, "scan.pdf", 1)], "doc_id bigint, filename string, library bigint")
    chunks = spark.createDataFrame([(1, 0, "x " * 2000), (1, 1, "end. Procedure qualification record"), (1, 2, "inspection certificate")], "doc_id bigint, chunk_index int, content string")
    kept, refused = fields.attach(jobs, asked, docs, chunks)
    assert sorted((r.doc_id, r.doc_type) for r in kept.collect()) == [(1, "pqr"), (4, "wps")]
    assert sorted((r.job_id, r.doc_id, r.reason) for r in refused.collect()) == [("J", 2, "other library"), ("J", 3, "unknown document"), ("X", 1, "unknown job")]


@pytest.mark.parametrize("name, head, want", [
    ("old_pqr_copy.pdf", "", "pqr"), ("joints 2021.csv", "", "weld_log"), ("joints 2021.pdf", "", "other"),
    ("page7.pdf", "a " * 900 + "welder qualification of the day", "wpq"),
    ("page8.pdf", "This Certificate of Conformity covers", "consumable"), ("y.pdf", "", "other"),
])
def test_type_guess(spark, name, head, want):
    row = spark.createDataFrame([(name, head)], "n string, h string").select(ps.document_type(F.col("n"), F.col("h")).alias("v")).first()
    assert row.v == want


def test_published_report(spark, tmp_path):
    from casebook.plans import index, jobs

    links, rows, chunks, log = golden.tables(spark)
    documents = links.withColumn("doc_type", ps.document_type(F.col("filename"), F.col("head"))).drop("head")
    late = spark.createDataFrame([(golden.JOB, 99, "late.pdf", "queued", 9, "pqr")], documents.schema)
    tables = [durable(t) for t in jobs.job_tables(documents.unionByName(late), rows, chunks, log)]
    jobs.publish_report(*tables, str(tmp_path), "v1", durable)
    read = lambda name: index.read_part(spark, str(tmp_path), name, index.current_version(spark, str(tmp_path)))
    row = read("summary").first()
    assert (row.error, row.warning, row.note, row.documents, row.pending) == (7, 3, 0, 6, 1)
    assert read("findings").count() == 10 and read("pending").first().filename == "late.pdf"
