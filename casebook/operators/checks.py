"""Cross-checks of job documents against each other and against the weld log, all jobs at once.

Documents are one wide row each; every check is a filter or an equi-join on (job, canonical id) that emits findings. A log row
carries the few values it is judged by: those of its procedure, and a profile of its welder whose size is bounded by the
lists of process and position codes. Whole records are carried by rows with findings only, which show them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions import parsing as ps
from casebook.operators.fields import DOCUMENT_TYPES, FIELDS, log_snippet
from casebook.operators.windows import as_of, first_row
from casebook.session import joined_in_place

SEVERITIES = ("error", "warning", "note")
CONTINUITY_MONTHS = 6
AS_OF_DAYS = 366
COUPON_LIMIT = 38.0

# The names of the checks, the titles of their findings and the rules they cite are part of the report.
TITLES = {
    "missing_field": "%s not found in %s",
    "wps_no_pqr_ref": "%s doesn't name its supporting PQR",
    "pqr_missing": "Supporting %s is not in this job",
    "process_mismatch": "WPS process isn't the process qualified by its PQR",
    "filler_mismatch_pqr": "Filler classification differs between WPS and PQR",
    "base_metal_differs": "Base metal differs between WPS and PQR",
    "thickness_over_2t": "WPS thickness range exceeds what the PQR coupon qualifies",
    "consumable_mismatch": "Consumable certificate is for a different electrode than the WPS",
    "welder_process_unused": "%s isn't qualified for this job's processes",
    "log_unreadable": "Couldn't read %s as a weld log",
    "log_wps_missing": "Joint %s was welded to %s, which isn't in this job",
    "log_welder_unqualified": "No qualification on file for welder %s (joint %s)",
    "log_welder_wrong_process": "Welder %s isn't qualified for %s (joint %s)",
    "log_position": "Joint %s welded in %s, not listed on welder %s's qualification",
    "log_position_wps": "Joint %s welded in %s, which %s doesn't list",
    "log_thickness": "Joint %s is %s mm, outside %s's range",
    "log_before_qualification": "Joint %s was welded before welder %s qualified",
    "continuity_lapse": "Welder %s's %s qualification had lapsed when joint %s was welded",
    "no_wps": "No WPS in this job",
    "no_pqr": "No PQR in this job",
    "no_consumable": "No consumable certificate",
    "no_log": "No weld log",
}
RULES = {
    "thickness_over_2t": (
        "ASME IX QW-451.1 (groove welds): maximum qualified thickness 2T for coupons under 38 mm (1½ in). "
        "Verify against the code and edition this job is built to."
    ),
    "continuity_lapse": (
        "ASME IX QW-322.1(a): a welder's qualification expires after 6 months without welding in that process. "
        "Check the code this job is built to; the log may also be missing welds from other jobs."
    ),
}

EVIDENCE = (
    "struct<document_id:string,filename:string,doc_type:string,label:string,value:string,page:int,locator:string,"
    "snippet:string,method:string>"
)
LOG_KEYS = ("number", "process", "positions", "thickness_range", "welder_id", "test_date")  # what the log is checked against
WORK = ("job_id", "doc_id", "filename", "welder_key", "process", "day", "previous", "row", "joint", "welder", "snippet")  # what continuity reads
KEYS = tuple(dict.fromkeys(key for specs in FIELDS.values() for key, *_ in specs))
_KIND = {(t, key): (label, kind) for t, specs in FIELDS.items() for key, label, kind, *_ in specs}


def wide(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per job document with a column per field key (value, page, locator, snippet, method)."""
    cell = F.struct("value", "page", "locator", "snippet", "method")
    cells = fields.groupBy("job_id", "doc_id").agg(
        *[F.first(F.when(F.col("key") == k, cell), ignorenulls=True).alias(k) for k in KEYS]
    )
    base = documents.select("job_id", "doc_id", "filename", "doc_type", "added_at", "log_error")
    return base.join(cells, ["job_id", "doc_id"], "left").withColumn("order", F.struct("added_at", "doc_id"))


def _value(col: str, part: str) -> Column:
    return F.col(f"{col}.value.{part}")


def evidence(doc: Column | None, key: str | None, doc_type: str | None) -> Column:
    """What a finding shows of one document (E33); ``doc`` is a struct of a wide row, or None for the row itself."""
    get = (lambda c: doc[c]) if doc is not None else F.col
    base = [get("doc_id").cast("string"), get("filename"), get("doc_type")]
    if key is None:
        rest = [F.lit(None).cast(t) for t in ("string", "string", "int", "string", "string", "string")]
    else:
        label, kind = _KIND[(doc_type, key)]
        record = get(key)
        shown = F.when(record.isNotNull(), ps.display(F.lit(kind), record["value"]))
        rest = [F.when(record.isNotNull(), label), shown, record["page"], record["locator"], record["snippet"], record["method"]]
    names = ("document_id", "filename", "doc_type", "label", "value", "page", "locator", "snippet", "method")
    return F.struct(*[c.alias(n) for c, n in zip([*base, *rest], names)]).cast(EVIDENCE)


def row_evidence() -> Column:
    """What a finding shows of a log row."""
    parts = (
        F.col("doc_id").cast("string"), F.col("filename"), F.lit("weld_log"), F.lit("Weld"), F.col("snippet"), F.lit(None),
        F.concat(F.lit("row "), F.col("row").cast("string")), F.col("snippet"), F.lit(None),
    )
    names = ("document_id", "filename", "doc_type", "label", "value", "page", "locator", "snippet", "method")
    return F.struct(*[c.alias(n) for c, n in zip(parts, names)]).cast(EVIDENCE)


def finding_id(check: str, shown: Column) -> Column:
    """Identity of a finding: its check and the set of places it points at."""
    place = lambda e: F.concat_ws(":", e["document_id"], F.coalesce(e["locator"], e["label"], F.lit("")))
    return F.concat(F.lit(check + ":"), F.array_join(F.array_sort(F.transform(shown, place)), ":"))


def emit(
    rows: DataFrame, check: str, severity: str, kind: str, names: list, detail: Column, shown: Column, seq: Column | None = None,
) -> DataFrame:
    """Findings of a check; ``names`` fill its title."""
    return rows.select(
        "job_id", finding_id(check, shown).alias("id"), F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        F.lit(kind).alias("kind"), F.format_string(TITLES[check], *names).alias("title"), detail.alias("detail"),
        F.lit(RULES.get(check)).cast("string").alias("rule"),
        shown.alias("evidence"), (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"),
    )


def _facts(**values) -> Column:
    """What a finding rests on, value by value: ``name value; name value``; a missing value leaves its name out."""
    told = lambda v: v if isinstance(v, Column) else F.lit(str(v))
    return F.concat_ws("; ", *[F.concat(F.lit(name.replace("_", " ") + " "), told(v).cast("string")) for name, v in values.items()])


def _codes(texts: Column) -> Column:
    return F.array_join(F.array_sort(texts), ", ")


def _has(texts: Column) -> Column:
    return F.coalesce(F.size(texts) > 0, F.lit(False))


def _as_struct(name: str, *keys: str) -> Column:
    return F.struct("doc_id", "filename", "doc_type", "order", *keys).alias(name)


def latest_by(docs: DataFrame, doc_type: str, key: str, name: str, *keys: str) -> DataFrame:
    """(job, canonical id) -> the last document with that number, as a struct."""
    typed = docs.filter((F.col("doc_type") == doc_type) & _value(key, "text").isNotNull())
    return typed.groupBy("job_id", ps.canon_id(_value(key, "text")).alias("canon")).agg(
        F.max_by(_as_struct("d", key, *keys), F.col("order")).alias(name)
    )


def qualifications(docs: DataFrame) -> DataFrame:
    """(job, canonical welder) -> that welder's qualification records in document order.

    The list is what a finding has to show; it is collected once per welder, not per log row.
    """
    typed = docs.filter((F.col("doc_type") == "wpq") & _value("welder_id", "text").isNotNull())
    row = _as_struct("d", "welder_id", "process", "positions", "test_date")
    return typed.groupBy("job_id", ps.canon_id(_value("welder_id", "text")).alias("canon")).agg(
        F.array_sort(
            F.collect_list(row), lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)
        ).alias("quals")
    )


def job_facts(docs: DataFrame) -> DataFrame:
    """Per job what the set-wide checks need; every part combines in the map tasks."""
    n = lambda t: F.count_if(F.col("doc_type") == t).alias("n_" + t)
    is_wps = F.col("doc_type") == "wps"
    base = docs.groupBy("job_id").agg(
        *[n(t) for t in DOCUMENT_TYPES], F.count(F.lit(1)).alias("documents"),
        F.array_distinct(F.flatten(F.collect_set(F.when(is_wps, _value("process", "texts"))))).alias("processes"),
        F.min_by(_as_struct("d", "process"), F.when(is_wps, F.col("order"))).alias("first_wps"),
    )
    fillers = docs.filter(is_wps).select(
        "job_id", "order", _as_struct("wps", "filler"), F.posexplode(_value("filler", "texts")).alias("_i", "class")
    )
    classes = fillers.groupBy("job_id", "class").agg(
        F.min(F.struct("order", "_i")).alias("seen"), F.max_by("wps", "order").alias("wps")
    )
    per_job = classes.groupBy("job_id").agg(
        F.collect_set("class").alias("fillers"), F.min_by("wps", "seen").alias("filler_wps")
    )
    return base.join(per_job, "job_id", "left")


# -- checks over documents ------------------------------------------------------------

def missing_fields(docs: DataFrame) -> DataFrame:
    """K1: a required field is absent."""
    gaps = F.lit(None).cast("array<string>")
    found = F.lit(0)
    for doc_type, specs in FIELDS.items():
        absent = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(label)) for k, label, _, need, _ in specs if need]))
        gaps = F.when(F.col("doc_type") == doc_type, absent).otherwise(gaps)
        read = F.size(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(1)) for k, *_ in specs])))
        found = F.when(F.col("doc_type") == doc_type, read).otherwise(found)
    rows = docs.withColumn("_found", found).select("*", F.posexplode(gaps).alias("_i", "_label"))
    return emit(
        rows, "missing_field", "note", "missing", ["_label", "filename"],
        _facts(document=F.col("filename"), fields_read=F.col("_found"), absent=F.lower("_label")), F.array(evidence(None, None, None)), seq=F.col("_i"),
    )


def supported(docs: DataFrame) -> DataFrame:
    """Procedures with each record they cite, null where the job lacks it."""
    pqr = latest_by(docs, "pqr", "number", "pqr", "process", "filler", "base_metal", "test_thickness")
    refs = docs.filter("doc_type = 'wps'").select(
        "job_id", _as_struct("wps", "process", "filler", "base_metal", "thickness_range", "pqr_refs"),
        F.posexplode(_value("pqr_refs", "texts")).alias("_i", "ref"),
    )
    return refs.withColumn("canon", ps.canon_id(F.col("ref"))).join(pqr, ["job_id", "canon"], "left")


def unreferenced(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """K2: a procedure names no record although the job has some."""
    rows = docs.filter((F.col("doc_type") == "wps") & ~_has(_value("pqr_refs", "texts"))).join(
        jobs.filter("n_pqr > 0").select("job_id", "n_pqr"), "job_id"
    )
    return emit(
        rows, "wps_no_pqr_ref", "note", "missing", ["filename"], _facts(records_in_job=F.col("n_pqr"), records_cited=0), F.array(evidence(None, None, None)),
    )


def against_records(pairs: DataFrame) -> list[DataFrame]:
    """K3-K7: each procedure against the records it cites."""
    wps, pqr = F.col("wps"), F.col("pqr")
    both = lambda key: F.array(evidence(wps, key, "wps"), evidence(pqr, key, "pqr"))
    names = (F.col("wps.filename"), F.col("pqr.filename"))
    found = pairs.filter("pqr IS NOT NULL")
    wp, pp = F.col("wps.process.value.texts"), F.col("pqr.process.value.texts")
    wf, pf = F.col("wps.filler.value.texts"), F.col("pqr.filler.value.texts")
    wm, pm = F.col("wps.base_metal.value.text"), F.col("pqr.base_metal.value.text")
    top, coupon = F.col("wps.thickness_range.value.hi"), F.col("pqr.test_thickness.value.num")
    told = lambda a, b: _facts(procedure=names[0], asks=a, record=names[1], covers=b)
    mm = lambda v: F.concat(ps.plain(v), F.lit(" mm"))
    return [
        emit(
            pairs.filter("pqr IS NULL"), "pqr_missing", "warning", "missing", ["ref"], _facts(cited=F.col("ref"), by=names[0]),
            F.array(evidence(wps, "pqr_refs", "wps")), seq=F.col("_i"),
        ),
        emit(
            found.filter(_has(wp) & _has(pp) & (F.size(F.array_except(wp, pp)) > 0)), "process_mismatch", "error", "consistency", [],
            told(_codes(wp), _codes(pp)), both("process"), seq=F.col("_i"),
        ),
        emit(
            found.filter(_has(wf) & _has(pf) & ~F.arrays_overlap(wf, pf)), "filler_mismatch_pqr", "warning", "consistency", [],
            told(_codes(wf), _codes(pf)), both("filler"), seq=F.col("_i"),
        ),
        emit(
            found.filter(ps.canon_id(wm) != ps.canon_id(pm)), "base_metal_differs", "warning", "consistency", [],
            told(wm, pm), both("base_metal"), seq=F.col("_i"),
        ),
        emit(
            found.filter((coupon != 0) & (coupon < COUPON_LIMIT) & (top > 2 * coupon)), "thickness_over_2t", "error", "code_rule", [],
            _facts(coupon=mm(coupon), limit=mm(2 * coupon), claimed=mm(top)),
            F.array(evidence(wps, "thickness_range", "wps"), evidence(pqr, "test_thickness", "pqr")), seq=F.col("_i"),
        ),
    ]


def consumables(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """K8: a certificate shares no classification with any procedure of the job."""
    classes = _value("classification", "texts")
    rows = docs.filter((F.col("doc_type") == "consumable") & _has(classes)).join(
        jobs.filter("fillers IS NOT NULL").select("job_id", "fillers", "filler_wps"), "job_id"
    )
    return emit(
        rows.filter(~F.arrays_overlap(classes, F.col("fillers"))), "consumable_mismatch", "error", "consistency", [],
        _facts(certificate=F.col("filename"), certified=F.array_join(classes, ", "), asked_for=_codes(F.col("fillers"))),
        F.array(evidence(None, "classification", "consumable"), evidence(F.col("filler_wps"), "filler", "wps")),
    )


def unused_welders(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """K9: a welder is qualified for none of the job's processes."""
    codes = _value("process", "texts")
    rows = docs.filter((F.col("doc_type") == "wpq") & _has(codes)).join(
        jobs.filter(F.size("processes") > 0).select("job_id", "processes", "first_wps"), "job_id"
    )
    return emit(
        rows.filter(~F.arrays_overlap(codes, F.col("processes"))), "welder_process_unused", "warning", "consistency",
        [F.coalesce(_value("welder_id", "text"), F.col("filename"))],
        _facts(qualified_for=_codes(codes), job_needs=_codes(F.col("processes"))),
        F.array(evidence(None, "process", "wpq"), evidence(F.col("first_wps"), "process", "wps")),
    )


def coverage(jobs: DataFrame) -> list[DataFrame]:
    """Kinds of document a job lacks."""
    none = F.array().cast(f"array<{EVIDENCE}>")
    gaps = (
        ("no_wps", "n_wps = 0"), ("no_pqr", "n_wps > 0 AND n_pqr = 0"), ("no_consumable", "n_wps > 0 AND n_consumable = 0"),
        ("no_log", "n_wps > 0 AND n_weld_log = 0"),
    )
    held = _facts(documents=F.col("documents"), of_them_procedures=F.col("n_wps"))
    return [emit(jobs.filter(cond), check, "note", "missing", [], held, none) for check, cond in gaps]


# -- checks over the log --------------------------------------------------------------

def unreadable_logs(docs: DataFrame) -> DataFrame:
    """A log could not be read."""
    rows = docs.filter("doc_type = 'weld_log' AND log_error IS NOT NULL")
    return emit(rows, "log_unreadable", "warning", "missing", ["filename"], F.col("log_error"), F.array(evidence(None, None, None)))


def _records(docs: DataFrame, *values: Column) -> DataFrame:
    """A narrow row for each welder's qualification record."""
    typed = docs.filter((F.col("doc_type") == "wpq") & _value("welder_id", "text").isNotNull())
    return typed.select("job_id", ps.canon_id(_value("welder_id", "text")).alias("welder_key"), *values)


def welder_profiles(docs: DataFrame) -> DataFrame:
    """(job, canonical welder) -> ``profile``: by process, and under ``*`` by all, the listed positions and the first test.

    A welder may have any number of records; a profile holds the codes of processes and positions only, each once, and is combined
    in the map tasks.
    """
    none = F.array().cast("array<string>")
    codes = F.explode(F.array_union(F.array(F.lit("*")), F.coalesce(_value("process", "texts"), none))).alias("process")
    rows = _records(docs, codes, _value("positions", "texts").alias("positions"), _value("test_date", "day").alias("day"))
    spots = rows.select("job_id", "welder_key", "process", "day", F.explode_outer("positions").alias("position"))
    known = spots.groupBy("job_id", "welder_key", "process").agg(F.collect_set("position").alias("positions"), F.min("day").alias("tested"))
    entry = F.struct("process", F.struct("positions", "tested"))
    return known.groupBy("job_id", "welder_key").agg(F.map_from_entries(F.collect_list(entry)).alias("profile"))


def _by_job(looked_up: DataFrame) -> DataFrame:
    """Dealt by job, to meet log rows that are dealt so (see ``joined_in_place``)."""
    return looked_up.repartition("job_id")


def gated(log: DataFrame, docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Log rows with what they are judged by, the gate (J13, J14), and the documents that their findings show.

    ``log``: job_id, doc_id, filename, row, joint, welder, wps, day, positions, processes, thickness and, if it is not to be
    ``log_snippet()``, snippet. With ``known`` (job_id, doc_id) only rows of these logs are kept. Written under
    ``joined_in_place``, rows that are dealt by job already do not move.
    gate is 'unqualified', 'wrong_process' or 'pass'; only rows that pass meet the later checks. Of the procedure a row gets
    document, positions and limits, of its welder the codes and first test of the records that fit its process. Only a row with a
    finding gets what that shows: ``proc``, its procedure, and ``quals``, all records of its welder in document order.
    """
    none = F.array().cast("array<string>")
    wps = latest_by(docs, "wps", "number", "_proc", "process", "positions", "thickness_range").withColumnRenamed("canon", "wps_key")
    keyed = log.withColumns({"wps_key": ps.canon_id(F.col("wps")), "welder_key": ps.canon_id(F.col("welder"))})
    if known is not None:
        held = known.select("job_id", "doc_id").distinct().withColumn("_known", F.lit(True))
        # a semi-join would be moved below the numbering of rows, and deal them once more
        keyed = keyed.join(_by_job(held), ["job_id", "doc_id"], "left").filter("_known").drop("_known")
    keyed = keyed.join(_by_job(wps), ["job_id", "wps_key"], "left").join(_by_job(welder_profiles(docs)), ["job_id", "welder_key"], "left")
    if "snippet" not in log.columns:
        keyed = keyed.withColumn("snippet", log_snippet())
    own, of_wps = F.coalesce("processes", none), F.coalesce("_proc.process.value.texts", none)
    keyed = keyed.withColumn("row_process", F.when(F.size(own) > 0, own).otherwise(of_wps))
    asked = F.when(F.size("row_process") > 0, F.array_distinct("row_process")).otherwise(F.array(F.lit("*")))
    fit = F.array_compact(F.transform(asked, lambda p: F.try_element_at("profile", p)))
    keyed = keyed.withColumn("_fit", F.when(F.col("profile").isNotNull(), fit))
    gate = F.when(F.col("profile").isNull(), "unqualified").when(F.size("_fit") == 0, "wrong_process").otherwise("pass")
    rows = keyed.select(
        *dict.fromkeys([*log.columns, "snippet"]), "wps_key", "welder_key", "_proc", F.col("_proc.doc_id").alias("proc_doc"),
        F.col("_proc.positions.value.texts").alias("wps_positions"), F.col("_proc.thickness_range.value.lo").alias("lo"),
        F.col("_proc.thickness_range.value.hi").alias("hi"), "row_process",
        F.array_remove(F.map_keys("profile"), "*").alias("qualified_for"), F.array_distinct(F.flatten("_fit.positions")).alias("listed"),
        F.array_min("_fit.tested").alias("tested"), gate.alias("gate"),
    )
    passed = F.col("gate") == "pass"
    rows = rows.withColumns({
        "proc": F.when(passed & (_outside() | _off_wps().isNotNull()), F.col("_proc")),
        "_shows": (F.col("gate") == "wrong_process") | (passed & (_early() | _unlisted().isNotNull())),
    }).drop("_proc")
    lists = _by_job(qualifications(docs).select("job_id", F.col("canon").alias("welder_key"), F.col("quals").alias("_quals")))
    return rows.join(lists, ["job_id", "welder_key"], "left").withColumn("quals", F.when(F.col("_shows"), F.col("_quals"))).drop("_quals", "_shows")


def _last_spot(fails) -> Column:
    """Of the row's positions that fail, the last one with its place: a row has one finding of them, and the last counts."""
    spots = F.transform("positions", lambda p, i: F.struct(i.alias("_i"), p.alias("position")))
    return F.try_element_at(F.filter(spots, lambda s: fails(s["position"])), F.lit(-1))


def _unlisted() -> Column:
    return _last_spot(lambda p: (F.size("listed") > 0) & ~F.array_contains(ps.with_equivalents(F.col("listed")), p))


def _off_wps() -> Column:
    return _last_spot(lambda p: _has(F.col("wps_positions")) & ~F.array_contains(ps.with_equivalents(F.col("wps_positions")), p))


def _outside() -> Column:
    return F.coalesce((F.col("thickness") < F.col("lo")) | (F.col("thickness") > F.col("hi")), F.lit(False))


def _early() -> Column:
    return F.coalesce(F.col("day") < F.col("tested"), F.lit(False))


def _with_records(found: DataFrame, key: str, fits: Column | None = None) -> DataFrame:
    """Findings with ``shown``: the log row, and the welder's records (those that fit) in document order."""
    covers = lambda q: F.coalesce(F.arrays_overlap(q["process"]["value"]["texts"], F.col("row_process")), F.lit(False))
    chosen = F.col("quals") if fits is None else F.filter("quals", lambda q: fits | covers(q))
    return found.withColumn("shown", F.concat(F.array(row_evidence()), F.transform(chosen, lambda q: evidence(q, key, "wpq")))).drop("quals")


def log_rows(rows: DataFrame) -> list[DataFrame]:
    """K11-K17 over gated log rows: of each check one finding of a row at most."""
    proc = F.col("proc")
    any_process = F.size("row_process") == 0
    passed = rows.filter("gate = 'pass'")
    at = lambda spot: passed.withColumn("_spot", spot).filter("_spot IS NOT NULL").select("*", "_spot.*")
    number = F.col("proc.number.value.text")
    return [
        emit(
            rows.filter("wps IS NOT NULL AND proc_doc IS NULL"), "log_wps_missing", "error", "consistency", ["joint", "wps"],
            _facts(log_names=F.col("wps"), documents_with_that_number=0), F.array(row_evidence()),
        ),
        emit(
            rows.filter("gate = 'unqualified'"), "log_welder_unqualified", "error", "consistency", ["welder", "joint"],
            _facts(log_names=F.col("welder"), records_with_that_welder=0), F.array(row_evidence()),
        ),
        emit(
            _with_records(rows.filter("gate = 'wrong_process'"), "process"), "log_welder_wrong_process", "error", "consistency",
            ["welder", _codes(F.col("row_process")), "joint"],
            _facts(welded=_codes(F.col("row_process")), qualified_for=_codes(F.col("qualified_for"))), F.col("shown"),
        ),
        emit(
            _with_records(at(_unlisted()), "positions", any_process), "log_position", "warning", "consistency",
            ["joint", "position", "welder"], _facts(welded=F.col("position"), listed=_codes(F.col("listed"))), F.col("shown"), seq=F.col("_i"),
        ),
        emit(
            at(_off_wps()), "log_position_wps", "warning", "consistency", ["joint", "position", number],
            _facts(welded=F.col("position"), listed=_codes(F.col("wps_positions"))), F.array(row_evidence(), evidence(proc, "positions", "wps")), seq=F.col("_i"),
        ),
        emit(
            passed.filter(_outside()), "log_thickness", "error", "consistency", ["joint", ps.plain(F.col("thickness")), number],
            _facts(welded=F.concat(ps.plain(F.col("thickness")), F.lit(" mm")), range=ps.display(F.lit("range_mm"), proc["thickness_range"]["value"])),
            F.array(row_evidence(), evidence(proc, "thickness_range", "wps")),
        ),
        emit(
            _with_records(passed.filter(_early()), "test_date", any_process), "log_before_qualification", "error", "consistency",
            ["joint", "welder"], _facts(welded=F.col("day"), first_test=F.col("tested")), F.col("shown"),
        ),
    ]


def by_process(rows: DataFrame) -> DataFrame:
    """Gated rows once for each process they count as work in, with ``previous``, the day of the welder's row before it in that log.

    ``process`` is null where a row counts as no work; ``nth`` is 0 for one of a row's copies. Rows dealt by job or welder do not move.
    """
    active = (F.col("gate") == "pass") & F.col("day").isNotNull()
    codes = F.when(F.size("row_process") > 0, F.array_distinct("row_process")).otherwise(F.array(F.lit("*")))
    spread = rows.select("*", F.posexplode_outer(F.when(active, codes)).alias("nth", "process")).withColumn("nth", F.coalesce("nth", F.lit(0)))
    w = Window.partitionBy("job_id", "welder_key", "doc_id", "filename", "process").orderBy("day", F.asc_nulls_last("row"))
    return spread.withColumn("previous", F.lag("day").over(w))


def continuity(worked: DataFrame, docs: DataFrame, months: int = CONTINUITY_MONTHS) -> DataFrame:
    """The first weld after more than six idle months, per (log, welder, process).

    ``worked``: rows as ``by_process`` gives them. Only rows after a long enough gap and the first of each key can be such a weld, so
    only these move on. A key's clock starts at the last test on or before its first day, found by an as-of join of days and tests, or at
    its first test.
    """
    key, of_welder = ["job_id", "doc_id", "filename", "welder_key", "process"], ["job_id", "welder_key", "process"]
    after_gap = F.col("previous").isNull() | (F.col("day") > F.add_months("previous", months))
    days = worked.filter(F.col("process").isNotNull() & after_gap).select(*WORK)
    unknown, none = F.array(F.lit("*")), F.array().cast("array<string>")
    codes = F.explode(F.array_union(unknown, F.coalesce(_value("process", "texts"), none))).alias("process")
    tests = _records(docs, codes, _value("test_date", "day").alias("test_day")).filter("test_day IS NOT NULL").distinct()
    first_test = tests.groupBy(*of_welder).agg(F.min("test_day").alias("first_test"))
    starts = days.filter("previous IS NULL").select(*key, F.col("day").alias("first_day"))
    anchors = as_of(starts, tests, of_welder, F.unix_date("first_day"), F.unix_date("test_day"), F.col("test_day"), "last_test", AS_OF_DAYS)
    anchors = anchors.join(first_test, of_welder).select(*key, F.coalesce("last_test", "first_test").alias("anchor"))
    since = days.join(anchors, key).withColumn("last", F.greatest("anchor", "previous"))
    lapsed = since.filter(F.col("day") > F.add_months("last", months))
    found = first_row(lapsed, key, F.col("day")).withColumn("row_process", F.array("process"))
    found = found.join(qualifications(docs).withColumnRenamed("canon", "welder_key"), ["job_id", "welder_key"])
    label = F.when(F.col("process") == "*", "welding").otherwise(F.col("process"))
    return emit(
        _with_records(found, "test_date", F.col("process") == "*"), "continuity_lapse", "error", "code_rule", ["welder", label, "joint"],
        _facts(process=label, idle_from=F.col("last"), idle_to=F.col("day"), months_allowed=months), F.col("shown"),
    )


# -- report ------------------------------------------------------------------------------

def unique(found: DataFrame) -> DataFrame:
    """One finding per identity, the last one emitted.

    Column by column, which all take the same finding: a column that nobody reads, such as long evidence, does not travel.
    """
    others = [c for c in found.columns if c not in ("job_id", "id", "seq")]
    return found.groupBy("job_id", "id").agg(*[F.max_by(c, "seq").alias(c) for c in others]).select(*[c for c in found.columns if c != "seq"])


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def in_report_order(found: DataFrame) -> DataFrame:
    """Errors first, then by check and title (T5)."""
    return found.orderBy("job_id", severity_rank(F.col("severity")), "check", "title", "id")


def cross_check(documents: DataFrame, fields: DataFrame, log: DataFrame, durable=lambda df: df, also: dict[str, Column] | None = None) -> DataFrame:
    """All findings of all jobs.

    ``also``: columns told of each finding while its evidence is at hand, for reports that do not carry the evidence itself.

    ``documents``: job_id, doc_id, filename, doc_type, status, added_at, log_error. Only ready documents of a known
    type take part. ``durable`` may write the two tables every check reads, so they are computed once.
    """
    known = documents.filter("status = 'ready' AND doc_type <> 'other'")
    docs = durable(wide(known, fields))
    jobs = durable(job_facts(docs))
    held = docs.select("job_id", "doc_id")
    if docs.filter("doc_type = 'weld_log'").isEmpty() and log.select("job_id", "doc_id").distinct().join(held, ["job_id", "doc_id"], "left_semi").isEmpty():
        log = log.filter(F.lit(False))  # the rows of no log count, so they need not be numbered and looked up
    with joined_in_place(log.sparkSession):
        rows = durable(by_process(gated(log, docs, held)))
    single, repeated = _by_place(rows.filter("nth = 0"), durable)
    parts = [
        missing_fields(docs), unreferenced(docs, jobs), *against_records(supported(docs)), consumables(docs, jobs),
        unused_welders(docs, jobs), unreadable_logs(docs), *(log_rows(repeated) if repeated else []), continuity(rows, docs), *coverage(jobs),
    ]
    told = lambda some: reduce(DataFrame.unionByName, [part.withColumns(also) if also else part for part in some])
    return unique(told(parts)).unionByName(told(log_rows(single)).drop("seq"))


def _by_place(rows: DataFrame, durable) -> tuple[DataFrame, DataFrame | None]:
    """Log rows whose place (job, document, row) no other row has, and the others, None if there are none.

    A finding of the log points at its row's place, and a row has one finding of a check, so those of the first kind are unique as they
    are and need not be brought together. Places are told apart by a hash: a clash makes a row one of the others, which is as right.
    """
    place = F.xxhash64("job_id", "doc_id", "row")
    again = durable(rows.groupBy(place.alias("_place")).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("_place"))
    if again.isEmpty():
        return rows, None
    placed = rows.withColumn("_place", place)
    return placed.join(again, "_place", "left_anti").drop("_place"), placed.join(again, "_place", "left_semi").drop("_place")


def summary(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Per job: findings by severity, documents by type, pending documents; zeros included."""
    counts = found.groupBy("job_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    checked = (F.col("status") == "ready") & (F.col("doc_type") != "other")
    types = documents.groupBy("job_id").agg(
        F.count_if(checked).alias("documents"),
        *[F.count_if(checked & (F.col("doc_type") == t)).alias(t) for t in DOCUMENT_TYPES],
        F.count_if(F.col("status") != "ready").alias("pending"),
    )
    return types.join(counts, "job_id", "left").fillna(0, list(SEVERITIES))


def job_views(jobs: DataFrame, links: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs with their number of documents and the counts of their last check, null while unchecked.

    ``reports``: job_id, checked_at and a count per severity, one row for each check that was run.
    """
    counts = links.groupBy("job_id").agg(F.count(F.lit(1)).alias("document_count"))
    last = first_row(reports.select("job_id", "checked_at", *SEVERITIES), ["job_id"], F.col("checked_at"), last=True)
    return jobs.join(counts, "job_id", "left").fillna(0, ["document_count"]).join(last, "job_id", "left")


def stale(jobs: DataFrame) -> Column:
    """Whether a job changed after its last check (F16)."""
    return F.coalesce(F.col("updated_at") > F.col("checked_at"), F.lit(False))


def recheck(changed: DataFrame, documents: DataFrame, fields: DataFrame, log: DataFrame, durable=lambda df: df) -> DataFrame:
    """Findings of the jobs whose documents changed, and only of those."""
    keep = lambda df: df.join(changed.select("job_id").distinct(), "job_id", "left_semi")
    return cross_check(keep(documents), keep(fields), keep(log), durable)


def content() -> Column:
    """All that a finding tells, as a hash."""
    return F.xxhash64("check", "severity", "kind", "title", "detail", "rule", F.to_json("evidence"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of two versions of a report as a change set: ``job_id, id, change``, unchanged findings left out.

    ``change`` is 'appeared', 'gone' or 'changed' (the same finding by identity, with other content). Content is compared by a
    hash, ``content``, which may be taken along from ``cross_check``, so evidence does not travel.
    """
    told = lambda found: F.col("content") if "content" in found.columns else content()
    old = before.select("job_id", "id", told(before).alias("_old"))
    new = after.select("job_id", "id", told(after).alias("_new"))
    both = old.join(new, ["job_id", "id"], "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    change = F.when(F.col("_old").isNull(), "appeared").when(F.col("_new").isNull(), "gone").otherwise("changed")
    return both.select("job_id", "id", change.alias("change"))
