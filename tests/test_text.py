import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casebook.functions import calculators as calc
from casebook.functions import replies, scoring
from casebook.functions import text as tx
from casebook.sources import blocks, files


def apply(spark, build, rows, schema="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    cols = [F.col(c) for c in df.columns]
    return [r.v for r in df.coalesce(1).select(build(*cols).alias("v")).collect()]


def test_classes(spark):
    texts = ["Please enumerate the pumps", "What is the total number of open orders?", "Describe how the crew is paid",
             "Give a comparison of both mills", "mill A versus mill B", "At which speed does mill A run?"]
    assert apply(spark, tx.is_exhaustive, texts) == [True, True, False, False, False, False]
    assert apply(spark, tx.is_comparison, texts) == [False, False, False, True, True, False]


def test_tokens(spark):
    got = apply(spark, lambda a: F.array_sort(tx.content_tokens(a)), ["the loading ramp", "RX-8 wiring", ""])
    assert got == [["loading", "ramp"], ["rx-8", "wiring"], []]
    assert apply(spark, lambda a: tx.lexical_terms(a), ["which valves of the boilers", "who with what", "été"]) == [
        ["boiler", "valve"], ["what", "who", "with"], ["t"]]
    many = " ".join(f"term{chr(97 + i)}" for i in range(26))
    assert [len(t) for t in apply(spark, tx.lexical_terms, [many])] == [26]
    assert [len(t) for t in apply(spark, lambda a: tx.lexical_terms(a, 16), [many])] == [16]


def test_diagram_requests(spark):
    got = apply(spark, tx.diagram_request, ["diagram: oil circuit", "/diagram shift plan", "Diagram - hoist brake",
                                            "Where is the diagram of the hoist?", "diagram:"])
    assert got == ["oil circuit", "shift plan", "hoist brake", None, None]


def test_empty_answers(spark):
    got = apply(spark, tx.says_nothing, ["None.", "FROM THE DOCUMENTS:\nNone.\n\nADDITIONAL INSIGHT:\nNone.", "**FROM THE DOCUMENTS:** None",
                                         "FROM THE DOCUMENTS: None of them gives a torque [3].", "Torque is 40 Nm [1]."])
    assert got == [True, True, True, False, False]


def test_token_estimate_matches_a_plain_count(spark):
    def plain(text):
        pieces = re.findall(r"\w+|[^\w\s]", text)
        return max(1, sum((len(p) + 5) // 6 if re.match(r"\w", p) else 1 for p in pieces))

    seen = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.characters(max_codepoint=0x4FF, categories=("L", "Nd", "P", "Zs", "Sm")), max_size=80))
    def collect(text):
        seen.append(text)

    collect()
    assert apply(spark, tx.token_count, seen) == [plain(t) for t in seen]


def test_scores_of_replies(spark):
    rows = [("[7, 0, 10]", 3), ("```json\n[7, 3]\n```", 2), ("[12, -3]", 2), ("[1, 2, 3, 4]", 2), ("[7]", 3), ('["a", "b"]', 2),
            ("no idea", 2), ("[1, null]", 2), ("[true, 1]", 2), ('{"a": 1}', 2)]
    got = apply(spark, replies.parse_scores, rows, "a string, b int")
    assert got == [[7, 0, 10], [7, 3], [10, 0], [1, 2], [7], [], [], [], [], []]
    fallback = F.array(F.lit(6.5), F.lit(2.0), F.lit(1.0))
    assert apply(spark, lambda a, b: replies.fill_scores(replies.parse_scores(a, b), fallback), [("[7]", 3)], "a string, b int") == [[7, 2, 1]]


def test_memory_replies(spark):
    got = apply(spark, replies.parse_memory, [
        '{"worth_remembering": true, "entry_type": "decision", "content": " Use E7018 "}',
        'Here: {"worth_remembering": true, "entry_type": "rumour", "content": "x"} ok', '{"worth_remembering": false, "content": "x"}', "none",
        '{"worth_remembering": true, "content": ""}'])
    assert [tuple(g) if g else None for g in got] == [("decision", "Use E7018"), ("fact", "x"), None, None, None]


def test_split_answers(spark):
    got = apply(spark, replies.split_answer, [
        "FROM THE DOCUMENTS:\nTen [1].\n\n## Additional insight:\nMore.", "**From the documents:**\nTen [1].\n\nADDITIONAL INSIGHT:\nNone.",
        "Ten [1].\nNone.", "Plain"])
    assert [tuple(g) for g in got] == [("Ten [1].", "More."), ("Ten [1].", ""), ("Ten [1].", ""), ("Plain", "")]


def test_citations_and_scores(spark):
    assert apply(spark, lambda a: scoring.valid_citations(a, F.lit(3)), ["x [1] [4] [2](http) [03] [0]"]) == [[1, 3]]
    top = apply(spark, scoring.retrieval_score, [(scoring.MAX_RRF,), (scoring.MAX_RRF / 2,), (0.0,)], "a double")
    assert top == [6.5, 3.25, 0.0] and all(s < 7 for s in top)


def test_confidence(spark):
    rows = [(9.0, 2, 0), (5.0, 1, 0), (2.0, 1, 0), (None, 0, 0), (1.0, 1, 1), (None, 0, 1)]
    got = apply(spark, scoring.confidence, rows, "a double, b int, c int")
    assert got == ["high", "medium", "low", "none", "medium", "medium"]


def test_locations(spark):
    got = apply(spark, scoring.location, [(3, 4, ""), (3, 3, "x"), (3, None, ""), (None, None, "Table 1"), (None, None, "")], "a int, b int, c string")
    assert got == ["pp. 3-4", "p. 3", "p. 3", "Table 1", "Document"]


def test_heat_input(spark):
    rows = [(24.0, 180.0, 150.0, "smaw"), (30.0, 500.0, 400.0, "SAW"), (12.0, 120.0, 100.0, "GTAW"), (24.0, 180.0, 0.0, "SMAW"),
            (24.0, 180.0, 150.0, "OXY"), (24.0, 180.0, 5000.0, "GMAW")]
    got = apply(spark, calc.heat_input, rows, "a double, b double, c double, d string")
    assert [(g.arc_energy, g.heat_input) for g in got[:3]] == [(1.728, 1.382), (2.25, 2.25), (0.864, 0.518)]
    assert got[3].error and got[4].error and got[3].heat_input is None and got[5].warnings and not got[0].warnings


def test_carbon_equivalent(spark):
    build = lambda c, mn, cr: calc.carbon_equivalent({"C": c, "Mn": mn, "Cr": cr})
    got = apply(spark, build, [(0.2, 1.2, 0.0), (0.08, 2.2, 0.0), (-0.1, 1.0, 0.0)], "a double, b double, c double")
    assert got[0].ce_iiw == 0.4 and got[0].warnings == []
    assert any("Mn" in w for w in got[1].warnings) and any("Pcm" in w for w in got[1].warnings)
    assert got[2].error and got[2].ce_iiw is None


def test_preheat(spark):
    got = apply(spark, calc.preheat, [(0.35, 30.0, 5.0, 1.5), (0.25, 12.0, 2.0, 2.0), (0.6, 120.0, 5.0, 1.0)], "a double, b double, c double, d double")
    assert (got[0].preheat_c, got[0].required, got[0].warnings) == (116, True, [])
    assert got[1].required is False and got[2].warnings


def test_calculation_questions(spark):
    got = apply(spark, calc.calculation, [
        "What is the heat input for 24 V, 160 A at 150 mm/min with SMAW?", "Calculate heat input: SMAW, 24 volts, 160 amps, 2.5 mm/s",
        "What is the heat input at 24 V and 160 A?", "What heat input limit does WPS-SMAW-017 set?", "What preheat does WPS-SMAW-017 require?",
        "Summarise the PQR-017 test results", "What is the carbon equivalent for C 0.18, Mn 1.4?"])
    assert [g.kind if g else None for g in got] == ["heat_input", "heat_input", "missing_inputs", None, None, None, "composition"]
    assert got[1].speed == 150.0 and got[2].missing == ["travel speed", "process"]


def test_html_blocks(spark):
    page = ("<html><head><title>t</title><style>p{}</style></head><body><nav><p>menu</p></nav><h1>Head <b>line</b></h1><p>One<br>two &amp; three"
            "<ul><li> item </li></ul><table><tr><th>a</th><td>b<p>inner</p></td></tr></table><script>var t='<p>';</script><footer><p>foot</p></footer></body></html>")
    rows = blocks.html(spark.createDataFrame([(1, page), (2, "")], "page_id bigint, html string")).orderBy("ord").collect()
    assert [(r.text, r.section) for r in rows] == [
        ("Head line", "Heading"), ("One two & three item a b inner", ""), ("item", ""), ("a", ""), ("b inner", ""), ("inner", "")]


def test_markdown_and_lines(spark):
    docs = spark.createDataFrame([(1, "intro\n# Launch plan\n\n  Ship it\n## Next #\nlater"), (2, "no heading")], "doc_id bigint, text string")
    got = [(r.doc_id, r.text, r.section) for r in blocks.markdown(docs).orderBy("doc_id", "ord").collect()]
    assert got == [(1, "intro", ""), (1, "# Launch plan", "Launch plan"), (1, "Ship it", "Launch plan"), (1, "## Next #", "Next #"),
                   (1, "later", "Next #"), (2, "no heading", "")]


def test_sheet_records(spark):
    cells = [(1, "Roster", 1, 1, "Students Due List", True), (1, "Roster", 3, 1, "Student Name", True), (1, "Roster", 3, 2, "Student ID", True),
             (1, "Roster", 3, 3, "Status", True)]
    for i in range(60):
        cells += [(1, "Roster", 4 + i, 1, f"Student {i + 1}", True), (1, "Roster", 4 + i, 2, str(i + 1), False), (1, "Roster", 4 + i, 4, "Due", True)]
    df = spark.createDataFrame(cells, "doc_id bigint, sheet string, row int, col int, value string, is_text boolean")
    rows = blocks.sheet_records(df).orderBy("ord").collect()
    assert len(rows) == 60 and rows[0].ord == 4 and rows[-1].ord == 63
    assert rows[0].text == "Sheet Roster — Row 4 — Student Name: Student 1 | Student ID: 1 | Column 4: Due"


def sheet(spark, *rows):
    cells = [(1, "S", i, j, v, not v.isdigit()) for i, row in rows for j, v in enumerate(row, 1)]
    return spark.createDataFrame(cells, "doc_id bigint, sheet string, row int, col int, value string, is_text boolean")


def test_sheet_header_is_chosen_by_order(spark):
    body = [(i, (f"part {i}", "7")) for i in range(2, 60)]
    wordy = sheet(spark, (1, ("Name", "Qty")), *body, (60, ("nut", "many", "see note")), (61, ("bolt", "8")))
    rows = blocks.sheet_records(wordy).orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(2, 62))
    assert rows[58].text == "Sheet S — Row 60 — Name: nut | Qty: many | Column 3: see note"
    assert [r.ord for r in blocks.sheet_records(wordy, header_rows=20).orderBy("ord").collect()] == list(range(2, 62))
    # nothing above the first number: the first row; no number at all: the first row of two cells
    years = sheet(spark, (1, ("Region", "2023")), (2, ("north", "5")), (3, ("a", "b", "c")))
    assert [r.text for r in blocks.sheet_records(years).orderBy("ord").collect()] == ["Sheet S — Row 2 — Region: north | 2023: 5", "Sheet S — Row 3 — Region: a | 2023: b | Column 3: c"]
    words = sheet(spark, (1, ("Title",)), (2, ("Name", "State")), (3, ("x", "due")), (4, ("y", "late", "twice")))
    assert [r.ord for r in blocks.sheet_records(words).orderBy("ord").collect()] == [3, 4]


def test_captions(spark):
    got = apply(spark, lambda a: blocks.caption(a, F.lit(5)), ["text\n Figure 3. Power tree\nmore", "as the diagram shows", "nothing"])
    assert got == ["Figure 3. Power tree", "as the diagram shows", "Image from page 5"]


def test_admission(spark):
    given_files = [("a.PDF", 3), ("a", 3), ("b.exe", 3), ("c.md", 0), ("d.txt", 60_000_000)]
    got = apply(spark, lambda a, b: files.reject_reason(files.extension(a), b), given_files, "a string, b bigint")
    assert got == [None, "unsupported type", "unsupported type", "empty", None]
    got = apply(spark, lambda a, b: files.reject_reason(files.extension(a), b, 50_000_000), given_files, "a string, b bigint")
    assert got[-1] == "too large"
