import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.operators import chunking, embedding, facts, matching, scope, windows
from casebook.plans import evidence, index, retrieval
from casebook.sources import files


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# -- passages ------------------------------------------------------------------------

def test_split_follows_the_hand_trace():
    text = " ".join(f"term{i}" for i in range(260))
    got = [(p[0].split()[0], p[0].split()[-1]) for p in chunking.pack([text], [2], ["Findings"], 55, 8)]
    spans = [(0, 54), (47, 100), (94, 123), (120, 146), (143, 169), (166, 192), (189, 215), (212, 238), (235, 259)]
    assert got == [(f"term{a}", f"term{b}") for a, b in spans]
    assert all(p[1] <= 55 and p[2:] == (2, 2, "Findings") for p in chunking.pack([text], [2], ["Findings"], 55, 8))


def test_small_cases():
    one = chunking.pack(["A concise paragraph with useful information."], [3], [""], 80, 12)
    assert len(one) == 1 and one[0][2:4] == (3, 3)
    assert chunking.pack(["  ", "\n"], [None] * 2, [""] * 2) == []
    blocks = [" ".join(f"p{b}w{w}" for w in range(36)) for b in range(8)]
    got = chunking.pack(blocks, list(range(8)), [""] * 8, 84, 30)
    assert len(got) > 2 and len({p[0] for p in got}) == len(got) and all(p[1] <= 84 for p in got)


def fold(texts, limit, overlap):
    """The packing rule told as a plain loop."""
    size = lambda run: sum(chunking._tokens(t) for t in run)
    run, out = [], []
    for text in texts:
        clean = " ".join(text.split())
        for part, _ in chunking.split_text(clean, limit, overlap) if clean else []:
            if run and size(run) + size([part]) > limit:
                out.append(run)
                tail = []
                while overlap and len(tail) < len(run) and size(tail) < overlap and size(run[-len(tail) - 1:]) <= 2 * overlap:
                    tail = run[-len(tail) - 1:]
                while tail and size(tail) + size([part]) > limit:
                    tail = tail[1:]
                run = [*tail, part]
            else:
                run = [*run, part]
    return ["\n\n".join(r) for r in ([*out, run] if run else out)]


def words(rng, most):
    return " ".join("w" * rng.randint(1, 14) for _ in range(rng.randint(0, most)))


def test_packing_equals_the_plain_loop():
    rng = random.Random(7)
    for _ in range(400):
        n, limit, overlap = rng.randint(0, 60), rng.randint(3, 40), rng.choice([0, 1, 3, 5, 9, 20])
        texts = [words(rng, rng.choice([3, 10, 60])) for _ in range(n)]
        assert [p[0] for p in chunking.pack(texts, [None] * n, [""] * n, limit, overlap)] == fold(texts, limit, overlap)


def test_segments_give_the_same_passages(spark):
    rng = random.Random(3)
    data = [(d, o * 3 + 1, words(rng, 6), o // 10, f"s{o // 25}") for d, n in enumerate((5, 400, 1200, 90, 1)) for o in range(n)]
    df = spark.createDataFrame(data, "doc_id bigint, ord bigint, text string, page int, section string")
    for overlap in (0, 5):
        got = chunking.chunk_blocks(df, 20, overlap, segment=50)
        want = [
            (d, i, *p) for d in range(5)
            for i, p in enumerate(chunking.pack(*zip(*[r[2:] for r in data if r[0] == d]), 20, overlap))
        ]
        assert rows(got, *got.columns) == sorted(want)


# -- windows -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(5)
    data = [(c, t, rng.choice(["a", "b", None])) for c, n in ((1, 300), (2, 3), (3, 40)) for t in rng.sample(range(1000), n)]
    return data, spark.createDataFrame(data, "k int, t bigint, v string")


def test_blocked_windows_equal_plain_ones(turns):
    data, df = turns
    by_key = {k: sorted(r for r in data if r[0] == k) for k in (1, 2, 3)}
    carried, before, nxt, number = [], [], [], []
    for k, rs in by_key.items():
        last = None
        for i, (_, t, v) in enumerate(rs):
            last = v if v is not None else last
            carried.append((k, t, str(last)))
            before.append((k, t, [r[1] for r in rs[max(0, i - 8):i]]))
            nxt.append((k, t, rs[i + 1][1] if i + 1 < len(rs) else -1))
            number.append((k, t, i + 1))
    got = windows.carried_forward(df, ["k"], "t", F.col("v"), "c", 16).withColumn("c", F.coalesce("c", F.lit("None")))
    assert rows(got, "k", "t", "c") == sorted(carried)
    assert rows(windows.with_preceding(df, ["k"], "t", F.col("t"), 8, "p", 16), "k", "t", "p") == sorted(before)
    assert rows(windows.with_next(df, ["k"], "t", F.col("t"), "n", 16).fillna(-1, ["n"]), "k", "t", "n") == sorted(nxt)
    assert rows(windows.numbered(df, ["k"], "t", 16), "k", "t", "n") == sorted(number)


def test_top_k_is_cut_before_the_shuffle(turns, capsys):
    windows.top_k(turns[1], ["k"], [F.col("t")], 3).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


def test_interleave(spark):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate("aaabb")], "q int, rank int, d string")
    got = windows.interleaved(df, ["q"], "d", "rank", "n").orderBy("n").collect()
    assert [r.d for r in got] == ["a", "b", "a", "b", "a"]


# -- matching --------------------------------------------------------------------------

def brute(q, items, k, allowed):
    out = []
    for qi, qv in enumerate(q):
        sims = [(-round(float(qv @ v / (np.linalg.norm(qv) * np.linalg.norm(v))), 9), i) for i, v in enumerate(items) if allowed(qi, i)]
        out += [(qi, i, r + 1) for r, (_, i) in enumerate(sorted(sims)[:k])]
    return sorted(out)


@pytest.mark.parametrize("limit", [4096, 6])
def test_nearest_equals_brute_force(spark, monkeypatch, limit):
    """Equal vectors, a library holding a third of the items, one block and many."""
    monkeypatch.setattr(matching, "QUESTION_BLOCK", limit)
    monkeypatch.setattr(matching, "ITEM_BLOCK", 10 * limit)
    monkeypatch.setattr(matching, "SCORES_PER_SLICE", 500)
    rng = np.random.default_rng(1)
    items = rng.integers(-2, 3, (300, 6)).astype(float) + 0.5
    items[100:200] = items[0]
    lib = [str(i % 5) if i % 3 else "hot" for i in range(300)]
    q = rng.normal(size=(12, 6))
    q_lib = ["hot" if i % 2 else str(i % 5) for i in range(12)]
    allowed = lambda a, b: lib[b] == q_lib[a] or (lib[b] == "1" and a % 3 == 0)
    questions = spark.createDataFrame([(i, q[i].tolist(), q_lib[i], None, i % 3 == 0) for i in range(12)],
                                      "question_id int, vector array<double>, library string, thread string, use_reference boolean")
    table = spark.createDataFrame([(i, items[i].tolist(), lib[i], None, lib[i] == "1") for i in range(300)],
                                  "item_id bigint, vector array<double>, library string, thread string, is_reference boolean").repartition(7)
    assert rows(matching.nearest(questions, table, 40), "question_id", "item_id", "rank") == brute(q, items, 40, allowed)


@pytest.mark.parametrize("limit, indexed", [(200_000, True), (4, True), (4_096, False), (2, False)])
def test_lexical_list_equals_brute_force(spark, monkeypatch, limit, indexed):
    monkeypatch.setattr(matching, "QUESTION_BLOCK", limit)
    monkeypatch.setattr(matching, "ITEM_BLOCK", 10 * limit)
    monkeypatch.setattr(matching, "SCORES_PER_SLICE", 90)
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "weld", "hot"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) + (" hot" if i % 3 == 0 else "") for i in range(200)]
    asked = ["the hot weld", "gamma and delta", "welds of alpha", "nothing here", "hot"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, content string")
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id int, text string")
    got = retrieval.lexical_list(questions, chunks, retrieval.postings(chunks, []) if indexed else None, 40, scoped=False)
    want = []
    for qi, terms in enumerate((["hot", "weld"], ["gamma", "delta"], ["weld", "alpha"], [], ["hot"])):
        scored = [(-sum(t.split().count(x) for x in terms), i) for i, t in enumerate(texts)]
        want += [(qi, i, -s, r + 1) for r, (s, i) in enumerate(sorted(x for x in scored if x[0])[:40])]
    assert rows(got, "question_id", "chunk_id", "score", "rank") == sorted(want)


def test_one_plan_for_any_number_of_questions(spark, capsys, monkeypatch):
    monkeypatch.setattr(matching, "QUESTION_BLOCK", 2)
    chunks = spark.createDataFrame([(1, "a b")], "chunk_id bigint, content string")
    plans = []
    for n in (1, 50):
        questions = spark.createDataFrame([(i, "b") for i in range(n)], "question_id int, text string")
        retrieval.lexical_list(questions, chunks, None, 40, scoped=False).explain()
        plans.append(capsys.readouterr().out)
    assert plans[0].count("\n") == plans[1].count("\n") and "CartesianProduct" not in plans[1] and "NestedLoop" not in plans[1]


def test_a_question_is_embedded_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def embed(texts):
        asked.add(len(texts))
        return [[1.0, float(len(t)), 0.5] for t in texts]

    chunks = spark.createDataFrame([(i, i // 2, 0, f"word{i} text", [1.0, float(i), 0.0], f"f{i // 2}.pdf", 1, 1, "") for i in range(6)],
                                   "chunk_id bigint, doc_id bigint, chunk_index int, content string, vector array<float>, filename string, page_start int, page_end int, section string")
    known = spark.createDataFrame([(1, 0, "f0.pdf", 1, "t", "word1", "v")], "fact_id bigint, doc_id bigint, filename string, page int, locator string, label string, value string")
    questions = spark.createDataFrame([(1, "what is word1"), (2, "list all word2 rows")], "question_id int, text string")
    questions = embedding.with_vectors(questions, "text", embed, 3, optional=True)
    sources, labels = evidence.prepare(questions, chunks, chunks.select("doc_id", "filename").distinct(), known, scoped=False)
    assert sources.count() and labels.count() == 2
    assert asked.value == 2


def test_facts_and_figures(spark):
    table = spark.createDataFrame(
        [(1, None, "table 1", 1, ["Pump flow", "12 l/min"]), (1, None, "table 1", 2, ["Oil grade", "VG 46"]), (1, None, "table 1", 3, ["", ""]),
         (2, 2, "p. 2 table 1", 1, ["Valve", "Opens", "Closes"]), (2, 2, "p. 2 table 1", 2, ["V1", "3 bar", "2 bar"]), (2, 2, "p. 2 table 1", 3, ["V2", "", "5 bar"])],
        "doc_id bigint, page int, locator string, row int, cells array<string>")
    assert rows(facts.table_facts(table), "doc_id", "locator", "label", "value") == sorted([
        (1, "table 1 row 1", "Pump flow", "12 l/min"), (1, "table 1 row 2", "Oil grade", "VG 46"),
        (2, "p. 2 table 1 row 2", "V1.Opens", "3 bar"), (2, "p. 2 table 1 row 2", "V1.Closes", "2 bar"), (2, "p. 2 table 1 row 3", "V2.Closes", "5 bar")])
    long = spark.createDataFrame([(1, 1, "t", 1, ["l" * 900, "v" * 5000])], "doc_id bigint, page int, locator string, row int, cells array<string>")
    assert [(len(r.label), len(r.value)) for r in facts.table_facts(long).collect()] == [(900, 5000)]
    labels = spark.createDataFrame([(1, "Maximum bearing load"), (2, "Bearing diameter"), (3, "Seal material")], "fact_id bigint, label string")
    asked = spark.createDataFrame([(1, "Which maximum load may the bearing carry?"), (2, "Is sealing needed?")], "question_id int, text string")
    assert rows(facts.match_facts(asked, labels), "question_id", "fact_id") == [(1, 1)]
    figures = spark.createDataFrame([(1, 0, "Figure 3. G-7 gearbox, cut through the output shaft"), (2, 0, "Image from page 9")],
                                    "figure_id bigint, created_at int, caption string")
    requests = spark.createDataFrame([(1, "diagram: output shaft of the G-7 gearbox"), (2, "diagram of a cooling loop"), (3, "diagram")],
                                     "question_id int, text string")
    assert rows(facts.best_figures(requests, figures), "question_id", "figure_id") == [(1, 1)]


def test_duplicates_with_one_content_holding_a_third(spark):
    docs = spark.createDataFrame([(i, "lib" if i % 10 else None, "same" if i % 3 == 0 else f"h{i % 40}") for i in range(300)],
                                 "doc_id bigint, library string, sha256 string")
    seen, want = set(), []
    for i in range(300):
        key = "same" if i % 3 == 0 else f"h{i % 40}"
        want.append((i, bool(i % 10) and key in seen))
        if i % 10:
            seen.add(key)
    assert rows(files.mark_duplicates(docs), "doc_id", "duplicate") == want


# -- evidence ----------------------------------------------------------------------------

def test_spreadsheet_counts(spark):
    data = [
        ("w", "Tool crib.xlsx", "Tools", 0, "Sheet Tools — Row 2 — Shelf: 4 | Tool name: Reamer\nSheet Tools — Row 3 — Shelf: 5 | Tool name: Vice"),
        ("w", "Tool crib.xlsx", "Tools", 1, "Sheet Tools — Row 3 — Shelf: 5 | Tool name: Bench vice\nSheet Tools — Row 4 — Shelf: Subtotal | Tool name: 2"),
        ("p", "notes.pdf", "Tools", 0, "Sheet Tools — Row 2 — Tool name: Reamer"),
        ("b", "spares.XLSM", "Spares", 0, "Row 7 — Code: K2 | Kept: 9\nSheet Spares — Row 8 — Code: K5 | Kept: 1\nSheet Spares — Row 9 — Code: Grand Total | Kept: 10"),
        ("n", "nobody asks.xlsx", "S", 0, "Sheet S — Row 1 — A: 1"),
    ]
    data += [("b", "spares.XLSM", "Spares", i, f"Sheet Spares — Row {100 + i} — Code: L{i:02d} | Kept: 1") for i in range(1, 40)]
    chunks = spark.createDataFrame(data, "doc_id string, filename string, section string, chunk_index int, content string")
    asked = spark.createDataFrame([(1, "w"), (2, "p"), (3, "b"), (4, "w")], "question_id int, doc_id string")
    got = evidence.spreadsheet_counts(asked, chunks)
    spares = "; ".join(["K2", "K5", *(f"L{i:02d}" for i in range(1, 40))])
    tools = (2, "Tool name", "Reamer; Bench vice")
    assert rows(got, "question_id", "records", "label", "labels") == [(1, *tools), (3, 41, "Code", spares), (4, *tools)]


def test_sources_and_public_view(spark):
    passages = spark.createDataFrame([(1, 1, 7, "d1", "a.pdf", 3, 4, "", "x" * 3000, 8.25)],
                                     "question_id int, position int, chunk_id bigint, doc_id string, filename string, page_start int, page_end int, section string, content string, rerank_score double")
    known = spark.createDataFrame([(1, 1, "d1", "a.pdf", 2, "p. 2 table 1 row 3", "Vin max", "40 V")],
                                  "question_id int, rank int, doc_id string, filename string, page int, locator string, label string, value string")
    got = evidence.sources(passages, known).orderBy("index").collect()
    assert [(s["index"], s.location, s.exact) for s in got] == [(1, "pp. 3-4", False), (2, "p. 2 table 1 row 3", True)]
    assert len(got[0].snippet) == 2000 and got[1].snippet == "Vin max: 40 V"
    assert "content" not in evidence.public(evidence.sources(passages, known)).columns


def test_own_scorer_and_its_fallback(spark):
    full = spark.createDataFrame([(1, c, r, 0.01 / r, "q", f"passage {c}") for c, r in ((5, 1), (6, 2), (7, 3))],
                                 "question_id int, chunk_id bigint, rank int, rrf double, text string, content string")
    scorer = lambda questions, passages: [9.0 if p.endswith("7") else None for p in passages]
    got = evidence.rerank(full, 2, scorer).orderBy("position").collect()
    assert [r.chunk_id for r in got] == [7, 5] and got[1].rerank_score == 3.97


def test_embedder_contract(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "id int, t string").coalesce(1)

    def sized(n):
        def embed(texts):
            assert len(texts) <= embedding.BATCH
            return [[1.0] * n for _ in texts]

        return embed

    assert embedding.with_vectors(df, "t", sized(4), 4).filter(F.size("vector") == 4).count() == 60
    assert embedding.with_vectors(df, "t", sized(3), 4, optional=True).filter("vector IS NULL").count() == 60
    with pytest.raises(Exception, match="vectors of 4 numbers"):
        embedding.with_vectors(df, "t", sized(3), 4).count()


# -- index and access --------------------------------------------------------------------

def test_publish_points_last(spark, tmp_path):
    folder = str(tmp_path)
    assert index.current_version(spark, folder) is None
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, content string")
    index.publish({"chunks": old}, folder, "v1")
    fresh = spark.createDataFrame([(2, "c")], "doc_id bigint, content string")
    merged = index.replace_documents(index.read_part(spark, folder, "chunks", "v1"), fresh, fresh)
    index.publish({"chunks": merged}, folder, "v2")
    assert index.current_version(spark, folder) == "v2"
    assert rows(index.read_part(spark, folder, "chunks", "v2"), "doc_id", "content") == [(1, "a"), (2, "c")]


def test_a_failed_step_is_kept_beside_its_row(spark):
    def step(value):
        if value == "bad":
            raise ValueError("no table")
        return [value]

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "doc_id bigint, source string")
    got = rows(index.attempt(df, "source", step, "array<string>").fillna(""), "doc_id", "step_error")
    assert got == [(1, ""), (2, "no table")]


def test_files_are_scanned_and_logs_read(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "log.csv").write_text('Welder,WPS\n"W-1, old","WPS\n1"\n')
    (tmp_path / "tool.exe").write_text("x")
    found = {r.path.rsplit("/", 1)[1]: r.supported for r in files.scan(spark, [str(tmp_path)]).collect()}
    assert found == {"log.csv": True, "tool.exe": False}
    assert [r.cells for r in files.read_log(spark, str(tmp_path / "deep")).orderBy("row").collect()] == [["Welder", "WPS"], ["W-1, old", "WPS\n1"]]
    (tmp_path / "cases.json").write_text('[{"question": "q?", "expected_keyword": "150", "expected_source_file": "a.pdf"}]')
    assert files.read_evaluation(spark, str(tmp_path / "cases.json")).first().expected_keyword == "150"


def test_scope_counts_a_reference_library_once(spark):
    libraries = spark.createDataFrame([("a", False), ("r", True)], "library string, is_reference boolean")
    docs = spark.createDataFrame([(1, "a", None, "ready"), (2, "r", None, "ready"), (3, "r", None, "queued"), (4, None, "t1", "ready")],
                                 "doc_id bigint, library string, thread string, status string")
    asked = spark.createDataFrame([(1, "a", "t1", True), (2, "a", "t1", False), (3, "r", "t2", True), (4, None, "t9", False)],
                                  "question_id int, library string, thread string, use_reference boolean")
    assert rows(scope.scope_sizes(asked, docs, libraries), "question_id", "documents") == [(1, 3), (2, 2), (3, 1), (4, 0)]


def test_index_is_built_and_published(spark, tmp_path):
    docs = spark.createDataFrame([(1, "first line\nsecond"), (2, "other")], "doc_id bigint, text string")
    table = spark.createDataFrame([(1, None, "table 1", 1, ["Vin", "40 V"])], "doc_id bigint, page int, locator string, row int, cells array<string>")
    images = spark.createDataFrame([(2, "pdf", 1, 200, 150, 9), (2, "pdf", 2, 149, 500, 9), (2, "docx", 3, 0, 0, 5000)],
                                   "doc_id bigint, kind string, ord int, width int, height int, bytes int")
    index.publish(index.build(docs, table, images, dimensions=16), str(tmp_path), "v1")
    got = index.read_part(spark, str(tmp_path), "documents", "v1")
    assert rows(got, "doc_id", "passages", "facts", "figures") == [(1, 1, 1, 0), (2, 1, 0, 2)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of_equals_brute_force(spark, width):
    rng = random.Random(5)
    left = [(rng.choice(["a", "a", "b", "c", None]), rng.randint(-30, 60), i) for i in range(200)]
    right = [(rng.choice(["a", "a", "b", "d", None]), rng.randint(-30, 60), rng.randint(0, 9)) for _ in range(60)]
    frames = spark.createDataFrame(left, "k string, at int, id int"), spark.createDataFrame(right, "k string, day int, v int")
    got = windows.as_of(*frames, ["k"], F.col("at"), F.col("day"), F.col("v"), "last", width)
    want = []
    for k, at, i in left:
        held = [(day, v) for key, day, v in right if key == k and day <= at]
        want.append((i, k, max(held)[1] if held else None))
    assert sorted((r.id, r.k, r["last"]) for r in got.filter("k IS NOT NULL").collect()) == sorted(w for w in want if w[1] is not None)
    assert got.columns == ["k", "at", "id", "last"] and got.count() == 200
