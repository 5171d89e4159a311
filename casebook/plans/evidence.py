"""From candidates to cited evidence: reranking, confidence, numbered sources, spreadsheet counts, audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions import scoring as sc
from casebook.functions import text as tx
from casebook.operators.matching import small_side
from casebook.operators.windows import interleaved, top_k
from casebook.plans.lexical import LexicalIndex
from casebook.session import durable

Scorer = Callable[[list[str], list[str]], list[float]]
JOIN_BLOCK = 256
SNIPPET_CHARS = 2000


def word_score(question: Column, passage: Column) -> Column:
    """Default scorer: three points per shared distinct word, at most ten."""
    shared = F.size(F.array_intersect(tx.hyphen_words(question), tx.hyphen_words(passage)))
    return F.least(F.lit(10), shared * 3).cast("double")


def scored(candidates: DataFrame, scorer: Scorer | None = None, window: int | None = None) -> DataFrame:
    """Add ``rerank_score`` to (question text, content) rows; a scorer that gives null falls back to fusion.

    ``window`` limits how many characters of a passage the scorer reads; by default it reads all.
    """
    seen = F.col("content") if window is None else F.left("content", F.lit(window))
    if scorer is None:
        return candidates.withColumn("rerank_score", word_score(F.col("text"), seen))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(rerank_score=scorer(frame["text"].tolist(), frame["_seen"].tolist())).drop(columns="_seen")

    staged = candidates.withColumn("_seen", seen)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)
    out = staged.mapInPandas(run, schema + ", rerank_score double")
    return out.withColumn("rerank_score", F.coalesce("rerank_score", sc.retrieval_score(F.col("rrf"))))


def rerank(candidates: DataFrame, k: int = sc.KEPT, scorer: Scorer | None = None) -> DataFrame:
    """The k best candidates by score; equal scores keep their order."""
    order = [F.col("rerank_score").desc(), F.col("rank")]
    return top_k(scored(candidates, scorer), ["question_id"], order, k, "position")


def diversified(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Comparison questions take their candidates document by document."""
    flags = questions.select("question_id", tx.is_comparison(F.col("text")).alias("_compare"))
    mixed = interleaved(candidates, ["question_id"], "doc_id", "rank", "_spot")
    return (
        mixed.join(flags, "question_id")
        .withColumn("rank", F.when(F.col("_compare"), F.col("_spot")).otherwise(F.col("rank")))
        .drop("_spot", "_compare")
    )


def sources(passages: DataFrame, facts: DataFrame, snippet_chars: int | None = SNIPPET_CHARS) -> DataFrame:
    """Numbered sources per question, passages before facts.

    ``passages``: question_id, position, chunk_id, doc_id, filename, page_start, page_end, section, content,
    rerank_score. ``facts``: question_id, rank, doc_id, filename, page, locator, label, value. Positions and ranks count
    from 1 without gaps, so facts are numbered on from the last position and no window holds a whole document. A snippet
    is the first ``snippet_chars`` of its passage, or with None the whole passage, as all plans here ask for.
    """
    text = F.concat_ws(": ", "label", "value")
    p = passages.select(
        "question_id", F.lit("passage").alias("kind"), F.col("position").alias("_rank"), "chunk_id", "doc_id", "filename",
        "page_start", "page_end", F.coalesce("section", F.lit("")).alias("section"),
        sc.location(F.col("page_start"), F.col("page_end"), F.col("section")).alias("location"),
        (F.col("content") if snippet_chars is None else F.left("content", F.lit(snippet_chars))).alias("snippet"), "content",
        F.round("rerank_score", 1).alias("score"), F.lit(False).alias("exact"),
    )
    f = facts.select(
        "question_id", F.lit("fact").alias("kind"), F.col("rank").alias("_rank"), "doc_id", "filename",
        F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.col("locator").alias("section"),
        F.col("locator").alias("location"), text.alias("snippet"),
        F.concat(F.lit("(value read from a table) "), text).alias("content"), F.lit(True).alias("exact"),
    )
    last = passages.groupBy("question_id").agg(F.max("position").alias("_last"))
    f = f.join(last, "question_id", "left").withColumn("_rank", F.coalesce("_last", F.lit(0)) + F.col("_rank")).drop("_last")
    both = p.unionByName(f, allowMissingColumns=True)
    return both.withColumn("index", F.col("_rank").cast("int")).drop("_rank")


def public(rows: DataFrame) -> DataFrame:
    """What leaves the engine: everything but the full text."""
    return rows.drop("content")


def confidence_labels(questions: DataFrame, passages: DataFrame, facts: DataFrame) -> DataFrame:
    """Confidence per question from its kept passages and facts."""
    best = passages.groupBy("question_id").agg(F.max("rerank_score").alias("_best"), F.count(F.lit(1)).alias("passages"))
    exact = facts.groupBy("question_id").agg(F.count(F.lit(1)).alias("facts"))
    joined = questions.select("question_id").join(best, "question_id", "left").join(exact, "question_id", "left")
    joined = joined.fillna(0, ["passages", "facts"])
    return joined.select(
        "question_id", "passages", "facts", sc.confidence(F.col("_best"), F.col("passages"), F.col("facts")).alias("confidence")
    )


# Fixed value: what stands in place of the evidence of a question without sources.
EMPTY_EVIDENCE = "No matching passages were found in the selected knowledge base or chat uploads."


def joined_text(rows: DataFrame, keys: list[str], block: Column, order: list[str], text: str, between: str) -> DataFrame:
    """``text`` and ``n`` by key: the texts of its rows in order, put together block by block and then from the blocks.

    ``block`` must rise with the order. A key's rows are many small lists this way; only the finished text is one value.
    """
    inner = F.array_sort(F.collect_list(F.struct(*order, text)))
    blocks = rows.withColumn("_block", block).groupBy(*keys, "_block").agg(
        F.array_join(F.transform(inner, lambda r: r[text]), between).alias("_piece"), F.count(F.lit(1)).alias("_n"))
    outer = F.array_sort(F.collect_list(F.struct("_block", "_piece")))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(outer, lambda r: r["_piece"]), between).alias("text"), F.sum("_n").alias("n"))


def evidence_text(numbered: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """One text per question with all its numbered sources (A19); with ``questions``, a fixed text for those without any."""
    entry = F.format_string("[%d] %s (%s)\n%s", "index", "filename", "location", "content")
    rows = numbered.select("question_id", "index", entry.alias("entry"))
    block = F.floor(F.col("index") / JOIN_BLOCK)
    packs = joined_text(rows, ["question_id"], block, ["index"], "entry", "\n\n").select("question_id", F.col("text").alias("evidence"), F.col("n").alias("sources"))
    if questions is None:
        return packs
    return questions.select("question_id").join(packs, "question_id", "left").fillna(EMPTY_EVIDENCE, ["evidence"]).fillna(0, ["sources"])


def prepare(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, facts: DataFrame, vectors: DataFrame | None = None,
    index: DataFrame | LexicalIndex | None = None, scorer: Scorer | None = None, floor: float = sc.MIN_SIMILARITY, scoped: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(sources, confidence) of a batch of questions."""
    return _prepared(questions, chunks, documents, facts, vectors, index, scorer, floor, scoped)[:2]


def prepared_answers(
    questions: DataFrame, messages: DataFrame, chunks: DataFrame, documents: DataFrame, facts: DataFrame, vectors: DataFrame | None = None,
    index: DataFrame | LexicalIndex | None = None, scorer: Scorer | None = None, floor: float = sc.MIN_SIMILARITY, scoped: bool = True,
) -> DataFrame:
    """All that a model is asked with, a row per question (P3): ``exhaustive, confidence, sources, evidence, evidence_found``,
    the counted spreadsheet ``records, label, labels`` (null without a workbook), ``history``, ``context_tokens`` and ``num_ctx``, which is that within a model's limits.

    ``messages``: question_id, turn, role, text - the turns before each question. A count/list question sees the last two user
    turns only, since earlier answers may hold the very mistake that counting corrects, and its context grows with its evidence.
    """
    sources_, labels, asked, chosen = _prepared(questions, chunks, documents, facts, vectors, index, scorer, floor, scoped)
    flags = asked.select("question_id", tx.is_exhaustive(F.col("text")).alias("exhaustive"))
    packs = evidence_text(sources_, flags)
    tokens = sources_.groupBy("question_id").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length("content") / 4))).alias("_tokens"))
    counted = spreadsheet_counts(chosen, chunks).select("question_id", "records", "label", "labels")

    turns = messages.join(flags, "question_id")
    last = top_k(turns.filter("exhaustive AND role = 'user'"), ["question_id"], [F.col("turn").desc()], 2, "_n").drop("_n")
    heard = turns.filter("NOT exhaustive").unionByName(last)
    spoken = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    past = heard.groupBy("question_id").agg(spoken.alias("history"), F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).alias("_said"))

    rows = flags.join(labels.select("question_id", "confidence"), "question_id", "left")
    for part in (packs, tokens, counted, past):
        rows = rows.join(part, "question_id", "left")
    budget = sc.context_budget(F.col("exhaustive"), F.col("_tokens"), F.col("_said"))
    rows = rows.withColumn("context_tokens", sc.context_tokens(F.col("_tokens"), F.col("_said")))
    return rows.withColumn("evidence_found", F.col("sources") > 0).withColumn("num_ctx", budget).drop("_tokens", "_said")


def _prepared(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, facts: DataFrame, vectors: DataFrame | None, index: DataFrame | LexicalIndex | None,
    scorer: Scorer | None, floor: float, scoped: bool,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sources, confidence, questions as written, documents chosen for count/list questions).

    Count/list questions take a whole document; the others take reranked passages and exact facts.
    """
    from casebook.operators.facts import match_facts
    from casebook.plans.retrieval import chosen_document, once, retrieve, whole_document

    questions, n = once(questions)
    marked = questions.withColumn("_all", tx.is_exhaustive(F.col("text")))
    listing, ordinary = marked.filter("_all").drop("_all"), marked.filter("NOT _all").drop("_all")

    columns = ["chunk_id", "filename", "page_start", "page_end", "section", "content"]
    fused = durable(retrieve(ordinary, chunks, vectors, index, sc.CANDIDATES, floor, scoped, n_questions=n))
    candidates = diversified(fused, ordinary).join(ordinary.select("question_id", "text"), "question_id")
    full = chunks.select(*columns).join(small_side(candidates, n, sc.CANDIDATES), "chunk_id")
    kept = rerank(full, sc.KEPT, scorer)

    asked = ordinary.select("question_id", "text", *(["library", "thread", "use_reference"] if scoped else []))
    matched = match_facts(asked, facts, scoped)
    known = facts.select("fact_id", "doc_id", "filename", "page", "locator", "label", "value")
    exact = known.join(small_side(matched.select("question_id", "fact_id", "rank"), n, sc.FACT_LIMIT), "fact_id")

    chosen = chosen_document(listing, chunks, documents, vectors, index, floor, scoped, n)
    whole = whole_document(chosen, chunks, questions=n)
    passages = kept.select("question_id", "position", "doc_id", *columns, "rerank_score").unionByName(
        whole.select("question_id", F.col("rank").alias("position"), "doc_id", *columns, F.lit(None).cast("double").alias("rerank_score"))
    )
    complete = whole.groupBy("question_id").agg(
        F.bool_and("document_complete").alias("complete"), F.count(F.lit(1)).alias("passages")
    )
    listing_label = listing.select("question_id").join(complete, "question_id", "left").select(
        "question_id", F.coalesce("passages", F.lit(0)).alias("passages"), F.lit(0).cast("bigint").alias("facts"),
        sc.exhaustive_confidence(F.coalesce("passages", F.lit(0)), F.coalesce("complete", F.lit(False))).alias("confidence"),
    )
    labels = confidence_labels(ordinary, kept, exact).unionByName(listing_label)
    return sources(passages, exact, None), labels, questions, chosen


# -- spreadsheets ------------------------------------------------------------------

# Fixed value: a record line of a spreadsheet passage.
RECORD = r"(?m)^(?:Sheet (.*?) — )?Row ([0-9]+) — (.*)$"
# Cell texts that mark a summary row.
SUMMARY_VALUES = ("total", "grand total", "subtotal", "sub total", "overall total", "sum")


def records(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Record lines of passages as (sheet, row, fields) (C13). ``fields`` keeps the column order."""
    line = F.explode(F.regexp_extract_all("content", F.lit(RECORD), F.lit(0)))
    rows = chunks.select(*keys, *order, "section", line.alias("line"))
    cell = lambda c: F.struct(
        F.trim(F.substring_index(c, ": ", 1)).alias("header"),
        F.trim(F.substr(c, F.instr(c, ": ") + 2)).alias("value"),
    )
    cells = F.filter(F.split(F.regexp_extract("line", RECORD, 3), r" \| "), lambda c: F.contains(c, F.lit(": ")))
    sheet = F.regexp_extract("line", RECORD, 1)
    return rows.select(
        *keys, *order,
        F.when(sheet != "", sheet).otherwise(F.coalesce("section", F.lit(""))).alias("sheet"),
        F.regexp_extract("line", RECORD, 2).cast("bigint").alias("row"),
        F.transform(cells, cell).alias("fields"),
    )


def spreadsheet_counts(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counted records of the selected workbooks, with their names in sheet order.

    ``selected``: question_id, doc_id. ``chunks``: doc_id, filename, section, chunk_index, content. Every workbook is
    counted once, over its whole passage table, and only the counts are joined to the questions.
    """
    keys = ["doc_id", "filename"]
    book = chunks.filter(F.lower("filename").rlike(r"\.xls[xm]$")).join(selected.select("doc_id").distinct(), "doc_id", "left_semi")
    found = records(book, keys, ["chunk_index"])
    # a row repeated across passages counts once; the last wording wins, the first place is kept
    distinct = found.groupBy(*keys, "sheet", "row").agg(
        F.max_by("fields", "chunk_index").alias("fields"), F.min("chunk_index").alias("rank")
    )
    data = distinct.filter(~F.exists("fields", lambda c: F.lower(c["value"]).isin(*SUMMARY_VALUES)))
    # Columns by their first place in the workbook, combined in the map tasks; the first that names something is the label.
    place = F.struct("rank", "row", "sheet", "_i")
    columns = data.select(*keys, "rank", "row", "sheet", F.posexplode("fields").alias("_i", "_cell")).select(*keys, place.alias("_place"), "_cell.header")
    names = F.lower("header").contains("name")
    labels = columns.groupBy(*keys).agg(F.min_by("header", F.when(names, F.col("_place"))).alias("_named"), F.min_by("header", "_place").alias("_first"))
    labels = labels.select(*keys, F.coalesce("_named", "_first").alias("label"))
    value = F.try_element_at(F.transform(F.filter("fields", lambda c: c["header"] == F.col("label")), lambda c: c["value"]), F.lit(-1))
    valued = data.join(labels, keys).select(*keys, "rank", "row", "sheet", value.alias("value")).filter("value <> ''")
    told = joined_text(valued, keys, F.floor(F.col("rank") / JOIN_BLOCK), ["rank", "row", "sheet"], "value", "; ")
    told = told.select(*keys, F.col("n").cast("int").alias("labelled"), F.col("text").alias("labels"))
    counted = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("records")).join(labels, keys, "left").join(told, keys, "left")
    counted = counted.select(*keys, "records", "label", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("labels", F.lit("")).alias("labels"))
    return selected.select("question_id", "doc_id").join(counted, "doc_id")


# -- figures, audits, views ----------------------------------------------------------

def figure_or_passages(
    requests: DataFrame, figures: DataFrame, chunks: DataFrame, scoped_figures: bool = False, vectors: DataFrame | None = None, index: DataFrame | LexicalIndex | None = None, floor: float = sc.MIN_SIMILARITY, scoped: bool = True,
) -> DataFrame:
    """The matching figure of each diagram request, else the six best passages (P5)."""
    from casebook.operators.facts import best_figures
    from casebook.plans.retrieval import once, retrieve

    requests, n = once(requests)
    asked = requests.select("question_id", "text", *(["library", "thread", "use_reference"] if scoped else []))
    found = best_figures(asked, figures, scoped_figures).select("question_id", "figure_id")
    rest = requests.join(found, "question_id", "left_anti")
    passages = retrieve(rest, chunks, vectors, index, 6, floor, scoped, n_questions=n).select("question_id", "rank", "chunk_id")
    return found.select("question_id", F.lit(1).alias("rank"), "figure_id").unionByName(passages, allowMissingColumns=True)


# Signs of a two-part answer and of pasted excerpts.
TWO_PARTS = r"(?i)from the documents"
PASTED = r"\[[0-9]+\] \S+\.(pdf|docx|xlsx) \(|Exact table value -|value read from a table"


def audit(answers: DataFrame, first: int | None = None) -> DataFrame:
    """Checks of generated answers (P10).

    ``answers``: question_id, answer, expected (array), expected_source, sources (array of file names). The expected source
    may stand anywhere among them, or among the ``first`` so many.
    """
    said = F.lower("answer")
    return answers.select(
        "question_id",
        F.forall("expected", lambda e: F.contains(said, F.lower(e))).alias("states_facts"),
        F.array_contains(F.col("sources") if first is None else F.slice("sources", 1, first), F.col("expected_source")).alias("cites_source"),
        F.col("answer").rlike(r"\[[0-9]+\]").alias("has_citations"),
        F.col("answer").rlike(TWO_PARTS).alias("two_parts"),
        (~F.col("answer").rlike(PASTED)).alias("not_pasted"),
    )


def stored_answer(answer: Column) -> Column:
    """The answer kept in the thread; one that says nothing is replaced."""
    from casebook.functions.replies import NOT_IN_DOCUMENTS

    return F.when(tx.says_nothing(answer), F.lit(NOT_IN_DOCUMENTS)).otherwise(answer)


def highlighted(runs: DataFrame, cited: DataFrame, on: list[str]) -> DataFrame:
    """Text runs of a page that belong to the cited passage.

    ``runs``: on, run; ``cited``: on, snippet.
    """
    run = tx.fold(F.col("run"))
    return runs.join(cited, on).withColumn("marked", (F.length(run) >= 4) & F.contains(tx.fold(F.col("snippet")), run))


def remembers(exchanges: DataFrame, libraries: DataFrame) -> DataFrame:
    """Exchanges that may leave a memory: evidence found, not count/list, own library."""
    kept = exchanges.filter(F.col("evidence_found") & ~tx.is_exhaustive(F.col("question")))
    return kept.join(libraries.filter("NOT is_reference").select("library"), "library")
