"""Hybrid retrieval for a table of questions: two ranked lists, fused; whole documents for count/list questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions import scoring as sc
from casebook.functions import text as tx
from casebook.operators.facts import best_filename
from casebook.operators.matching import nearest, shared_terms, small_side, term_rows
from casebook.operators.windows import first_row, numbered, top_k
from casebook.plans.lexical import LexicalIndex, search
from casebook.session import durable

SCOPE_COLUMNS = ["library", "thread", "is_reference"]
PASSAGE_BLOCK = 4096


def once(questions: DataFrame) -> tuple[DataFrame, int]:
    """The questions written, so that an embedder behind them is not asked again by every later step, and their number."""
    kept = durable(questions)
    return kept, kept.count()


def ready(chunks: DataFrame, documents: DataFrame, libraries: DataFrame) -> DataFrame:
    """Passages of ready documents with their scope columns and file name."""
    reference = libraries.filter("is_reference").select("library", F.lit(True).alias("is_reference"))
    shown = documents.filter("status = 'ready'").join(reference, "library", "left").fillna(False, ["is_reference"])
    return chunks.join(shown.select("doc_id", "filename", *SCOPE_COLUMNS), "doc_id")


def postings(chunks: DataFrame, carry: list[str]) -> DataFrame:
    """(chunk_id, term, weight) with weight the number of uses.

    Written out, sorted by term, this is the lexical index: a batch of questions then reads the terms it asks for.
    """
    return term_rows(chunks.withColumnRenamed("chunk_id", "item_id"), "item_id", tx.words(F.col("content")), carry)


def lexical_list(
    questions: DataFrame, chunks: DataFrame, index: DataFrame | LexicalIndex | None = None, k: int = sc.LIST_SIZE, scoped: bool = True
) -> DataFrame:
    """The k passages per question with most uses of its terms.

    With an ``index`` (a written ``LexicalIndex``, or a ``postings`` table) only the asked words are read; without one the
    passages are read as they are.
    """
    asked = questions.withColumn("terms", tx.lexical_terms(F.col("text")))
    asked = asked.select("question_id", "terms", *(["library", "thread", "use_reference"] if scoped else []))
    if isinstance(index, LexicalIndex):
        if index.scoped != scoped:
            raise ValueError("the index must be scoped as the search is")
        found = search(asked, index, k)
        return found.select("question_id", F.col("item_id").alias("chunk_id"), "score", "rank")
    index = postings(chunks, SCOPE_COLUMNS if scoped else []) if index is None else index
    found = shared_terms(asked, index, k, scoped)
    return found.select("question_id", F.col("item_id").alias("chunk_id"), "score", "rank")


def vector_list(questions: DataFrame, chunks: DataFrame, k: int = sc.LIST_SIZE, scoped: bool = True) -> DataFrame:
    """The k nearest passages per question by cosine."""
    items = chunks.withColumnRenamed("chunk_id", "item_id")
    return nearest(questions, items, k, scoped=scoped).withColumnRenamed("item_id", "chunk_id")


def fuse(vectors: DataFrame, words: DataFrame, floor: float = sc.MIN_SIMILARITY) -> DataFrame:
    """Weighted rank fusion of the two lists (J8, E19); the floor drops vector hits but not their ranks."""
    near = vectors.filter(F.col("similarity") >= floor).select(
        "question_id", "chunk_id", sc.rrf(F.col("rank"), sc.VECTOR_WEIGHT).alias("part")
    )
    said = words.select("question_id", "chunk_id", sc.rrf(F.col("rank"), sc.LEXICAL_WEIGHT).alias("part"))
    fused = near.unionByName(said).groupBy("question_id", "chunk_id").agg(F.sum("part").alias("rrf"))
    return fused.withColumn("rrf", F.round("rrf", 12))


def retrieve(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, index: DataFrame | LexicalIndex | None = None,
    k: int | None = sc.CANDIDATES, floor: float = sc.MIN_SIMILARITY, scoped: bool = True, columns: tuple[str, ...] = ("doc_id",),
    n_questions: int | None = None, list_size: int = sc.LIST_SIZE,
) -> DataFrame:
    """Fused candidates per question, best first (P1, T1). ``k=None`` keeps both lists whole.

    ``columns`` are taken along from the passages.

    ``questions``: question_id, text, vector, library, thread, use_reference.
    ``chunks``: chunk_id, doc_id, content, scope columns. ``vectors``: chunk_id, vector, scope columns; left out,
    the passages carry their vectors. ``index``: a written ``LexicalIndex`` or ``postings`` table, if there is one. Passages are named by id until the cut,
    and only then joined to their document. ``n_questions``: how many there are, when the caller has written them
    already; else they are written here, so that their vectors are computed once.
    """
    if n_questions is None:
        questions, n_questions = once(questions)
    scope = SCOPE_COLUMNS if scoped else []
    vectors = chunks if vectors is None else vectors
    near = vector_list(questions, vectors.select("chunk_id", "vector", *scope), list_size, scoped)
    words = lexical_list(questions, chunks.select("chunk_id", "content", *scope), index, list_size, scoped)
    fused = fuse(near, words, floor)
    # both lists have list_size rows at most, so a question has twice as many here
    k = k or 2 * list_size
    best = top_k(fused, ["question_id"], [F.col("rrf").desc(), F.col("chunk_id")], k)
    return chunks.select("chunk_id", *columns).join(small_side(best, n_questions, k), "chunk_id")


def best_document(ranked: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """The document with the largest sum of its three best fused scores; a file-name match wins."""
    best = top_k(ranked.drop("rank"), ["question_id", "doc_id"], [F.col("rrf").desc(), F.col("chunk_id")], 3, "_n")
    first = ranked.groupBy("question_id", "doc_id").agg(F.min("rank").alias("_seen"))
    totals = best.groupBy("question_id", "doc_id").agg(F.round(F.sum("rrf"), 12).alias("document_score")).join(
        first, ["question_id", "doc_id"]
    )
    chosen = first_row(totals, ["question_id"], F.struct(-F.col("document_score"), F.col("_seen"))).drop("_seen")
    if named is None:
        return chosen
    wins = named.select("question_id", F.col("doc_id").alias("_named"))
    return chosen.join(wins, "question_id", "full_outer").select(
        "question_id", F.coalesce("_named", "doc_id").alias("doc_id"), "document_score"
    )


def whole_document(selected: DataFrame, chunks: DataFrame, limit: int | None = None, questions: int | None = None) -> DataFrame:
    """The passages of the selected document in order, and whether that is all of it.

    Passages are numbered and counted once per document, before questions are joined to them; ``limit`` keeps the
    first so many. ``questions``: how many there are, when known.
    """
    asked = selected.select("doc_id").distinct()
    wanted = chunks.join(asked if questions is None else small_side(asked, questions, 1), "doc_id", "left_semi")
    sizes = wanted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("document_chunk_count"))
    if limit is None:
        heads = numbered(wanted, ["doc_id"], "chunk_index", PASSAGE_BLOCK, "rank").drop("_block")
    else:
        heads = top_k(wanted, ["doc_id"], [F.col("chunk_index")], limit)
    return (
        selected.select("question_id", "doc_id")
        .join(heads, "doc_id")
        .join(sizes, "doc_id")
        .withColumn("rrf", sc.rrf(F.col("rank"), 1.0))
        .withColumn("document_complete", F.lit(True) if limit is None else F.col("document_chunk_count") <= limit)
    )


def chosen_document(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, vectors: DataFrame | None = None,
    index: DataFrame | LexicalIndex | None = None, floor: float = sc.MIN_SIMILARITY, scoped: bool = True, n_questions: int | None = None,
) -> DataFrame:
    """The one document that fits each count/list question best (P2), written: a row per question that several steps read."""
    if n_questions is None:
        questions, n_questions = once(questions)
    ranked = durable(retrieve(questions, chunks, vectors, index, None, floor, scoped, n_questions=n_questions))
    scope = SCOPE_COLUMNS if scoped else []
    asked = questions.select("question_id", "text", *(["library", "thread", "use_reference"] if scoped else []))
    named = best_filename(asked, documents.select("doc_id", "filename", *scope), scoped)
    return durable(best_document(ranked, named))


def retrieve_whole(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, vectors: DataFrame | None = None,
    index: DataFrame | LexicalIndex | None = None, floor: float = sc.MIN_SIMILARITY, scoped: bool = True, limit: int | None = None, n_questions: int | None = None,
) -> DataFrame:
    """Count/list questions answered from the one document that fits best."""
    if n_questions is None:
        questions, n_questions = once(questions)
    chosen = chosen_document(questions, chunks, documents, vectors, index, floor, scoped, n_questions)
    return whole_document(chosen, chunks, limit, n_questions)


def evaluate(cases: DataFrame, fused: DataFrame, reranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per case: found by fusion, kept by reranking, dropped by reranking.

    ``cases``: question_id, expected_keyword, expected_source_file; ``chunks``: chunk_id, content, filename.
    """

    def hits(candidates: DataFrame, name: str) -> DataFrame:
        seen = candidates.select("question_id", "chunk_id").join(chunks.select("chunk_id", "content", "filename"), "chunk_id")
        keyword = F.lower(F.coalesce("expected_keyword", F.lit("")))
        source = F.coalesce("expected_source_file", F.lit(""))
        ok = (
            ((keyword == "") | F.contains(F.lower("content"), keyword))
            & ((source == "") | (F.col("filename") == source))
        )
        return seen.join(cases, "question_id").groupBy("question_id").agg(F.max(ok).alias(name))

    return (
        cases.join(hits(fused, "fused_hit"), "question_id", "left")
        .join(hits(reranked, "reranked_hit"), "question_id", "left")
        .fillna(False, ["fused_hit", "reranked_hit"])
        .withColumn("reranked_away", F.col("fused_hit") & ~F.col("reranked_hit"))
    )


def hit_rates(per_case: DataFrame) -> DataFrame:
    """Hit rates over all cases; an empty set rates 0 (A10)."""
    rate = lambda c: F.coalesce(F.round(F.avg(F.col(c).cast("double")), 3), F.lit(0.0))
    return per_case.agg(
        F.count(F.lit(1)).alias("total_cases"), rate("fused_hit").alias("fused_hit_rate"),
        rate("reranked_hit").alias("reranked_hit_rate"), rate("reranked_away").alias("reranked_away_rate"),
    )

