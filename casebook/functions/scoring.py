"""Rank fusion, confidence, citation labels and context budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking contract.
RRF_K = 60
VECTOR_WEIGHT = 0.7
LEXICAL_WEIGHT = 0.3
MAX_RRF = (VECTOR_WEIGHT + LEXICAL_WEIGHT) / (RRF_K + 1)
RETRIEVAL_CEILING = 6.5
LIST_SIZE = 40
CANDIDATES = 12
KEPT = 5
MIN_SIMILARITY = 0.28
FACT_LIMIT = 8
CONTEXT_CEILING = 16384


def rrf(rank: Column, weight: float) -> Column:
    """Reciprocal-rank contribution of one list."""
    return F.lit(weight) / (F.lit(RRF_K) + rank)


def retrieval_score(fused: Column) -> Column:
    """Fused score on the 0-10 scale, kept below the high band."""
    return F.round(F.least(F.coalesce(fused, F.lit(0.0)) / F.lit(MAX_RRF), F.lit(1.0)) * RETRIEVAL_CEILING, 2)


def confidence(best_score: Column, passages: Column, facts: Column) -> Column:
    """Label from the best passage; an exact fact lifts it to medium, no evidence is none."""
    best = F.coalesce(best_score, F.lit(0.0))
    best = F.when(facts > 0, F.greatest(best, F.lit(4.0))).otherwise(best)
    return (
        F.when((passages == 0) & (facts == 0), "none")
        .when(best >= 7, "high")
        .when(best >= 4, "medium")
        .otherwise("low")
    )


def exhaustive_confidence(passages: Column, complete: Column) -> Column:
    """Count/list questions: whole document medium, partial low, nothing none."""
    return F.when(passages == 0, "none").when(complete, "medium").otherwise("low")


def location(page_start: Column, page_end: Column, section: Column) -> Column:
    """Where a passage sits, as a reader would cite it."""
    has_page = F.coalesce(page_start, F.lit(0)) != 0
    one_page = F.coalesce(page_end, F.lit(0)).isin(0) | (page_end == page_start)
    return (
        F.when(has_page & one_page, F.concat(F.lit("p. "), page_start.cast("string")))
        .when(has_page, F.concat(F.lit("pp. "), page_start.cast("string"), F.lit("-"), page_end.cast("string")))
        .when(F.coalesce(section, F.lit("")) != "", section)
        .otherwise("Document")
    )


def context_tokens(evidence_tokens: Column, history_tokens: Column) -> Column:
    """Tokens that a question's evidence, its history and an answer take."""
    return (F.coalesce(evidence_tokens, F.lit(0)) + F.coalesce(history_tokens, F.lit(0)) + 3000).cast("bigint")


def context_budget(exhaustive: Column, evidence_tokens: Column, history_tokens: Column, ceiling: int | None = CONTEXT_CEILING) -> Column:
    """Context size asked of a model for one question (A13); the model's ceiling may be None."""
    sized = F.greatest(F.lit(4096), context_tokens(evidence_tokens, history_tokens))
    sized = sized if ceiling is None else F.least(F.lit(ceiling), sized)
    return F.when(exhaustive, sized).otherwise(F.lit(4096)).cast("bigint")


def valid_citations(answer: Column, count: Column) -> Column:
    """Citation numbers in an answer that point at one of its sources."""
    marks = F.transform(
        F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,2})\](?!\()"), F.lit(1)), lambda m: m.cast("int")
    )
    return F.filter(marks, lambda m: (m >= 1) & (m <= count))
