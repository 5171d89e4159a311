"""Lenient readers for replies of an outside model: scores, memory entries, answer halves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY_TYPES = ("fact", "decision", "preference")

_SCORES = "array<double>"
_ENTRY = "worth_remembering boolean, entry_type string, content string"

# The two headings of an answer, with the markdown a small model adds.
GROUNDED_HEADING = (
    r"(?im)^[ \t]*(?:#{1,6}[ \t]*)?(?:\*\*|__)?[ \t]*(?:[0-9]\.[ \t]*)?from the documents?[ \t]*:?[ \t]*"
    r"(?:\*\*|__)?[ \t]*:?[ \t]*$"
)
INSIGHT_HEADING = (
    r"(?im)^[ \t]*(?:#{1,6}[ \t]*)?(?:\*\*|__)?[ \t]*(?:[0-9]\.[ \t]*)?additional insights?[ \t]*:?[ \t]*"
    r"(?:\*\*|__)?[ \t]*:?"
)

# Text stored in place of an answer that says nothing.
NOT_IN_DOCUMENTS = (
    "FROM THE DOCUMENTS:\nNothing in the selected documents answers this. The nearest passages are listed as sources."
    "\n\nADDITIONAL INSIGHT:\nNone."
)


def _numbers(text: Column) -> Column:
    parsed = F.from_json(text, _SCORES)
    # the JSON text "null", true or "7" inside the array must void the whole reply
    clean = ~F.exists(parsed, lambda v: v.isNull()) & ~text.rlike(r'"|true|false|null')
    return F.when(clean & (F.size(parsed) > 0), parsed)


def parse_scores(raw: Column, expected: Column) -> Column:
    """Scores of a reply: whole JSON array, else the first bracketed one; clamped to 0-10.

    Anything but numbers voids the reply (empty array); extra scores are dropped.
    """
    whole = F.trim(raw)
    bracketed = F.regexp_extract(raw, r"(?s)\[[^\]]*\]", 0)
    is_json = F.try_parse_json(whole).isNotNull()
    scores = F.when(is_json, _numbers(whole)).otherwise(_numbers(bracketed))
    clamped = F.transform(scores, lambda v: F.least(F.lit(10.0), F.greatest(F.lit(0.0), v)))
    empty = F.array().cast(_SCORES)
    return F.coalesce(F.slice(clamped, 1, F.greatest(expected, F.lit(0))), empty)


def fill_scores(scores: Column, fallback: Column) -> Column:
    """A short reply keeps its scores by position; the tail comes from retrieval evidence."""
    tail = F.slice(fallback, F.size(scores) + 1, F.greatest(F.size(fallback) - F.size(scores), F.lit(0)))
    return F.concat(scores, tail)


def parse_memory(raw: Column) -> Column:
    """A memory entry worth keeping, or null."""
    whole = F.from_json(F.trim(raw), _ENTRY)
    inner = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), _ENTRY)
    entry = F.when(F.try_parse_json(F.trim(raw)).isNotNull(), whole).otherwise(inner)
    content = F.trim(F.coalesce(entry["content"], F.lit("")))
    kind = F.when(entry["entry_type"].isin(*ENTRY_TYPES), entry["entry_type"]).otherwise("fact")
    keep = F.coalesce(entry["worth_remembering"], F.lit(False)) & (content != "")
    return F.when(keep, F.struct(kind.alias("entry_type"), content.alias("content")))


def split_answer(answer: Column) -> Column:
    """Struct (grounded, insight): what the documents say, and what the model added."""
    heading = F.regexp_extract(answer, INSIGHT_HEADING, 0)
    has_insight = answer.rlike(INSIGHT_HEADING)
    at = F.position(heading, answer)
    before = F.when(has_insight, F.left(answer, at - 1)).otherwise(answer)
    grounded = F.btrim(F.regexp_replace(before, GROUNDED_HEADING, ""), F.lit(" \t\r\n"))
    bare = F.btrim(F.regexp_replace(grounded, r"(?i)\n\s*none\.?\s*$", ""), F.lit(" \t\r\n"))
    grounded = F.when(has_insight, grounded).otherwise(bare)
    after = F.btrim(F.substr(answer, at + F.length(heading)), F.lit(" \t\r\n"))
    insight = F.when(has_insight & ~after.rlike(r"(?i)^none\.?$"), after).otherwise("")
    return F.struct(grounded.alias("grounded"), insight.alias("insight"))
