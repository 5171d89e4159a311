"""Exact label/value facts from tables, and matching of questions against facts, captions and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions import text as tx
from casebook.functions.scoring import FACT_LIMIT
from casebook.operators.matching import best_by_words
from casebook.operators.windows import numbered

FIGURE_OVERLAP = 2


def locator(page: Column, table: Column) -> Column:
    """Where a table is: ``p. 2 table 1`` on a page, ``table 1`` in running text."""
    return F.when(page.isNotNull(), F.format_string("p. %d table %d", page, table)).otherwise(
        F.format_string("table %d", table)
    )


def table_facts(rows: DataFrame, block: int = 10_000) -> DataFrame:
    """Facts of many tables at once.

    ``rows``: doc_id, page, locator, row, cells. Two-column tables are label/value pairs; wider ones give
    ``Entity.Column`` facts under their first row. A table is read as rows spread over tasks: only its
    widths and its header row are gathered.
    """
    table = ["doc_id", "locator"]
    tidy = rows.withColumn("cells", F.transform("cells", lambda c: tx.squash(F.coalesce(c, F.lit("")))))
    tidy = numbered(tidy.filter(F.exists("cells", lambda c: c != "")), table, "row", block, "n").drop("_block")
    shape = tidy.groupBy(*table).agg(
        F.min(F.size("cells")).alias("_min"), F.max(F.size("cells")).alias("_max"),
        F.max(F.when(F.col("n") == 1, F.col("cells"))).alias("_head"),
    )
    full = tidy.join(shape, table)
    pairs = (F.col("_min") == 2) & (F.col("_max") == 2)
    where = F.format_string("%s row %d", F.col("locator"), F.col("n"))
    narrow = full.filter(pairs & (F.col("cells")[0] != "") & (F.col("cells")[1] != "")).select(
        "doc_id", "page", "row", F.lit(0).alias("col"), where.alias("locator"),
        F.col("cells")[0].alias("label"), F.col("cells")[1].alias("value"),
    )
    entity = F.when(F.col("cells")[0] != "", F.col("cells")[0]).otherwise(F.format_string("row %d", "n"))
    wide = (
        full.filter(~pairs & (F.col("n") > 1))
        .select("doc_id", "page", "row", where.alias("locator"), entity.alias("entity"), "_head",
                F.posexplode("cells").alias("col", "value"))
        .withColumn("column", F.try_element_at("_head", F.col("col") + 1))
        .filter("col > 0 AND column <> '' AND value <> ''")
        .select("doc_id", "page", "row", "col", "locator", F.concat_ws(".", "entity", "column").alias("label"), "value")
    )
    return narrow.unionByName(wide)


def match_facts(
    questions: DataFrame, facts: DataFrame, scoped: bool = False, k: int = FACT_LIMIT
) -> DataFrame:
    """Facts whose label shares the most words with the question, the best tier only, first k.

    ``questions``: question_id, text, scope columns. ``facts``: fact_id, label, scope columns. The first k by
    (overlap, fact) hold the first k of the best tier, so one bounded list per question is enough.
    """
    asked = questions.withColumn("terms", tx.content_tokens(F.col("text"))).drop("text")
    best = best_by_words(asked, facts, "fact_id", tx.content_tokens(F.col("label")), k, scoped)
    tier = F.max("score").over(Window.partitionBy("question_id"))
    return best.withColumn("_tier", tier).filter("score = _tier").drop("_tier")


def best_figures(requests: DataFrame, figures: DataFrame, scoped: bool = False) -> DataFrame:
    """The figure whose caption covers a request, when it covers enough of it.

    ``figures``: figure_id, created_at, caption. Ties go to the oldest document, then the figure id.
    """
    terms = tx.content_tokens(F.col("text"), tx.DIAGRAM_WORDS)
    asked = requests.withColumn("terms", terms).drop("text")
    words = tx.content_tokens(F.col("caption"), tx.DIAGRAM_WORDS)
    best = best_by_words(asked, figures, "figure_id", words, 1, scoped, ["created_at"])
    needed = requests.select("question_id", F.least(F.lit(FIGURE_OVERLAP), F.size(terms)).alias("_need"))
    return best.join(needed, "question_id").filter("score >= _need").drop("_need")


def best_filename(questions: DataFrame, documents: DataFrame, scoped: bool = False) -> DataFrame:
    """The document whose file name shares most terms with the question."""
    asked = questions.withColumn("terms", tx.question_terms(F.col("text"))).drop("text")
    return best_by_words(asked, documents, "doc_id", tx.filename_terms(F.col("filename")), 1, scoped)
