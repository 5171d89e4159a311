"""How filters interact: for every order of five filters, what each step keeps, removes, finds removed already and costs in labels.

Each filter's failing documents are a stored table of row ids. Left-semi and left-anti joins with these split all rows into those
inside and outside each; rows of one part that fail the same filters are one class from there on, with its counts. On classes,
anti-joins with what the filters of a prefix fail give the survivors of that prefix, semi-joins of the survivors with the next
filter's failing classes give its removals and label losses, anti-joins with the survivors its redundancies. The 120 orders
share 32 prefixes, so nothing is computed by order but the last lookup.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import drop_folder, stored, stored_path

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SYMBOLS = "[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def measured(documents: DataFrame) -> DataFrame:
    """``row, doc_id, part, text_key`` and the verdicts ``A`` to ``D`` of every row; ``row`` is unique."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "), "")
    counts = read.withColumn("words", words).select(
        "doc_id", "part", "text",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        (F.length("text") - F.length(F.translate("text", UPPER, ""))).alias("n_upper"),
        F.length("text").alias("n_chars"),
    )
    return counts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "part",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"),
        (F.col("n_words") < MIN_WORDS).alias("A"),
        (100 * F.col("n_distinct").cast("long") < DISTINCT_PERCENT * F.col("n_words").cast("long")).alias("B"),
        (100 * F.col("n_upper").cast("long") > UPPER_PERCENT * F.col("n_chars").cast("long")).alias("C"),
        F.col("text").rlike(SYMBOLS).alias("D"),
    )


def failing(rows: DataFrame) -> dict[str, DataFrame]:
    """By filter, the stored table of the ``row`` ids that fail it.

    E: every row but those of a text's smallest doc_id, found by an anti-join on (text, doc_id), a key that no group of copies
    shares. Rows without doc_id have no smaller one before them and are none themselves.
    """
    named = rows.filter("doc_id IS NOT NULL")
    firsts = named.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    relations = {f: rows.filter(F.col(f)) for f in "ABCD"} | {"E": named.join(firsts, ["text_key", "doc_id"], "left_anti")}
    return {f: stored(relation.select("row"), f"fails-{f}") for f, relation in relations.items()}


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``row, part, good, toxic``: 1 where any label of the document says so, else 0."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    marks = marks.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("good", "toxic")))
    named = rows.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    found = named.select("row", "part", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    return found.unionByName(rows.filter("doc_id IS NULL").select("row", "part", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def classes(ids: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """``part, failed, n, good, toxic``: rows of a part by the set of filters they fail, a bit for each filter."""
    split, old = ids.withColumn("failed", F.lit(0)), None
    for bit, relation in enumerate(fails.values()):
        inside = split.join(relation, "row", "left_semi").withColumn("failed", F.col("failed") + (1 << bit))
        split, path = stored_path(inside.unionByName(split.join(relation, "row", "left_anti")), "audit-split")
        if old:
            drop_folder(ids.sparkSession, old)
        old = path
    grouped = split.groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    found = stored(grouped, "audit-classes")
    drop_folder(ids.sparkSession, old)
    return found


def prefixes(found: DataFrame) -> DataFrame:
    """``part, prefix, bit, kept, removed, redundant, good_lost, toxic_lost``: filter ``bit`` after the filters of ``prefix``, zeros included."""
    size = len(FILTERS)
    sets, bits = F.explode(F.sequence(F.lit(0), F.lit((1 << size) - 1))), F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    outside = "(shiftright(prefix, bit) & 1) = 0"
    every = found.select("failed").distinct()
    fails = every.select("failed", bits.alias("bit")).filter("(shiftright(failed, bit) & 1) = 1")
    gone = fails.select("failed", "bit", sets.alias("prefix")).filter("(shiftright(prefix, bit) & 1) = 1").select("failed", "prefix").distinct()
    survivors = found.select("*", sets.alias("prefix")).join(gone, ["prefix", "failed"], "left_anti")
    steps = survivors.select("*", bits.alias("bit")).filter(outside)
    removed = steps.join(fails, ["bit", "failed"], "left_semi").groupBy("part", "prefix", "bit")
    removed = removed.agg(F.sum("n").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
    kept = steps.join(fails, ["bit", "failed"], "left_anti").groupBy("part", "prefix", "bit").agg(F.sum("n").alias("kept"))
    again = found.select("*", sets.alias("prefix")).select("*", bits.alias("bit")).filter(outside).join(fails, ["bit", "failed"], "left_semi")
    again = again.join(survivors.select("part", "prefix", "failed"), ["part", "prefix", "failed"], "left_anti")
    redundant = again.groupBy("part", "prefix", "bit").agg(F.sum("n").alias("redundant"))
    whole = found.select("part").distinct().select("part", sets.alias("prefix")).select("*", bits.alias("bit")).filter(outside)
    for part in (kept, removed, redundant):
        whole = whole.join(part, ["part", "prefix", "bit"], "left")
    return whole.na.fill(0, ["kept", "removed", "redundant", "good_lost", "toxic_lost"])


def interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the counts ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A row for each part (a language; null is the empty string), each order of the filters and each step. Every row of documents
    counts, repeated ones too; null and empty texts have no words and fail A. A row without doc_id never fails E and has no label;
    null or clashing labels of a document count as 1 if any says 1. Columns other than ``doc_id, text, lang`` are not
    read. No rows give no parts.
    """
    rows = stored(measured(documents), "audit-rows")
    at = stored(prefixes(classes(labelled(rows, labels), failing(rows))), "audit-prefixes")
    orders = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = FILTERS.index(name)
            orders.append(("".join(order), step, before, bit))
            before |= 1 << bit
    steps = documents.sparkSession.createDataFrame(orders, "filter_order string, step int, prefix int, bit int")
    alone = at.filter(f"prefix = {(1 << len(FILTERS)) - 1} - shiftleft(1, bit)").select("part", "bit", F.col("removed").alias("unique_fails"))
    found = at.join(F.broadcast(steps), ["prefix", "bit"]).join(alone, ["part", "bit"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley")
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)
