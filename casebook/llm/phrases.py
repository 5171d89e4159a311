"""Collocations: phrases scored by how much more often they occur than their parts would by chance.

One window of the longest order starts at every word. It is read off columns that hold the words behind (the same words, led by one,
two, three and four places) and is padded where the piece ends. Only these longest windows are counted; a ROLLUP over the
window's columns then sums them into the counts of every shorter phrase, so no phrase length is exploded on its own.

A window is also padded where it can hold no frequent phrase any more. To know where, pairs of neighbours are counted by hash
first, and those with ``least`` uses set a bit each in a filter of fixed size. It has false positives only (they cost
work and change nothing), so every phrase of ``least`` uses, and every part of one, is counted in full: a phrase is
never more frequent than a pair inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import shuffles_removed, stored

ORDER = 5
LEAST = 100
TOP = 2000
FILTER_BITS = 23  # a filter of 2 ** 23 bits is 1 MB at every size of the corpus
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAKS = ".,;:!?\x0b\x0c\r"


def pieces(documents: DataFrame) -> DataFrame:
    """``lang, words``: the words of every piece that has one, A-Z in lower case."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.translate(text, UPPER + BREAKS + "\t", UPPER.lower() + "\n" * len(BREAKS) + " ")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    cut = documents.select(lang, F.explode(F.split(plain, "\n")).alias("piece")).filter("piece <> ''")
    return cut.select("lang", F.array_remove(F.split("piece", " "), "").alias("words"))


def led(rows: DataFrame, order: int) -> DataFrame:
    """``lang, w1 .. w<order>``: each word with the words behind it, null past the end of its piece."""
    ahead = [F.slice("words", i + 1, F.size("words")) for i in range(1, order)]
    return rows.select("lang", F.inline(F.arrays_zip("words", *ahead)).alias(*(f"w{i + 1}" for i in range(order))))


def _pair(one: str, two: str) -> Column:
    return F.xxhash64("lang", one, two)


def frequent_pairs(rows: DataFrame, least: int, bits: int) -> DataFrame:
    """One row with ``bits``, the filter of all pairs of neighbours of ``least`` uses or more."""
    pairs = led(rows, 2).filter("w2 IS NOT NULL").groupBy(_pair("w1", "w2").alias("pair")).count().filter(F.col("count") >= least)
    bucket = pairs.select(F.pmod("pair", F.lit(1 << bits)).alias("bucket"))
    bit = F.expr("shiftleft(1L, cast(bucket & 63 as int))")
    # At most 2 ** bits / 64 numbers come to the driver, and the shuffled counts go as soon as they are there.
    with shuffles_removed(rows.sparkSession):
        found = bucket.groupBy(F.shiftright("bucket", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    full = [0] * (1 << bits - 6)
    for r in found:
        full[r.word] = r.bits
    return rows.sparkSession.createDataFrame([(full,)], "bits array<long>")


def windows(rows: DataFrame, order: int, pairs: DataFrame, bits: int) -> DataFrame:
    """``lang, w1 .. w<order>``: a window from each word, '' from its piece's end or its first rare pair on."""
    flags = pairs.scalar()
    names = [f"w{i}" for i in range(1, order + 1)]

    def holds(one: str, two: str) -> Column:
        bucket = F.pmod(_pair(one, two), F.lit(1 << bits))
        word = F.get(flags, F.shiftright(bucket, 6).cast("int"))
        return F.col(two).isNotNull() & (F.getbit(word, bucket.bitwiseAND(F.lit(63)).cast("int")) == 1)

    steps = led(rows, order).select("*", *(holds(a, b).alias(f"to_{b}") for a, b in zip(names, names[1:], strict=False)))
    chosen, goes_on = [F.col(names[0])], F.lit(True)
    for name in names[1:]:
        goes_on = goes_on & F.col(f"to_{name}")
        chosen.append(F.when(goes_on, F.col(name)).otherwise("").alias(name))
    return steps.select("lang", *chosen)


def counted(documents: DataFrame, order: int = ORDER, least: int = LEAST, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, k, words, phrase, f`` of all phrases of 1 to ``order`` words with ``least`` uses, and ``lang, n``."""
    rows = pieces(documents)
    names = [f"w{i}" for i in range(1, order + 1)]
    longest = windows(rows, order, frequent_pairs(rows, least, bits), bits).groupBy("lang", *names).agg(F.count("*").alias("c"))
    sums = longest.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("rolled"))
    # Columns rolled up stand as ones from the last on: 2 ** (order - k) - 1 leaves k words.
    k = F.expr(f"cast(round(log2({1 << order} / (rolled + 1))) as int)")
    words = F.slice(F.array(*names), 1, F.col("k"))
    found = sums.filter(F.col("rolled") < 1 << order).withColumn("k", k).filter((F.col("f") >= least) | (F.col("k") == 0))
    found = found.select("lang", "k", "f", F.when(F.col("k") > 0, words).alias("words")).filter("k = 0 OR element_at(words, -1) <> ''")
    kept = stored(found.withColumn("phrase", F.array_join("words", " ")), "phrases")
    langs = stored(kept.filter("k = 0").select("lang", F.col("f").alias("n")), "phrase-langs")
    return kept.filter("k > 0"), langs


def cuts(phrases: DataFrame, langs: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of each candidate at its lowest-scoring cut.

    Arithmetic is in decimals of 38 digits, exact up to 10**17 words of a language (and an error beyond, never a wrong number).
    """
    candidates = phrases.filter("k >= 2").select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    halves = candidates.select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("words", 1, F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut")), " ").alias("rest"),
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    joined = halves.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(langs, "lang")
    wide = {c: F.col(c).cast("decimal(17,0)") for c in ("a", "n", "l", "r")}
    above = (F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"]).alias("above")
    scored = joined.select("*", above, (wide["l"] * wide["r"]).alias("below")).withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("at")
    best = scored.groupBy("lang", "phrase").agg(lowest, F.first("a").alias("a"), F.first("n").alias("n"))
    return best.select("lang", "phrase", "a", "at.l", "at.r", "n", "at.score")


def inside_longer(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, longest``: the highest count of a longer candidate that holds the phrase in one run."""
    runs = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(words, s, m), ' '))))")
    parts = phrases.filter("k >= 3").select("lang", "f", F.explode(F.array_distinct(runs)).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(documents: DataFrame, order: int = ORDER, least: int = LEAST, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``order`` words.

    Rows without a language count as ``und``. Null and empty texts have no words; repeated rows count each time. A language
    without a phrase of ``least`` uses gives no row, nor does an empty table. Ties go to the higher count, then to the
    smaller phrase in UTF-8 bytes. Columns other than ``lang`` and ``text`` are not read, so their names cannot clash.
    A text's words are one array at a time, so a text has to fit into a task, but no group of texts has to.
    """
    phrases, langs = counted(documents, order, least, bits)
    holder = inside_longer(phrases).withColumnsRenamed({"lang": "in_lang", "phrase": "in_phrase"})
    held = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")) & (100 * F.col("longest") >= 100 * F.col("a"))
    alone = cuts(phrases, langs).join(holder, held, "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
