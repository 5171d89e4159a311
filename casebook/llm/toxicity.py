"""Toxicity by non-negative positive-unlabelled learning.

Some texts are confirmed toxic, the others are unlabelled: most are harmless, a share ``prior`` of them is toxic too. The risk of
a classifier f is prior * E[l(f, toxic)] over confirmed texts plus E[l(f, harmless)] over unlabelled texts minus
prior * E[l(f, harmless)] over confirmed texts. The last two estimate the risk on harmless texts, which cannot be negative; where
their difference is, the model has begun to learn single unlabelled texts, and the step goes back instead (Kiryo and others).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import give_back
from casebook.llm.features import Hashing, Linear, Rows, by_hash, descend, lists_of, sample_features, score_udf, sigmoid

HASHING = Hashing(chars=(4, 5), words=(1,), lower=True, bits=20)
POSITIVES = 3000
UNLABELLED = 9000
BAGS = 3
BUCKETS = 2000
LEAST_Z = 4.0  # standard errors by which a bucket's share must differ
PENALTY = 1e-4
STEPS = 300
RATE = 0.05
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


def fold(doc_id="doc_id"):
    """crc32 of the doc_id as text, by remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(confirmed: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, weights and bias of one classifier."""
    rows, n, m = Rows(confirmed, unlabelled, bits, BUCKETS, least_z=LEAST_Z), len(confirmed), len(unlabelled)

    def slope(margins: np.ndarray) -> np.ndarray:
        p = sigmoid(margins)
        harmless = np.logaddexp(0, margins[n:]).mean() - prior * np.logaddexp(0, margins[:n]).mean()
        toxic = prior * (p[:n] - 1) / n
        if harmless >= 0:
            return np.concatenate([toxic - prior * p[:n] / n, p[n:] / m])
        return np.concatenate([prior * p[:n] / n, -p[n:] / m])

    weights, bias = descend(rows, slope, PENALTY, STEPS, RATE)
    return rows.chosen, weights, bias


def train(documents: DataFrame, labels: DataFrame, hashing: Hashing = HASHING, positives: int = POSITIVES, unlabelled: int = UNLABELLED, bags: int = BAGS) -> Linear | None:
    """The mean of ``bags`` classifiers, each of all sampled confirmed texts and its own part of the unlabelled ones.

    Labels are used of rows outside the held-out fold only: which texts are confirmed, and the share of toxic rows among all
    labelled ones (the prior). ``positives`` and ``unlabelled`` bound the sample, whatever the size of the tables. Of
    several labels of a document toxic wins. None if no text is confirmed.
    """
    ours = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ours = ours.filter((fold() != HELD_OUT) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = ours.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    others = documents.select(F.col("doc_id").cast("long").alias("doc_id")).filter(fold() != HELD_OUT)
    confirmed = by_hash(ours.filter("toxic = 1"), positives, 1).withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    rest = by_hash(others, unlabelled, 2).withColumn("bag", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(bags)).cast("int"))
    sample = confirmed.withColumn("confirmed", F.lit(True)).unionByName(rest.withColumn("confirmed", F.lit(False)))

    def run(table: pa.Table) -> pa.Table:
        rows, known = lists_of(table), table.column("confirmed").to_pylist()
        one, two = ([r for r, k in zip(rows, known, strict=True) if k == wanted] for wanted in (True, False))
        if not one or not two:
            return pa.table({"bucket": pa.array([], pa.int32()), "weight": pa.array([], pa.float64())})
        chosen, weights, bias = fit(one, two, prior, hashing.bits)
        del table, rows, known, one, two
        give_back()
        return pa.table({"bucket": pa.array(np.append(chosen, -1), pa.int32()), "weight": pa.array(np.append(weights, bias))})

    # At most BUCKETS + 1 numbers of each bag come to the driver.
    found = sample_features(documents, sample, hashing).groupBy("bag").applyInArrow(run, "bucket int, weight double").collect()
    n = sum(r.bucket == -1 for r in found)
    if not n:
        return None
    weights, bias = np.zeros(1 << hashing.bits, np.float32), 0.0
    for r in sorted(found):
        if r.bucket < 0:
            bias += r.weight / n
        else:
            weights[r.bucket] += r.weight / n
    return Linear(hashing, weights, bias)


def scored(documents: DataFrame, model: Linear | None) -> DataFrame:
    """``doc, score``: each row as a struct of its columns, and the probability that its whole text is toxic.

    Null and empty texts get the score of a text without any n-gram. Without a model every score is 0.
    Equal texts have equal scores; repeated rows each keep theirs. The text is the only input of a score.
    """
    rows = documents.select(F.struct("*").alias("doc"))
    if model is None:
        return rows.withColumn("score", F.lit(0.0))
    return rows.withColumn("score", score_udf(model, sigmoid)(F.coalesce(F.col("doc.text").cast("string"), F.lit(""))))


def predictions(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    found = scored(documents.select("doc_id", "text"), train(documents, labels)).select(F.col("doc.doc_id").cast("long").alias("doc_id"), "score")
    return found.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def harmless(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score stays below the threshold."""
    return scored(documents, train(documents, labels)).filter(F.col("score") < threshold).select("doc.*")
