"""Quality classifier: logistic regression over hashed word n-grams, trained online by follow-the-regularised-leader.

A text is a sparse vector: 1 + log(uses) for each bucket of its word n-grams, and 1 for the bias, all scaled to length one, so a text
with little evidence leans on the bias. Every training text is met in turn; only its own coordinates move, each at a rate that
shrinks with the gradients that coordinate has seen, and an L1 term keeps coordinates at zero until they have earned a weight. A
score is the sigmoid of the sparse dot product of vector and weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import give_back, keyed_texts, slices
from casebook.llm.features import Hashing, by_hash, sigmoid

HASHING = Hashing(chars=(), words=(1, 2), lower=False, bits=20)
SAMPLE = 12000
EPOCHS = 3
ALPHA = 3.0
BETA = 1.0
L1 = 0.1
L2 = 0.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
SLICE = 1 << 19


def fold(doc_id="doc_id"):
    """crc32 of the doc_id as text, by remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


class Leader:
    """Per-coordinate sums of follow-the-regularised-leader with proximal steps; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.squares = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, places: np.ndarray) -> np.ndarray:
        """The minimiser of the regularised sum of all gradients so far; the bias (the last coordinate) has no L1 term."""
        z = self.z[places]
        l1 = np.where(places == len(self.z) - 1, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.squares[places])) / self.alpha + self.l2
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / rate, 0.0)

    def learn(self, places: np.ndarray, values: np.ndarray, good: int, importance: float) -> None:
        weights = self.weights(places)
        gradient = importance * (sigmoid(np.array([weights @ values]))[0] - good) * values
        grown = self.squares[places] + gradient**2
        self.z[places] += gradient - (np.sqrt(grown) - np.sqrt(self.squares[places])) / self.alpha * weights
        self.squares[places] = grown


def vectors(hashing: Hashing, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all texts: the text's place in the list (ascending), the coordinate, the value. The bias is the last coordinate."""
    doc, bucket = hashing.buckets(texts)
    wide, size = hashing.bits + 1, 1 << hashing.bits
    pairs, uses = np.unique((doc << wide) | bucket, return_counts=True)
    pairs = np.append(pairs, (np.arange(len(texts)) << wide) | size)
    values = np.append(1 + np.log(uses), np.ones(len(texts)))
    order = np.argsort(pairs, kind="stable")
    doc, place, values = pairs[order] >> wide, pairs[order] & ((1 << wide) - 1), values[order]
    return doc, place, values / np.sqrt(np.bincount(doc, weights=values**2, minlength=len(texts)))[doc]


def dot_products(weights: np.ndarray, hashing: Hashing, texts: list[str]) -> np.ndarray:
    """For each text the sparse dot product of its vector with the weights; that of a text without words, or without weights, is the bias."""
    if not weights[:-1].any():
        return np.full(len(texts), weights[-1], float)
    doc, place, values = vectors(hashing, texts)
    return np.bincount(doc, weights=weights[place] * values, minlength=len(texts))


def training_rows(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``doc_id, good, text`` of the sampled labelled documents outside the held-out fold, each once.

    Of several labels of a document the lower one counts, of several texts the smallest. The ids (at most ``sample``) are
    broadcast; the documents are read once and only sampled texts move.
    """
    ours = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    ours = ours.filter((fold() != HELD_OUT) & F.col("good").isNotNull()).groupBy("doc_id").agg(F.min("good").alias("good"))
    chosen = F.broadcast(ours.join(F.broadcast(by_hash(ours, sample, 4)), "doc_id"))
    return keyed_texts(documents).join(chosen, "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))


def train(documents: DataFrame, labels: DataFrame, hashing: Hashing = HASHING, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by bucket, the bias last. Both classes weigh the same.

    The learner is sequential by nature, so one task meets ``sample`` documents at most (chosen by a hash of the doc_id), ``epochs``
    times, in the order of a hash. They reach it as a sorted stream of small batches: it holds one batch, one text's
    n-grams and the sums, however long the texts are. With one class only, or without labels, every weight is zero and
    the bias gives (good + 1) / (labelled + 2).
    """
    rows = training_rows(documents, labels, sample)
    size = 1 << hashing.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, counts = Leader(size), np.zeros(2)
        for batch in batches:
            for part in slices([batch], "text", SLICE):
                good, first = part.column("good").to_numpy(), part.column("epoch").to_numpy() == 0
                counts += np.bincount(good[first], minlength=2)[:2]
                doc, place, values = vectors(hashing, part.column("text").to_pylist())
                cuts = np.searchsorted(doc, np.arange(1, len(good)))
                for own, entries, g in zip(np.split(place, cuts), np.split(values, cuts), good, strict=True):
                    # the shares met so far; from the second epoch on, those of the whole sample
                    leader.learn(own, entries, int(g), 0.5 * counts.sum() / counts[g])
        places = np.arange(size + 1)
        weights = leader.weights(places)
        if not counts.all():
            p = (counts[1] + 1) / (counts.sum() + 2)
            weights = np.append(np.zeros(size), np.log(p / (1 - p)))
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(weights[used])], ["bucket", "weight"])
        give_back()

    met = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    ordered = met.withColumn("turn", F.xxhash64("doc_id", "epoch")).repartition(1).sortWithinPartitions("epoch", "turn", "doc_id")
    # At most 2 ** bits + 1 numbers come to the driver; no rows, no batch.
    found = ordered.select("good", "text", "epoch").mapInArrow(run, "bucket int, weight double").collect()
    weights = np.zeros(size + 1, np.float32)
    for r in found:
        weights[r.bucket] = r.weight
    return weights


def scored(documents: DataFrame, weights: np.ndarray, hashing: Hashing = HASHING) -> DataFrame:
    """``doc, score``: each row as a struct of its columns, and the probability that its whole text is of good quality.

    The text is the only input of a score: equal texts have equal scores, null and empty ones that of the bias. Repeated rows
    each keep theirs, further columns ride inside the struct. What is shipped to the tasks is 2 ** bits + 1 numbers.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out, part, held = [np.empty(0)], [], 0
            for text in series:
                part.append(text)
                held += len(text)
                if held > SLICE:
                    out.append(sigmoid(dot_products(shipped.value, hashing, part)))
                    part, held = [], 0
            if part:
                out.append(sigmoid(dot_products(shipped.value, hashing, part)))
            yield pd.Series(np.concatenate(out))
        give_back()

    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    return documents.select(F.struct("*").alias("doc")).withColumn("score", score(text))


def predictions(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    weights = train(documents, labels)
    found = scored(documents.select("doc_id", "text"), weights).select(F.col("doc.doc_id").cast("long").alias("doc_id"), "score")
    return found.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
