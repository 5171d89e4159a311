"""Quality rules: counts with fixed limits, then a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import keyed_texts, slices
from casebook.llm.features import Hashing, Linear, Rows, by_hash, descend, lists_of, sample_features, sigmoid

HASHING = Hashing(chars=(4,), words=(1, 2), lower=False, bits=20)
SAMPLE = 8000
BUCKETS = 2000
PENALTY = 1e-4
STEPS = 300
RATE = 0.05
CALIBRATION = 4  # one row in so many calibrates and does not train
KEEP_FROM = 0.5
MIN_WORDS = 50
REPEAT_PERCENT = 50
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list) -> int:
    """Words inside a window of three that the text holds twice or more, the first time included; each word once."""
    n = len(words)
    if n < 4:
        return 0
    known: dict = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = codes[:-1] * len(known) + codes[1:]
    if len(known) >= 1 << 20:  # three codes would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, count = np.unique(pairs[:-1] * len(known) + codes[2:], return_inverse=True, return_counts=True)
    twice, covered = count[place] >= 2, np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANK)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def fit(good: list[np.ndarray], bad: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, weights and bias of a logistic regression in which both classes weigh the same."""
    rows, n, m = Rows(good, bad, bits, BUCKETS), len(good), len(bad)
    truth = np.repeat([1.0, 0.0], [n, m])
    share = np.repeat([0.5 / n, 0.5 / m], [n, m])
    weights, bias = descend(rows, lambda margins: (sigmoid(margins) - truth) * share, PENALTY, STEPS, RATE)
    return rows.chosen, weights, bias


def platt(margins: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton steps on smoothed targets; (1, 0) with one class."""
    n, m = truth.sum(), (1 - truth).sum()
    if not n or not m:
        return 1.0, 0.0
    target = np.where(truth > 0, (n + 1) / (n + 2), 1 / (m + 2))
    x, theta = np.stack([margins, np.ones_like(margins)]), np.array([0.0, np.log((n + 1) / (m + 1))])
    for _ in range(100):
        p = sigmoid(theta @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target) + 1e-6 * theta)
        theta = theta - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def train(documents: DataFrame, labels: DataFrame, hashing: Hashing = HASHING, sample: int = SAMPLE) -> Linear:
    """The classifier with its calibration folded in: the sigmoid of its margin is the probability of good quality.

    It is fitted by one task on ``sample`` labelled documents at most, chosen by a hash of the doc_id; of several labels
    of a document the lower one counts. With one class only, or without labels, every probability is
    (good + 1) / (labelled + 2).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.join(F.broadcast(by_hash(known, sample, 1)), "doc_id")
    holds = (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(CALIBRATION)) == 0).alias("holds")
    rows = sample_features(documents, chosen.select("doc_id", "quality", holds), hashing)

    def run(table: pa.Table) -> pa.Table:
        lists, truth = lists_of(table), table.column("quality").to_numpy().astype(float)
        holds = np.array(table.column("holds").to_pylist())
        good, bad = ([r for r, q, h in zip(lists, truth, holds, strict=True) if q == wanted and not h] for wanted in (1, 0))
        if not good or not bad:
            p = (truth.sum() + 1) / (len(truth) + 2)
            return pa.table({"bucket": pa.array([-1], pa.int32()), "weight": pa.array([np.log(p / (1 - p))])})
        places, weights, bias = fit(good, bad, hashing.bits)
        full = np.zeros(1 << hashing.bits)
        full[places] = weights
        slope, offset = platt(np.array([full[r].sum() + bias for r, h in zip(lists, holds, strict=True) if h]), truth[holds])
        return pa.table({"bucket": pa.array(np.append(places, -1), pa.int32()), "weight": pa.array(np.append(weights * slope, bias * slope + offset))})

    # One group of ``sample`` rows; BUCKETS + 1 numbers come to the driver.
    found = rows.withColumn("group", F.lit(0)).groupBy("group").applyInArrow(run, "bucket int, weight double").collect()
    weights, bias = np.zeros(1 << hashing.bits, np.float32), 0.0
    for r in found:
        if r.bucket < 0:
            bias = r.weight
        else:
            weights[r.bucket] = r.weight
    return Linear(hashing, weights, bias)


def judged(documents: DataFrame, model: Linear, keep_from: float = KEEP_FROM) -> DataFrame:
    """``doc_id``, the counts of ``counts``, ``base_failed, kept`` and the ``probability`` of good quality, of every row.

    A text fails the base rules with fewer than 50 words or with more than half its words in repeated windows; the others
    are kept from a probability of ``keep_from``. Null and empty texts have no words and fail. Repeated rows each give a row,
    a null doc_id stays null, no rows give no rows, other columns are left out.
    """
    shipped, hashing, bias = documents.sparkSession.sparkContext.broadcast(model.weights), model.hashing, model.bias
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Linear(hashing, shipped.value, bias)
        for batch in slices(batches, "text", 1 << 19):
            texts = batch.column("text").to_pylist()
            columns = [np.array(c, np.int64) for c in zip(*map(counts, texts), strict=True)]
            failed = (columns[0] < MIN_WORDS) | (100 * columns[4] > REPEAT_PERCENT * columns[0])
            probability = sigmoid(own.margins(texts))
            kept = ~failed & (probability >= keep_from)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns), pa.array(failed), pa.array(kept), pa.array(probability)], ["doc_id", *names, "base_failed", "kept", "probability"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, probability double"
    return keyed_texts(documents).mapInArrow(run, schema)


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows, judge every document."""
    return judged(documents, train(documents, labels))
