"""Hashed n-grams of whole texts, and linear models over their presence in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import give_back, keyed_texts, slices

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Hashing:
    """Which n-grams are taken, and into how many buckets (2 ** bits) they are hashed.

    Character n-grams run over the UTF-8 bytes of a text with one blank at both ends, all blanks being alike; word n-grams run
    over runs of other characters.
    """

    chars: tuple[int, ...] = (5,)
    words: tuple[int, ...] = (1,)
    lower: bool = True
    bits: int = 20

    def buckets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For every n-gram of every text, repeats included: the text's place in the list, and the bucket."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        blank = _BLANK[data]
        data = np.where(blank, np.uint8(32), _LOWER[data] if self.lower else data)
        # A text owns the places from the blank before it to its last byte; its n-grams end on the blank behind it at the latest.
        lengths = np.array([len(r) + 1 for r in raw], np.int64)
        ends = np.cumsum(lengths)
        doc, limit = np.repeat(np.arange(len(raw)), lengths), np.repeat(ends, lengths)
        docs, found = [np.empty(0, np.int64)], [np.empty(0, np.int32)]

        def keep(owners: np.ndarray, grams: np.ndarray, kind: int) -> None:
            mixed = (grams + np.uint64(kind)) * _MIX
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
            docs.append(owners)
            found.append((mixed >> np.uint64(64 - self.bits)).astype(np.int32))

        for n in self.chars:
            m = len(data) - n + 1
            if m < 1:
                continue
            grams = np.zeros(m, np.uint64)
            for i in range(n):
                grams = (grams << np.uint64(8)) | data[i : m + i]
            m = min(m, len(doc))
            own = np.arange(n - 1, m + n - 1) <= limit[:m]
            keep(doc[:m][own], grams[:m][own], n)
        starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        if self.words and len(starts):
            begun = np.zeros(len(data), np.int64)
            begun[starts] = 1
            place = np.arange(len(data)) - starts[np.maximum(np.cumsum(begun) - 1, 0)]
            letters = np.where(blank, np.uint64(0), (data + np.uint64(1)) * _POWERS[place & 63])
            word, owner = np.add.reduceat(letters, starts) * _MIX, doc[starts]
            for n in self.words:
                m = len(word) - n + 1
                if m < 1:
                    continue
                grams = np.zeros(m, np.uint64)
                for i in range(n):
                    grams = grams * _POWERS[7] + word[i : m + i]
                own = owner[:m] == owner[n - 1 :]
                keep(owner[:m][own], grams[own], 100 + n)
        return np.concatenate(docs), np.concatenate(found)

    def distinct(self, texts: list[str]) -> list[np.ndarray]:
        """The buckets of each text, each once."""
        doc, bucket = self.buckets(texts)
        pairs = np.unique((doc << self.bits) | bucket)
        cuts = np.searchsorted(pairs >> self.bits, np.arange(1, len(texts)))
        return [p.astype(np.int32) for p in np.split(pairs & ((1 << self.bits) - 1), cuts)]


@dataclass(frozen=True)
class Linear:
    """Weights of buckets (zero: not used) and a bias; the margin is their sum over the buckets that a text has."""

    hashing: Hashing
    weights: np.ndarray
    bias: float

    def margins(self, texts: list[str]) -> np.ndarray:
        doc, bucket = self.hashing.buckets(texts)
        used = np.flatnonzero(self.weights[bucket])
        pairs = np.unique((doc[used] << self.hashing.bits) | bucket[used])
        weights = self.weights[pairs & ((1 << self.hashing.bits) - 1)]
        return np.bincount(pairs >> self.hashing.bits, weights=weights, minlength=len(texts)) + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _held(rows: list[np.ndarray], bits: int, at_once: int = 256) -> np.ndarray:
    """How many rows hold each bucket, counted ``at_once`` rows at a time."""
    counts = np.zeros(1 << bits, np.int64)
    for start in range(0, len(rows), at_once):
        counts += np.bincount(np.concatenate(rows[start : start + at_once]), minlength=1 << bits)
    return counts


class Rows:
    """Training rows over the ``most`` buckets whose presence differs most between two groups of rows."""

    def __init__(self, one: list[np.ndarray], other: list[np.ndarray], bits: int, most: int, least_rows: int = 3, least_z: float = 0.0):
        counts = [_held(g, bits) for g in (one, other)]
        n, m = max(1, len(one)), max(1, len(other))
        share = (counts[0] + counts[1]) / (n + m)
        spread = np.sqrt(share * (1 - share) * (1 / n + 1 / m)) + 1e-9
        z = np.abs(counts[0] / n - counts[1] / m) / spread
        z[(counts[0] + counts[1] < least_rows) | (z < least_z)] = 0
        chosen = np.argsort(-z, kind="stable")[:most]
        self.chosen = np.sort(chosen[z[chosen] > 0])
        column = np.full(1 << bits, -1, np.int64)
        column[self.chosen] = np.arange(len(self.chosen))
        rows = [*one, *other]
        # a row is cut to its chosen buckets at once: all rows as numbers of 64 bits never stand side by side
        columns = [c[c >= 0] for c in (column[r] for r in rows)]
        self.row = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
        self.column = np.concatenate([*columns, np.empty(0, np.int64)])
        self.n = len(rows)

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.column], minlength=self.n) + bias

    def gradient(self, by_row: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(self.column, weights=by_row[self.row], minlength=len(self.chosen)), float(by_row.sum())


def descend(rows: Rows, slope, penalty: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Adam over all rows at once; ``slope`` maps margins to the loss's derivative by row."""
    theta = np.zeros(len(rows.chosen) + 1)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g, b = rows.gradient(slope(rows.margins(theta[:-1], theta[-1])))
        g = np.append(g + penalty * theta[:-1], b)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        theta -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def featurised(rows: DataFrame, hashing: Hashing, carried: list[str]) -> DataFrame:
    """The carried columns and ``buckets``, the distinct buckets of ``text`` (never null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            lists = hashing.distinct(batch.column("text").to_pylist())
            buckets = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), buckets], [*carried, "buckets"])
        give_back()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*carried, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", buckets array<int>")


def lists_of(table: pa.Table, name: str = "buckets") -> list[np.ndarray]:
    column = table.column(name).combine_chunks()
    if not len(column):
        return []
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def by_hash(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` of the distinct doc_ids, the first by a hash: the bounded sample that a model is fitted on."""
    return ids.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def sample_features(documents: DataFrame, sample: DataFrame, hashing: Hashing) -> DataFrame:
    """``sample`` (a bounded table of doc_id and further columns) with the buckets of each document's whole text.

    One pass over the documents; of rows with equal doc_id the smallest text counts. The broadcast is as small as the sample.
    """
    wanted = F.broadcast(sample.select("doc_id").distinct())
    texts = keyed_texts(documents).join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return featurised(texts, hashing, ["doc_id"]).join(F.broadcast(sample), "doc_id")


def score_udf(model: Linear, finish):
    """A vectorised column function from text to ``finish(margin)``; the model is a fixed number of weights."""
    from pyspark.sql import SparkSession

    shipped, hashing, bias = SparkSession.active().sparkContext.broadcast(model.weights), model.hashing, model.bias

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Linear(hashing, shipped.value, bias)
        for series in texts:
            out, part, held = [], [], 0
            for text in series:
                part.append(text)
                held += len(text)
                if held > 1 << 18:
                    out.append(finish(own.margins(part)))
                    part, held = [], 0
            if part:
                out.append(finish(own.margins(part)))
            yield pd.Series(np.concatenate([*out, np.empty(0)]))
        give_back()

    return score
