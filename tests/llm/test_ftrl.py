"""The online learner against a plain one, vectors against a plain count, predictions on held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from casebook.llm import ftrl
from casebook.llm.features import Hashing
from tests.conftest import SMALL
from tests.llm.helpers import clash, docs
from tests.llm.test_classifiers import LABELS, corpus

H = Hashing(chars=(), words=(1, 2), lower=False, bits=16)


def plain_vector(text):
    words = text.split()
    grams = Counter(int(H.buckets([w])[1][0]) for w in words)
    pairs = [int(H.buckets([f"{a} {b}"])[1][-1]) for a, b in zip(words, words[1:], strict=False)]
    grams.update(pairs)
    vector = {g: 1 + math.log(n) for g, n in grams.items()} | {1 << H.bits: 1.0}
    norm = math.sqrt(sum(v * v for v in vector.values()))
    return {g: v / norm for g, v in vector.items()}


def test_vectors_against_plain_count():
    texts = ["a b a b", "", "one", "\n\t ", "x " * 500 + "y", "É é"]
    doc, place, values = ftrl.vectors(H, texts)
    for i, text in enumerate(texts):
        got = dict(zip(place[doc == i].tolist(), values[doc == i].tolist(), strict=True))
        want = plain_vector(text)
        assert got.keys() == want.keys() and all(math.isclose(got[g], want[g]) for g in want)


def test_learner_against_plain_one():
    rng = random.Random(3)
    leader, z, squares = ftrl.Leader(8, alpha=0.7, beta=1.0, l1=0.2, l2=0.1), [0.0] * 9, [0.0] * 9

    def weight(i):
        l1 = 0 if i == 8 else 0.2
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(squares[i])) / 0.7 + 0.1)

    for _ in range(200):
        places = sorted(rng.sample(range(8), rng.randint(0, 5))) + [8]
        values, good, importance = [rng.random() for _ in places], rng.randint(0, 1), rng.random()
        weights = [weight(i) for i in places]
        p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, values, strict=True))))
        for i, w, v in zip(places, weights, values, strict=True):
            g = importance * (p - good) * v
            sigma = (math.sqrt(squares[i] + g * g) - math.sqrt(squares[i])) / 0.7
            z[i] += g - sigma * w
            squares[i] += g * g
        leader.learn(np.array(places), np.array(values), good, importance)
    assert np.allclose(leader.weights(np.arange(9)), [weight(i) for i in range(9)])


def test_held_out_rows(spark):
    texts, labels = corpus(800)
    ids = [*range(len(texts)), 900, 901, 5, None]
    frame = clash(docs(spark, [*texts, None, "", texts[0], "x" * 200_000 + " y" * 50_000], ids), "good", "score", "bucket", "epoch")
    shown = [(i, q, t) for i, q, t in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    # labels of the held-out fold are never read: wrong ones change nothing
    wrong = [(i, 1 - q, t) for i, q, t in labels if zlib.crc32(str(i).encode()) % 4 == 2] + [(None, None, None), (1, None, 1)]
    rows = ftrl.predictions(frame, spark.createDataFrame(shown + wrong, LABELS)).collect()
    assert len(rows) == len(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 800]
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) > 0.97 * len(held) > 100
    again = ftrl.predictions(frame, spark.createDataFrame(shown, LABELS)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


@pytest.mark.parametrize("rows", [[], [(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0)]])
def test_one_class(spark, rows):
    known = len({i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2})
    score = (known + 1) / (known + 2)
    labels = spark.createDataFrame(rows, LABELS)
    got = ftrl.predictions(docs(spark, ["a b", "a b", None]), labels).collect()
    assert all(math.isclose(r.score, score, abs_tol=1e-6) for r in got) and len(got) == 3
    assert ftrl.predictions(docs(spark, ["a"]).limit(0), labels).collect() == []


def test_given_tables(spark):
    documents, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    assert ftrl.predictions(documents, labels).count() == documents.count()
