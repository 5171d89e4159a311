"""Features against a plain count, the counts of the rules against brute force, both classifiers on held-out rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from casebook.llm import quality, toxicity
from casebook.llm.features import Hashing, Linear, sigmoid
from tests.conftest import SMALL
from tests.llm.helpers import clash, docs

LABELS = "doc_id long, quality int, toxic int"


def test_features_do_not_cross_texts():
    h = Hashing(chars=(3, 5), words=(1, 2), lower=True, bits=18)
    texts = ["One two  three", "", "x", "one TWO three", "\n", "three one", "é" * 3000]
    alone = [h.distinct([t])[0] for t in texts]
    together = h.distinct(texts)
    assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    assert np.array_equal(h.distinct(["a  b"])[0], h.distinct(["a  B"])[0]) and not len(alone[1])
    doc, bucket = h.buckets(["ab cd ab"])
    # ' ab cd ab ' has 8 grams of 3 and 6 of 5; 3 words; 2 pairs
    assert len(bucket) == 8 + 6 + 3 + 2 and set(doc) == {0}
    assert len(h.distinct(["ab cd ab"])[0]) == len(set(bucket.tolist()))


def test_margins_count_presence():
    h = Hashing(chars=(), words=(1,), bits=16)
    weights = np.zeros(1 << 16, np.float32)
    weights[h.distinct(["bad"])[0]] = 2
    model = Linear(h, weights, -1.0)
    assert model.margins(["bad bad bad", "good", "", "so bad"]).tolist() == [1, -1, -1, 1]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] >= 2 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", "c ", "\n", "é ", "#", "\x1c", "\x85", "\x0b", "a b c "]) for _ in range(rng.randint(0, 60)))
        assert quality.counts(text) == brute_counts(text)
    assert quality.counts("") == (0, 0, 0, 0, 0)


def corpus(n=400, seed=1):
    """Texts of made-up words; toxic ones hold an insult, bad ones end their words in symbols."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            words[rng.randrange(60)] = "zzinsult"
        rows.append(" ".join(w + "###" for w in words) if bad else " ".join(words))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    texts, labels = corpus()
    frame = clash(docs(spark, [*texts, None, "", texts[0], "x" * 50_000], [*range(len(texts)), 900, 901, 5, None]), "bag", "score", "buckets")
    shown = [(i, q, t) for i, q, t in labels if i % 2 == 0 and zlib.crc32(str(i).encode()) % 3 != 1]
    extra = [(i, q, 1 - t) for i, q, t in labels if zlib.crc32(str(i).encode()) % 3 == 1] + [(None, None, None), (1, 1, None)]
    rows = toxicity.predictions(frame, spark.createDataFrame(shown + extra, LABELS)).collect()
    assert len(rows) == len(texts) + 4
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    right = [r for r in held if r.predicted == labels[r.doc_id][2]]
    assert len(right) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1
    kept = toxicity.harmless(frame, spark.createDataFrame(shown, LABELS))
    assert kept.columns == frame.columns and kept.count() == sum(not r.predicted for r in rows)


def test_toxicity_without_examples_or_rows(spark):
    frame, labels = docs(spark, ["a", "b"]), spark.createDataFrame([(0, 1, 0), (1, 1, None)], LABELS)
    assert {r.score for r in toxicity.predictions(frame, labels).collect()} == {0.0}
    assert toxicity.predictions(frame.limit(0), labels.limit(0)).collect() == []


def test_quality_on_unseen_rows(spark):
    texts, labels = corpus()
    frame = clash(docs(spark, [*texts, None, "", "short text", texts[0]], [*range(len(texts)), 900, 901, 902, None]), "n_words", "kept", "holds")
    known = spark.createDataFrame([row for row in labels if row[0] < 250] + [(None, 1, 0), (260, None, 0)], LABELS)
    rows = quality.verdicts(frame, known).collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        t = "" if r.doc_id in (900, 901) else "short text" if r.doc_id == 902 else texts[r.doc_id or 0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    unseen = [r for r in rows if r.doc_id is not None and 250 <= r.doc_id < 400]
    assert sum(r.kept == bool(labels[r.doc_id][1]) for r in unseen) > 0.97 * len(unseen)


@pytest.mark.parametrize("rows", [[], [(0, 1, 0), (1, 1, 0)]])
def test_quality_with_one_class(spark, rows):
    text = " ".join(f"word{i}" for i in range(60))
    got = quality.verdicts(docs(spark, [text, text]), spark.createDataFrame(rows, LABELS)).collect()
    assert [r.kept for r in got] == [True, True]
    assert quality.verdicts(docs(spark, [text]).limit(0), spark.createDataFrame(rows, LABELS)).collect() == []


def test_calibration():
    rng = np.random.default_rng(0)
    margins = rng.normal(0, 3, 4000)
    truth = (rng.random(4000) < sigmoid(0.5 * margins + 1)).astype(float)
    slope, offset = quality.platt(margins, truth)
    assert abs(slope - 0.5) < 0.05 and abs(offset - 1) < 0.15


def test_given_tables(spark):
    documents, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    assert toxicity.predictions(documents, labels).count() == documents.count() == quality.verdicts(documents, labels).count()
