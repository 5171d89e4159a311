"""Removed bytes against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest

from casebook.llm import induced, spans
from tests.llm.helpers import clash, docs


def brute(rows, length=50):
    first = {}
    key = {None: float("inf")}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            first[s] = min(first.get(s, float("inf")), key.get(doc, doc))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < key.get(doc, doc):
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sample(seed=1, n=70):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "délta", "漢字", "x", "longerword", "\n"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "é" * 25), (3, "é" * 25), (4, "a" * 49), (5, "a" * 49), (6, "a" * 5000), (7, "a" * 300 + "b" * 80), (8, "ab" * 400), (9, "ab" * 90 + "a")]
    for i in range(10, n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a:], p[:a], p.replace("x", "y"), str(rng.random()) * 4]))
        rows.append((i, " ".join(parts)))
    rows += [(n + i, rows[20 + i][1]) for i in range(8)] + [(15, rows[30][1]), (15, rows[30][1]), (None, rows[31][1]), (None, rows[31][1]), (-4, rows[33][1])]
    return rows


def found(frame, **options):
    from pyspark.sql import functions as F

    rows = spans.remove_repeats(frame, **options)
    return sorted(map(tuple, rows.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=repr)


@pytest.mark.parametrize("options,hot", [({}, 4), ({"shard_bytes": 20_000, "sort_bytes": 2000, "queue_bytes": 1 << 14}, 4), ({"length": 24}, 1), ({"shard_bytes": 30_000}, 0), ({}, 2), ({"shard_bytes": 25_000}, 3)])
def test_against_brute_force(spark, monkeypatch, options, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    rows = sample(seed=hot + 1)
    frame = clash(docs(spark, [t for _, t in rows], [d for d, _ in rows]), "slice", "hash", "doc", "kept", "shard", "first")
    want = brute(rows, options.get("length", 50))
    assert found(frame, **options) == want
    assert sum(r[2] for r in want) > 1000


def test_hot_anchor_in_some_slices(spark, monkeypatch):
    """Few rows to a slice: an anchor is hot in some slices only, and equal fragments meet all the same."""
    monkeypatch.setattr(spans, "HOT", 1)
    monkeypatch.setattr(spans, "SLICE_BYTES", 1500)
    rng = random.Random(3)
    phrase = "Released under the usual terms."
    rows = []
    for i in range(90):
        tail = rng.choice([f"{rng.random()} {rng.random()} {rng.random()}", "a very usual tail that many of them have in common, more or less"])
        head = rng.choice([f"{rng.random()} {rng.random()} {rng.random()}", "a very usual head that many of them have in common, more or less"])
        rows.append((i, head + phrase + tail))
    rng.shuffle(rows)
    assert found(docs(spark, [t for _, t in rows], [d for d, _ in rows])) == brute(rows)


def test_rows_keep_their_columns_and_whole_characters(spark):
    text = "漢" * 30
    frame = docs(spark, [text, "é" + text[:-1] + "z", "own"])
    got = {r.doc.doc_id: r for r in spans.remove_repeats(frame).collect()}
    assert got[0].doc.text == text and got[2].doc.text == "own" and got[1].doc.text == "éz" and got[1].doc.lang == "en"
    assert spans.remove_repeats(frame.limit(0)).collect() == []
    with pytest.raises(ValueError, match="length"):
        spans.remove_repeats(frame, length=10)


def test_slices_and_parts_change_nothing(spark, monkeypatch):
    """Fragments cut at the edge of a part are compared byte by byte instead of as a whole."""
    rows = sample(seed=5, n=40)
    texts, docs_ = [(t or "").encode() for _, t in rows], np.array([spans.LAST if d is None else d for d, _ in rows])
    whole = spans.Fragments(texts, 50)
    monkeypatch.setattr(spans, "PART_BYTES", 300)
    cut = spans.Fragments(texts, 50)

    def windows(f):
        return {(d, s + k) for d, s, n in zip(f.doc.tolist(), f.start.tolist(), f.size.tolist(), strict=True) for k in range(n - 49)}

    assert windows(whole) == windows(cut) and len(cut.doc) > len(whole.doc)
    starts = spans.repeated_windows(texts, docs_, 50, None)
    want = {r[0]: r[2] for r in brute(rows) if r[0] not in (None, 15)}
    for (doc, _), text, at in zip(rows, texts, starts, strict=True):
        gone = np.zeros(len(text), bool)
        for a in at:
            gone[a : a + 50] = True
        if doc in want:
            assert gone.sum() == want[doc]


def test_hot_key_goes_through_files(tmp_path):
    """All parts share one key, far more than the queues may hold in memory."""
    rng = random.Random(0)
    parts = [bytes(rng.choice(b"abc") for _ in range(20)) + b"common passage of more than fifty bytes, in all of the parts." + bytes(rng.choice(b"abc") for _ in range(20)) for _ in range(300)]
    scratch = induced.Scratch(f"file://{tmp_path}/q")
    got = spans.repeated_windows(parts, np.arange(300), 50, scratch, most=4000)
    scratch.close()
    first = {}
    for d, p in enumerate(parts):
        for i in range(len(p) - 49):
            first.setdefault(p[i : i + 50], d)
    assert scratch.written and [g.tolist() for g in got] == [[i for i in range(len(p) - 49) if first[p[i : i + 50]] < d] for d, p in enumerate(parts)]


def test_no_sort_holds_a_hot_key(spark, monkeypatch):
    """One passage in many surroundings: its edges are keys of far more than ``sort_bytes``, and no task may sort them at once."""
    most, sort = 5000, spans.repeated_windows

    def bounded(parts, *rest):
        assert sum(map(len, parts)) <= 2 * most
        return sort(parts, *rest)

    monkeypatch.setattr(spans, "repeated_windows", bounded)
    monkeypatch.setattr(spans, "SLICE_BYTES", 6000)
    rng = random.Random(8)
    passage = "The same notice stands in each of these documents, whatever else is in them."

    def side():
        return rng.choice([str(rng.random()), "some usual words", f"{rng.random()} some", ""]) + rng.choice("ab ")

    rows = [(rng.choice([None, i, i, i, 7]), side() + side() + passage + rng.choice("ab ") + side()) for i in range(500)]
    key = [d for d, _ in rows]
    got = found(docs(spark, [t for _, t in rows], key), sort_bytes=most)
    assert got == brute(rows) and sum(r[2] for r in got) > 20_000
