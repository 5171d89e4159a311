"""Pieces against the tokenizer itself, packing against its laws, bounds against an exhaustive search."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from casebook.llm import packing
from tests.llm.helpers import clash, docs

ALPHABET = "abAB \n\t\x1c\x85　é'sLL 12½Ⅷ.,;-_|́漢字😀​İ"


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(9)
    fuzz = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return [None, "", " \n", "|", "a|b | c", "<|endoftext|>", "It's |  we'll", "word " * 9000, "x" * 30_000, *fuzz]


def test_pieces(spark):
    model = tokenizer()
    given = texts()
    got = {}
    for r in packing.pieces(clash(docs(spark, given), "piece", "length", "ids"), ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(given):
        want = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        rows = sorted(got[i], key=lambda r: r.piece)
        raw = b"".join(bytes(r.ids) for r in rows)
        assert np.frombuffer(raw, "<u4").tolist() == want
        assert [r.piece for r in rows] == list(range(-(-len(want) // 4096)))
        assert all(r.start == 4096 * r.piece and r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
        assert all(r.length == 4096 for r in rows[:-1])


def sound(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_documents_and_sequences(spark):
    given = texts()
    rows = packing.pack_documents(docs(spark, given, [*range(len(given) - 2), 3, None]), ids=True)
    found = rows.collect()
    assert sound(found, 4096) == -(-sum(r.length for r in found) // 4096)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(rows).collect()}
    assert all(whole[r.sequence_id][4 * r.offset :].startswith(bytes(r.ids)) for r in found)
    assert packing.pack_documents(docs(spark, ["a"]).limit(0)).collect() == []


def test_exchange_closes_gaps(spark):
    """Partitions of few pieces leave gaps; the exchange comes near to one partition of all pieces."""
    rng = random.Random(1)
    lengths = [rng.choice([1, 7, 30, 45, 51, 99, 100]) for _ in range(1500)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item long, length long").repartition(5)
    alone = len(set(packing.best_fit_decreasing(np.array(lengths), 100)[0]))
    got = packing.pack(items, capacity=100, group_pieces=60).collect()
    assert sorted(r["item"] for r in got) == list(range(1500))
    one_round = sound(packing.pack(items, capacity=100, group_pieces=60, rounds=1).collect(), 100)
    n = sound(got, 100)
    assert packing.lower_bound(*np.unique(lengths, return_counts=True), 100) <= n <= alone + 4 and n < one_round


def fewest(lengths, capacity):
    """The optimum by trying every assignment."""
    best = len(lengths)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(lengths):
            best = len(loads)
            return
        for j in {load: j for j, load in enumerate(loads) if load + lengths[i] <= capacity}.values():
            loads[j] += lengths[i]
            place(i + 1, loads)
            loads[j] -= lengths[i]
        place(i + 1, [*loads, lengths[i]])

    place(0, [])
    return best


def test_bounds_hold():
    rng = random.Random(8)
    tight = 0
    for _ in range(150):
        capacity = rng.choice([10, 12, 30])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        bound = packing.lower_bound(*np.unique(lengths, return_counts=True), capacity)
        optimum = fewest(lengths, capacity)
        bins, offsets = packing.best_fit_decreasing(np.array(lengths), capacity)
        assert bound <= optimum <= len(set(bins.tolist()))
        tight += bound == optimum
    assert tight > 130
    assert packing.lower_bound(np.array([6, 7]), np.array([3, 2]), 10) == 5  # pairs never fit, though the sum would


def test_best_fit_takes_the_smallest_room():
    bins, _ = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and list(itertools.accumulate([5, 3, 2]))[-1] == 10
