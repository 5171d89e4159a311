"""Encoding against tiktoken itself, decoding as an exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from casebook.llm import bpe
from tests.llm.helpers import clash, docs

ALPHABET = "ab \n\t\x1c\x85　é'sll 12½Ⅷ.,;-_́漢字😀​\r\x00"


def known():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    fuzz = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [None, "", " ", "a" * 20_000, " " * 9_000, "ab" * 9_000, "<|endoftext|>", "It's  we'll\n\n x", *fuzz, "It's  we'll\n\n x"]


def test_ids_and_round_trip(spark):
    _, reference = known()
    given = texts()
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(clash(docs(spark, given), "ids", "decoded"))).collect()}
    assert len(got) == len(given)
    for i, t in enumerate(given):
        assert got[i].ids == reference.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()


def test_digests(spark):
    _, reference = known()
    given = texts()[:40]
    for r in bpe.digests(docs(spark, given)).collect():
        ids = reference.encode_ordinary(given[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((given[r.doc_id] or "").encode()).hexdigest()


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = bpe.digests(docs(spark, ["a", "a", "b"], [5, 5, None])).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == [(False, 5), (False, 5), (True, None)]
    assert bpe.digests(docs(spark, ["a"]).limit(0)).collect() == []


def test_small_cache_changes_nothing(monkeypatch):
    ranks, reference = known()
    monkeypatch.setattr(bpe, "CACHED_SEGMENTS", 2)
    encoder = bpe.Encoder(bpe.serialise_model(ranks), ranks, public_tokenizers.PATTERN)
    for t in texts()[3:60]:
        ids, ends = encoder([t, t])
        assert np.frombuffer(ids, "<i4").tolist() == reference.encode_ordinary(t) * 2 and ends == [0, len(ids) // 8, len(ids) // 4]
