"""Fingerprints, links and components against brute force."""

import itertools
import random
import re

import xxhash

from casebook.llm import simhash
from tests.llm.helpers import clash, docs


def brute_fingerprint(text, k=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= bits:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sample():
    rng = random.Random(2)
    base = [" ".join(rng.choice("alpha Beta gamma Ünï delta eps zeta\x1c eta".split(" ")) for _ in range(rng.randint(0, 40))) for _ in range(25)]
    near = [t.replace("eta", "ETA").replace("  ", " ") + rng.choice([" tail", " gamma", "\n"]) for t in base * 3]
    return [None, "", " \t\n", "one", "one two", "One Two", "one two three", *base, *near, "word " * 30_000, "word " * 30_001]


def test_fingerprints_and_components(spark):
    texts = sample()
    got = {r.doc_id: r for r in simhash.near_duplicates(clash(docs(spark, texts), "fp", "fingerprint", "node", "root", "first")).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    roots = brute_components(fps)
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(roots[f], i)
    assert len(got) == len(texts)
    for i, f in enumerate(fps):
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", first[roots[f]])


def test_links_of_close_fingerprints(spark):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(12):
            x = centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    frame = spark.createDataFrame([(signed(f),) for f in fps] + [(None,), (0,)], "fp long")
    for bits in (0, 1, 3):
        got = {(r.a, r.b) for r in simhash.links(frame, bits).collect()}
        want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= bits}
        assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2001, 2000), (2000, 2001)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)} | {2001: 2000}
    assert got == want


def test_first_of_each_nulls_and_no_rows(spark):
    frame = docs(spark, ["a b c d", "a b c d", "other words here", "other words here", "x", "x"], [7, 3, 9, 9, None, None])
    kept = simhash.first_of_each(frame).collect()
    assert sorted((r.doc_id or -1, r.text, r.lang) for r in kept) == [(-1, "x", "en"), (3, "a b c d", "en"), (9, "other words here", "en")]
    assert simhash.near_duplicates(frame.limit(0)).collect() == []


def test_first_of_each_keeps_a_row_of_every_component(spark):
    """Different texts under one doc_id or under null are not one document; a null row does not bring back a copy of a kept one."""
    rng = random.Random(6)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(5))
    frame = docs(spark, [a, b, c, d, e, a, c, d, d], [9, 9, None, None, 1, None, None, None, 4])
    for rows in (frame, clash(frame, "kept", "sum", "first", "doc", "root")):
        kept = simhash.first_of_each(rows)
        assert kept.columns == rows.columns
        assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(9, a), (9, b), (-1, c), (4, d), (1, e)])
    one = docs(spark, ["same words here", "Same words here", "SAME words here"], [2, 2, None])
    assert [r.doc_id for r in simhash.first_of_each(one).collect()] == [2]
