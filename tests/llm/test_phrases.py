"""Collocations against a brute-force count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest

from casebook.llm import phrases
from tests.conftest import SMALL
from tests.llm.helpers import DOCS, clash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order=5, least=100, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, order + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            )
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "é", "É", "of", "the", "x\x1cy", "ß", "w", "\x85"]
    marks = [" ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "\x0c", "? ", "!"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", None), ("of the a " * 3000, "en"), (rows[0][0], "en"), ("q q q q q q q q", "fr")]


@pytest.mark.parametrize(("seed", "least", "top", "bits"), [(1, 4, 2000, 23), (2, 3, 7, 23), (3, 4, 2000, 6)])
def test_against_brute_force(spark, seed, least, top, bits):
    """Also with a filter of 64 bits, which lets every pair through."""
    rows = random_rows(seed)
    documents = clash(frame(spark, rows), "w1", "phrase", "k", "words", "count")
    got = phrases.collocations(documents, least=least, top=top, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least=least, top=top) != []


def test_no_rows_and_no_phrases(spark):
    assert phrases.collocations(frame(spark, [("a b c", "en")]).limit(0)).collect() == []
    assert phrases.collocations(frame(spark, [("a b c d", "en"), (None, None)])).collect() == []


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r pass 2 ** 64; the quotient is floored, ties go to the earlier cut."""
    big = 10**16
    found = [("en", 1, 3 * big + 1, ["x"]), ("en", 1, 2 * big + 3, ["y"]), ("en", 1, big + 7, ["z"]), ("en", 2, 9 * 10**15 + 1, ["x", "y"])]
    found += [("en", 2, 8 * 10**15, ["y", "z"]), ("en", 3, 7 * 10**15, ["x", "y", "z"]), ("en", 2, 5 * 10**15, ["y", "y"])]
    frame_ = spark.createDataFrame([(*r, " ".join(r[3])) for r in found], "lang string, k int, f long, words array<string>, phrase string")
    n = 9 * big + 11
    got = {r.phrase: r for r in phrases.cuts(frame_, spark.createDataFrame([("en", n)], "lang string, n long")).collect()}
    f = {" ".join(w): c for _, _, c, w in found}
    assert got["x y"].score == 1000 * f["x y"] * n // (f["x"] * f["y"]) and (got["x y"].l, got["x y"].r) == (f["x"], f["y"])
    cuts = {1: 1000 * f["x y z"] * n // (f["x"] * f["y z"]), 2: 1000 * f["x y z"] * n // (f["x y"] * f["z"])}
    assert got["x y z"].score == min(cuts.values())


def test_given_table(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.text, r.lang) for r in documents.collect()]
    assert sorted(map(tuple, phrases.collocations(documents, least=20).collect())) == brute(rows, least=20) != []
