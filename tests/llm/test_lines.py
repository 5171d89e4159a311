"""Line dedup against a brute-force version."""

import hashlib
import random
from collections import defaultdict

from casebook.llm import lines
from tests.llm.helpers import clash, docs


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)


def expected(rows, min_chars=10, min_docs=2):
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        left = []
        for line in all_lines:
            k = key(line)
            first = min((d for d in held[k] if d is not None), default=None)
            if len(k) < min_chars or len(held[k]) < min_docs or doc == first:
                left.append(line)
        out.append((doc, len(all_lines), len(all_lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(5)
    pool = ["Common line number one", "  common LINE number one\t", "ÄÖÜ äöü ßß zz", "äöü ÄÖÜ", "short", "", "x" * 50_000, "123456789", "1234567890", "\x0b1234567890\r", "\x1c1234567890"]
    texts = ["\n".join(rng.choice([*pool, f"own {rng.random()}"]) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    rows = list(enumerate([None, "", "\n", "\n\n", *texts]))
    return [*rows, (10, texts[0]), (10, texts[1]), (None, texts[2]), (None, texts[2]), (-5, "1234567890")]


def test_against_brute_force(spark):
    rows = sample()
    frame = clash(docs(spark, [t for _, t in rows], [d for d, _ in rows]), "key", "keys", "first", "doc", "losing", "n")
    assert sorted(map(tuple, lines.digests(frame).collect()), key=repr) == expected(rows)


def test_higher_threshold(spark):
    rows = sample()
    got = lines.drop_lines(docs(spark, [t for _, t in rows], [d for d, _ in rows]), min_chars=3, min_docs=20).collect()
    got = sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.doc.text or "").encode()).hexdigest()) for r in got), key=repr)
    assert got == expected(rows, 3, 20)


def test_other_columns_stay_and_no_rows(spark):
    frame = docs(spark, ["one long line here", "one long line here\nand mine alone"])
    got = {r.doc.doc_id: r.doc for r in lines.drop_lines(frame).collect()}
    assert got[1].text == "and mine alone" and got[1].lang == "en" and got[0].text == "one long line here"
    assert lines.digests(frame.limit(0)).collect() == []


def test_lists_are_bounded_by_one_row(spark):
    """Many rows without doc_id, or of one doc_id, that each lose lines of their own."""
    held = ["\n".join(f"line {j} of document number {i}" for j in range(3)) for i in range(40)]
    rows = [*enumerate(held), *((None, f"{t}\nmy own line {i} here") for i, t in enumerate(held)), *((99, t) for t in held), (None, held[0]), (None, None)]
    frame = clash(docs(spark, [t for _, t in rows], [d for d, _ in rows]), "part", "losing_part", "keys")
    assert max(len(r["keys"]) for r in lines.marked(frame).collect()) == 3
    assert sorted(map(tuple, lines.digests(frame).collect()), key=repr) == expected(rows)
