"""Filter interactions against a loop over all orders."""

import random
import re
from itertools import permutations

from casebook.llm import audit
from tests.conftest import SMALL
from tests.llm.helpers import DOCS, clash

LABELS = "doc_id long, quality int, toxic int"


def failed(text, doc_id, smallest):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": doc_id is not None and doc_id > smallest.get(text, doc_id),
    }
    return {f for f, bad in tests.items() if bad}


def brute(rows, labels):
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for doc_id, text, lang in rows:
        parts.setdefault(lang or "", []).append((failed(text or "", doc_id, smallest), doc_id in good, doc_id in toxic))
    out = {}
    for part, documents in parts.items():
        sums = dict.fromkeys(audit.FILTERS, 0)
        lines = []
        for order in permutations(audit.FILTERS):
            left = documents
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                fails, alone = sum(f in d[0] for d in documents), sum(d[0] == {f} for d in documents)
                sums[f] += len(gone)
                lines.append((("".join(order), step), f, [len(left), len(gone), fails - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)]))
        for key, f, counts in lines:
            out[part, *key] = (*counts, sums[f])
    return out


def as_dict(frame):
    rows = frame.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = []
    for i in range(60):
        words = [rng.choice(["w", "Wo", "x#", "ABC", "é", "l"]) + (str(rng.randrange(300)) if i % 3 else "") for _ in range(rng.choice([3, 150, 250]))]
        base.append(rng.choice([" ", "\n", "\x0b ", "\x85"]).join(words))
    rows = [(i, rng.choice(base), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(7, base[0], "en"), (7, base[1], "en"), (None, base[2], "en"), (None, base[2], None), (500, None, "fr"), (501, "", "fr"), (502, "v " * 60_000, "de")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 150, 2)] + [(None, 1, 1), (4, 1, None), (4, None, 1), (7, 1, 0), (999, 1, 1)]
    documents = clash(spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS).repartition(3), "row", "part", "failed", "prefix", "A")
    got = audit.interactions(documents, spark.createDataFrame(labels, LABELS))
    assert as_dict(got) == brute(rows, labels)


def test_nothing_fails_and_no_rows(spark):
    text = " ".join(f"word{i}" for i in range(200))
    documents = spark.createDataFrame([(1, text, "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([], LABELS)
    got = as_dict(audit.interactions(documents, labels))
    assert len(got) == 600 and set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}
    assert audit.interactions(documents.limit(0), labels).collect() == []


def test_given_tables(spark):
    documents, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    want = brute([(r.doc_id, r.text, r.lang) for r in documents.collect()], list(map(tuple, labels.collect())))
    assert as_dict(audit.interactions(documents, labels)) == want
