"""The written inverted index: results against brute force, blocks and buckets that are not read."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebook.plans import lexical, retrieval

WORDS = ["hot", "weld", "alpha", "beta", "gamma", "delta"] + [f"rare{i}" for i in range(40)]


def passages(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, [30, 10, 5, 5, 5, 5] + [1] * 40, k=rng.randint(0, 60)))
        rows.append((i, None if i == 7 else text, "hot" if i % 3 else f"lib{i % 5}", f"t{i % 4}" if i % 9 == 0 else None, i % 10 == 0))
    rows.append((n, rows[0][1], "hot", None, False))
    return rows, spark.createDataFrame(rows, "chunk_id bigint, content string, library string, thread string, is_reference boolean").repartition(5)


def brute(rows, asked, allowed, k):
    out = []
    for q, text, *scope in asked:
        terms = set(re.findall("[a-z0-9]+", text.lower()))
        scored = []
        for i, content, *own in rows:
            score = sum(n for w, n in Counter((content or "").split()).items() if w in terms)
            if score and allowed(scope, own):
                scored.append((-score, i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def got(frame):
    return sorted((r.question_id, r.chunk_id, r.score, r.rank) for r in frame.collect())


@pytest.mark.parametrize(("shard", "block", "buckets"), [(16384, 256, 32), (40, 4, 3), (7, 1, 1)])
def test_scoped_search_equals_brute_force(spark, tmp_path, shard, block, buckets):
    rows, frame = passages(spark)
    index = lexical.write_index(frame, str(tmp_path / "index"), shard_items=shard, block=block, buckets=buckets)
    asked = [(1, "hot weld alpha", "hot", None, False), (2, "rare1 rare2 rare3 gamma", "lib1", None, True), (3, "nowhere", "hot", None, True),
             (4, "delta", None, "t0", False), (5, "hot", "missing", None, False), (6, "beta rare9", "hot", "t2", True), (7, "", "hot", None, True)]
    questions = spark.createDataFrame(asked, "question_id int, text string, library string, thread string, use_reference boolean")

    def allowed(scope, own):
        return (own[0] == scope[0] and scope[0] is not None) or (own[1] == scope[1] and scope[1] is not None) or (own[2] and scope[2])

    assert got(retrieval.lexical_list(questions, frame, index, 40)) == brute(rows, asked, allowed, 40)
    assert got(retrieval.lexical_list(questions, frame, None, 40)) == brute(rows, asked, allowed, 40)
    with pytest.raises(ValueError, match="scoped"):
        retrieval.lexical_list(questions, frame, index, 40, scoped=False)


def test_no_passages_and_no_questions(spark, tmp_path):
    _, frame = passages(spark, 20)
    questions = spark.createDataFrame([(1, "hot")], "question_id int, text string")
    empty = lexical.write_index(frame.limit(0), str(tmp_path / "none"), scoped=False)
    assert retrieval.lexical_list(questions, frame, empty, 40, scoped=False).count() == 0
    index = lexical.write_index(frame, str(tmp_path / "some"), scoped=False)
    assert retrieval.lexical_list(questions.limit(0), frame, index, 40, scoped=False).count() == 0


def test_only_asked_buckets_are_opened(spark, tmp_path):
    _, frame = passages(spark)
    index = lexical.write_index(frame, str(tmp_path / "index"), scoped=False, buckets=16)
    questions = spark.createDataFrame([(1, "rare5")], "question_id int, text string")
    found = retrieval.lexical_list(questions, frame, index, 5, scoped=False)
    bucket = spark.range(1).select(lexical.bucket_of(F.lit("rare5"), 16)).first()[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {bucket}\)", plan)
    assert got(found) and len(list((tmp_path / "index" / "postings").glob("bucket=*"))) > 8


def test_blocks_that_cannot_matter_are_not_read():
    """A heavy word's long tail stays unread once the rare words' blocks have decided the first k."""
    rng = np.random.default_rng(0)
    n, k, block = 5000, 10, 16
    weights = {"heavy": rng.integers(1, 3, n), "rare": np.zeros(n, int)}
    weights["rare"][rng.choice(n, 40, replace=False)] = rng.integers(50, 90, 40)
    held = []
    for term, w in weights.items():
        order = np.lexsort((np.arange(n), -w))
        order = order[w[order] > 0]
        for a in range(0, len(order), block):
            part = order[a : a + block]
            held.append((term, int(w[part[0]]), part.tolist(), w[part].tolist()))
    lists = lexical._Lists(pd.DataFrame(held, columns=["term", "top", "items", "weights"]))
    items, scores, read = lists.best(["heavy", "rare", "absent"], k)
    total = weights["heavy"] + weights["rare"]
    want = np.lexsort((np.arange(n), -total))[:k]
    assert items.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert read < len(held) / 10
    # without a decisive word everything is read, and the result is still exact
    items, scores, _ = lists.best(["heavy"], k)
    assert items.tolist() == np.lexsort((np.arange(n), -weights["heavy"]))[:k].tolist()
