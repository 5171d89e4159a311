"""Branch and bound against a sort of all scores."""

import math
import random

from casebook.llm import topk
from tests.llm.helpers import clash

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in sorted(good):
        if i % every == 0:
            queries.setdefault(i, v)
    out = []
    for q, v in queries.items():
        sums = ((sum(a * b for a, b in zip(v, c, strict=False)), i) for i, c in good if i != q)
        scored = sorted((-min(max(s, -(1 << 63)), (1 << 63) - 1), i) for s, i in sums)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **options):
    frame = clash(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), "v", "across", "down", "rank", "score")
    return sorted(map(tuple, topk.top_k(frame, **options).collect()))


def vectors(n, d, seed=1):
    rng = random.Random(seed)
    return [[float(f"{rng.gauss(0, 1):.3f}") for _ in range(d)] for _ in range(n)]


def exact(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_blocks_ties_nulls_and_lengths(spark):
    rows = list(enumerate(vectors(260, 40)))
    rows += [(300 + i, rows[i][1]) for i in range(60)] + [(500 + i, [0.5] * 40) for i in range(60)]
    rows += [(700, None), (701, [1.0, None]), (702, [math.nan] * 40), (703, [math.inf] * 40), (None, [1.0] * 40), (800, []), (900, [3.0]), (100, rows[100][1]), (33, rows[33][1]), (-100, [-1.0] * 41)]
    rows = exact(rows)
    for options in ({}, {"query_block": 2, "candidate_block": 50}):
        assert run(spark, rows, **options) == brute(rows)


def test_few_candidates_and_no_rows(spark):
    rows = exact([(0, [1.0, 2.0]), (100, [0.25, -2.0]), (1, [-1.0, 0.0])])
    assert run(spark, rows, every=100) == brute(rows)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, [(None, None)]) == []


def test_large_components(spark):
    rows = exact([(0, [3e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [1e4, 1e9]), (100, [1e12, 1e12])])
    assert run(spark, rows) == brute(rows)


def test_pruning_keeps_the_best():
    import numpy as np

    rng = np.random.default_rng(0)
    c = np.floor(rng.normal(size=(64, 3000)) * rng.gamma(0.3, 300, size=(64, 1)))
    ids = rng.permutation(3000)
    got = topk.search(c[:, :20], ids[:20], c, ids, 10)
    for j in range(20):
        s = c[:, j] @ c
        want = [(int(ids[j]), int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s)) if i != j][:10]
        assert [g for g in got if g[0] == ids[j]] == want
