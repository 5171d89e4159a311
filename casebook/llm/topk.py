"""Exact top-k by integer inner product, branch and bound over dimension blocks.

Vectors lie column by column (dimension first). A query's partial scores grow one block of dimensions at a
time; what the remaining dimensions can still add or take is bounded by the product of the remaining lengths
(Cauchy-Schwarz). A candidate whose best case is below the k-th best worst case is gone, and the survivors are
compacted before the next block is touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
DIMENSIONS = 16  # in a block
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096
QUERIES_AT_ONCE = 256
EXACT = 1 << 53
LONG = 1 << 63


def quantised(vectors: list) -> np.ndarray:
    """floor(SCALE * x) of each component, dimension first; shorter vectors are filled up with zeros.

    Numbers are float64 that hold integers, or Python integers when they are too large for that.
    """
    width = max(map(len, vectors), default=0)
    x = np.zeros((len(vectors), width))
    for row, v in zip(x, vectors, strict=True):
        row[: len(v)] = v
    x = np.floor(x * float(SCALE)).T
    if x.size and max(x.max(), -x.min()) >= EXACT:
        return np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)
    return np.ascontiguousarray(x)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """``(query id, candidate id, score)`` of each query's k best candidates with other ids; matrices are dimension first."""
    width = max(len(queries), len(candidates))
    queries = np.pad(queries, ((0, width - len(queries)), (0, 0)))
    candidates = np.pad(candidates, ((0, width - len(candidates)), (0, 0)))
    large = max((float(abs(m).max()) for m in (queries, candidates) if m.size), default=0.0)
    if object in (queries.dtype, candidates.dtype) or large * large * max(1, width) >= EXACT:
        return _plain(queries, query_ids, candidates, ids, k)
    # Dimensions in which queries are large come first: they leave the smallest rest.
    order = np.argsort(-np.square(queries).sum(axis=1), kind="stable")
    queries, candidates = queries[order], np.ascontiguousarray(candidates[order])
    starts = list(range(0, width, DIMENSIONS)) or [0]

    def rests(m: np.ndarray) -> list[np.ndarray]:
        squares = np.square(m)
        return [np.sqrt(squares[s + DIMENSIONS :].sum(axis=0)) for s in starts]

    query_rest, candidate_rest = rests(queries), rests(candidates)
    out = []
    for first in range(0, queries.shape[1], QUERIES_AT_ONCE):
        some = queries[:, first : first + QUERIES_AT_ONCE]
        opening = some[:DIMENSIONS].T @ candidates[:DIMENSIONS]
        for q in range(some.shape[1]):
            alive = np.flatnonzero(ids != query_ids[first + q])
            scores = opening[q][alive]
            for i, s in enumerate(starts):
                if i:
                    scores = scores + some[s : s + DIMENSIONS, q] @ candidates[s : s + DIMENSIONS, alive]
                if i + 1 < len(starts) and len(alive) > k:
                    # One more than the product, so that rounding never removes a candidate.
                    rest = query_rest[i][first + q] * candidate_rest[i][alive] * (1 + 1e-9) + 1
                    worst = scores - rest
                    floor = np.partition(worst, len(worst) - k)[len(worst) - k]
                    stay = scores + rest >= floor
                    alive, scores = alive[stay], scores[stay]
            for j in best(scores, ids[alive], k):
                out.append((int(query_ids[first + q]), int(ids[alive[j]]), int(scores[j])))
    return out


def _plain(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Whole-number arithmetic for components whose products float64 cannot hold; scores end at the limits of a long, where they tie."""
    queries, candidates = ([[int(c) for c in v] for v in m.T] for m in (queries, candidates))
    out = []
    for q, qid in zip(queries, query_ids.tolist(), strict=True):
        sums = ((sum(a * b for a, b in zip(q, c, strict=True)), i) for c, i in zip(candidates, ids.tolist(), strict=True) if i != qid)
        scored = sorted((-min(max(s, -LONG), LONG - 1), i) for s, i in sums)
        out += [(qid, i, -s) for s, i in scored[:k]]
    return out


def top_k(vectors: DataFrame, every: int = 100, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vec_id divisible by ``every`` the k best other rows of ``vec_id, embedding``.

    Queries and candidates are dealt into blocks whose sizes stay the same as tables grow, each pair of blocks is searched by
    one task, and the k best of each pair meet in a top-k by query. Vectors that are null, hold a null or a
    number that is not finite, or have no vec_id take no part; vectors of other lengths count as filled up with zeros.
    A vec_id that is repeated is one query (its smallest vector) but a candidate for each row. Other columns are left out.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        "vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    queries = good.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_candidates, n_queries = good.count(), queries.count()
    across, down = max(1, -(-n_queries // query_block)), max(1, -(-n_candidates // candidate_block))

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int").alias("across"), numbers(down).alias("down"))
    right = good.select("vec_id", "v", numbers(across).alias("across"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(down)).cast("int").alias("down"))

    def pair(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        q, c = (quantised([np.asarray(v.values) for v in t.column("v").combine_chunks()] if len(t) else []) for t in (mine, theirs))
        qids, cids = (t.column("vec_id").to_numpy() for t in (mine, theirs))
        found = search(q, qids, c, cids, k) if len(qids) and len(cids) else []
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    halves = left.groupBy("across", "down").cogroup(right.groupBy("across", "down"))
    found = halves.applyInArrow(pair, "query_id long, vec_id long, score long")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
