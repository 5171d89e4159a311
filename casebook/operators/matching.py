"""Nearest-neighbour and shared-term joins that keep only the best k items per question.

Both deal questions and items into a grid: first by scope, so that only pairs in scope ever meet, then into blocks of
bounded size. Each pair of blocks is one task's work, scores are completed there, and k rows per question leave it. The
grid is columns of one plan, whatever the number of questions; nothing is collected while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.operators.windows import top_k

QUESTION_BLOCK = 16384
ITEM_BLOCK = 16384
# A block of questions is scored so many at a time; up to LEAST_BLOCKS blocks are no larger than that, so that few questions keep all cores busy.
QUESTIONS_AT_ONCE = 1024
LEAST_BLOCKS = 8
SCORES_PER_SLICE = 2_000_000
# Rows of results that may be sent to every task.
MAX_BROADCAST_RESULTS = 200_000


def small_side(results: DataFrame, questions: int, per_question: int) -> DataFrame:
    """Results to be joined to a large table: sent to every task when their number is bounded, else shuffled."""
    return F.broadcast(results) if questions * per_question <= MAX_BROADCAST_RESULTS else results


def _scopes(flag: str) -> Column:
    """The scopes of a question or an item: its library, its thread, and the reference libraries."""
    keys = (
        F.when(F.col("library").isNotNull(), F.concat(F.lit("library:"), F.col("library").cast("string"))),
        F.when(F.col("thread").isNotNull(), F.concat(F.lit("thread:"), F.col("thread").cast("string"))),
        F.when(F.col(flag), F.lit("reference")),
    )
    return F.explode(F.array_compact(F.array(*keys))).alias("_scope")


def _grid(questions: DataFrame, items: DataFrame, question: str, item: str, scoped: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with their place in the grid: scope, question block, item block.

    Sizes are counted per scope inside the plan; scopes that only one side has drop out. Without scopes there is one
    for all (cut from the key, so that it stays a column to join on), and its one row of sizes goes to every task.
    """
    everywhere = lambda key: F.left(F.col(key).cast("string"), F.lit(0)).alias("_scope")
    q = questions.select("*", _scopes("use_reference") if scoped else everywhere(question))
    i = items.select("*", _scopes("is_reference") if scoped else everywhere(item))
    n = F.count(F.lit(1))
    across = F.greatest(F.ceil(n / QUESTION_BLOCK), F.least(F.ceil(n / QUESTIONS_AT_ONCE), F.lit(LEAST_BLOCKS).cast("bigint")))
    sizes = q.groupBy("_scope").agg(across.alias("_across")).join(
        i.groupBy("_scope").agg(F.ceil(n / ITEM_BLOCK).alias("_down")), "_scope"
    )
    sizes = sizes if scoped else F.broadcast(sizes)

    def dealt(side: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        placed = side.join(sizes, "_scope").withColumn(own, F.pmod(F.xxhash64(F.col(key)), F.col(own_n)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n).cast("int") - 1))).drop("_across", "_down")

    return dealt(q, question, "_qb", "_across", "_ib", "_down"), dealt(i, item, "_ib", "_down", "_qb", "_across")


def _best(rows: np.ndarray, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score desc, place asc) entries per row index."""
    order = np.lexsort((places, -scores, rows))
    rows, places, scores = rows[order], places[order], scores[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    nth = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = nth < k
    return rows[keep], places[keep], scores[keep]


def _grid_top(
    questions: DataFrame, items: DataFrame, k: int, question: str, item: str, scoped: bool, order: Sequence[str], prepare, score, value: str
) -> DataFrame:
    """Top k items per question by ``value`` and then ``order`` (columns of the items).

    ``prepare(table)`` turns a block of questions into what scoring needs; ``score(payload, part)`` gives the question x
    item scores of a slice of a block of items, -inf where there is no match.
    """
    kinds = dict(items.dtypes) | {question: dict(questions.dtypes)[question], value: "double"}
    names = [question, *dict.fromkeys([item, *order]), value]
    scope_q, scope_i = (["library", "thread", "use_reference"], ["library", "thread", "is_reference"]) if scoped else ([], [])
    left, right = _grid(questions, items, question, item, scoped)
    left, right = left.drop(*scope_q), right.drop(*(c for c in scope_i if c not in order))

    def best_of(asked: pa.Table, held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        payload, step = prepare(asked), max(1, SCORES_PER_SLICE // len(asked))
        for start in range(0, len(held), step):
            found = score(payload, held.slice(start, step))
            n = found.shape[1]
            cut = np.partition(found, n - k, axis=1)[:, n - k] if n > k else np.full(len(asked), -np.inf)
            rows, cols = np.nonzero((found >= cut[:, None]) & (found > -np.inf))
            kept = _best(*[np.concatenate(p) for p in zip(kept, (rows, cols + start, found[rows, cols]), strict=True)], k)
        return kept

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asked) and len(held):
            # Items in the order that decides ties: a place then stands for the tie-break.
            held = held.take(pc.sort_indices(held, [(c, "ascending") for c in order], null_placement="at_start"))
            for start in range(0, len(asked), QUESTIONS_AT_ONCE):
                rows, places, scores = best_of(asked.slice(start, QUESTIONS_AT_ONCE), held)
                parts.append((rows + start, places, scores))
        kept = [np.concatenate(p) for p in zip(*parts, strict=True)]
        columns = [asked.column(question).take(pa.array(kept[0]))]
        columns += [held.column(c).take(pa.array(kept[1])) for c in names[1:-1]]
        return pa.table([*columns, pa.array(kept[2], pa.float64())], names)

    place = ["_scope", "_qb", "_ib"]
    cells = left.groupBy(*place).cogroup(right.groupBy(*place))
    found = cells.applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    if scoped:
        found = found.distinct()  # an item can be in scope twice, as its own library and as a reference
    return top_k(found, [question], [F.col(value).desc(), *[F.col(c) for c in order]], k)


def term_rows(items: DataFrame, item: str, tokens: Column, carry: list[str]) -> DataFrame:
    """(item, term, weight) rows; weight is the number of uses."""
    rows = items.select(item, *carry, F.explode(tokens).alias("term"))
    return rows.groupBy(item, *carry, "term").agg(F.count(F.lit(1)).alias("weight"))


def shared_terms(
    questions: DataFrame, items: DataFrame, k: int, scoped: bool = False, order: Sequence[str] = (), question: str = "question_id", item: str = "item_id"
) -> DataFrame:
    """Top k items per question by the weight of the terms they share, ties by ``order``, then the item.

    ``questions``: question, ``terms`` array, scope columns. ``items``: one row per (item, ``term``) with
    ``weight``, plus columns that depend on the item only. Only terms that some question asks for move on; a term that a
    third of all items hold adds one entry to each of them and no pair.
    """
    carried = [c for c in items.columns if c not in (item, "term", "weight")]
    asked = questions.filter(F.size("terms") > 0)
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    hits = items.join(wanted, "term", "left_semi")
    entries = F.collect_list(F.struct(F.col("term"), F.col("weight").cast("double").alias("weight")))
    held = hits.groupBy(item, *carried).agg(entries.alias("_entries"))
    held = held.select(item, *carried, F.col("_entries.term").alias("_terms"), F.col("_entries.weight").alias("_weights"))

    def prepare(table: pa.Table) -> tuple[pa.Array, list[np.ndarray], int]:
        terms = table.column("terms").combine_chunks()
        asker = np.repeat(np.arange(len(table)), terms.value_lengths().to_numpy())
        coded = terms.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        by_code = np.argsort(codes, kind="stable")
        return coded.dictionary, np.split(asker[by_code], np.searchsorted(codes[by_code], np.arange(1, len(coded.dictionary)))), len(table)

    def score(payload, part: pa.Table) -> np.ndarray:
        known, askers, n = payload
        found = np.zeros((n, len(part)))
        terms = part.column("_terms").combine_chunks()
        place = np.repeat(np.arange(len(part)), terms.value_lengths().to_numpy())
        code = pc.fill_null(pc.index_in(terms.flatten(), value_set=known), -1).to_numpy()
        weight = part.column("_weights").combine_chunks().flatten().to_numpy()
        by_code = np.argsort(code, kind="stable")
        by_code = by_code[code[by_code] >= 0]
        code, place, weight = code[by_code], place[by_code], weight[by_code]
        edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(code) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            found[np.ix_(askers[code[a]], place[a:b])] += weight[a:b]
        found[found == 0] = -np.inf
        return found

    names = [*order, item] if item not in order else list(order)
    best = _grid_top(asked, held, k, question, item, scoped, names, prepare, score, "score")
    return best.withColumn("score", F.col("score").cast("bigint"))


def best_by_words(
    questions: DataFrame, items: DataFrame, item: str, tokens: Column, k: int, scoped: bool = False,
    order: list[str] | None = None, question: str = "question_id",
) -> DataFrame:
    """Top k short labelled items per question by shared words; ties by ``order``, then the item.

    Items with the same words and the same scope columns score alike, and labels repeat a lot: one wording may
    hold a third of all rows. So each wording keeps its first k items, cut in the map tasks, and is scored once.
    The k best wordings by (score, first item) hold the k best items, because a wording behind k others starts
    after k better items.
    """
    carry, order = ["library", "thread", "is_reference"] if scoped else [], order or []
    keyed = items.select(item, *carry, *order, F.array_sort(F.array_distinct(tokens)).alias("_words")).filter(F.size("_words") > 0)
    kept = top_k(keyed, ["_words", *carry], [F.col(c) for c in (*order, item)], k, "_n")
    member = F.struct(*order, item)
    wordings = kept.groupBy("_words", *carry).agg(F.min(member).alias("_lead"), F.collect_list(member).alias("_members"))
    leads = [F.col(f"_lead.{c}").alias(f"_lead_{c}") for c in order]
    wordings = wordings.select("*", F.col(f"_lead.{item}").alias("item_id"), *leads)
    names = [f"_lead_{c}" for c in order]
    rows = wordings.select("item_id", *names, *carry, F.explode("_words").alias("term"), F.lit(1).alias("weight"))
    best = shared_terms(questions, rows, k, scoped, names, question)
    members = best.select(question, "item_id", "score").join(wordings.select("item_id", F.explode("_members").alias("_m")), "item_id")
    found = members.select(question, "score", "_m.*").distinct()
    return top_k(found, [question], [F.col("score").desc(), *[F.col(c) for c in (*order, item)]], k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        flat = np.frombuffer(b"".join(column.to_pylist()), "<f4").astype(np.float64)
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(
    questions: DataFrame, items: DataFrame, k: int, question: str = "question_id", item: str = "item_id", scoped: bool = True
) -> DataFrame:
    """Top k items per question by cosine, exact, scope applied before the cut.

    ``questions``: question, ``vector`` and, when scoped, ``library``, ``thread``, ``use_reference``.
    ``items``: item (bigint), ``vector`` and, when scoped, ``library``, ``thread``, ``is_reference``.
    Similarity is rounded to nine decimals so equal vectors tie exactly; ties go to the smaller item id. A vector is an array
    of numbers or the bytes of its 32-bit numbers.
    """

    def prepare(table: pa.Table) -> tuple[np.ndarray, np.ndarray | slice]:
        # dimensions that no question of the block uses add nothing to a product
        matrix = _unit(_matrix(table.column("vector")))
        used = matrix.any(axis=0)
        used = slice(None) if 2 * used.sum() > len(used) else np.flatnonzero(used)
        return matrix[:, used], used

    def score(payload, part: pa.Table) -> np.ndarray:
        matrix, used = payload
        found = matrix @ _unit(_matrix(part.column("vector")))[:, used].T
        return np.round(found, 9, out=found)

    scope_q, scope_i = (["library", "thread", "use_reference"], ["library", "thread", "is_reference"]) if scoped else ([], [])
    asked = questions.filter(F.col("vector").isNotNull()).select(question, "vector", *scope_q)
    held = items.filter(F.col("vector").isNotNull()).select(F.col(item).cast("bigint").alias(item), "vector", *scope_i)
    return _grid_top(
        asked, held, k, question, item, scoped, [item], prepare, score, "similarity"
    )
