"""A written inverted index with block maxima, and the search that reads it best blocks first.

Passages are dealt to shards of bounded size, by scope and then by a hash of their id, so a word that a third of them hold is cut
into as many lists as there are shards. A shard's list of a word is cut into blocks by falling weight; a block is one row, with
its highest weight beside it. Rows are stored by bucket of the word: a search opens the buckets of the words that are asked for.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.operators.windows import top_k

SHARD_ITEMS = 4096
ROWS = 512
BLOCK = 256
BUCKETS = 32
QUESTIONS = 1024
EVERYWHERE = "everywhere"
POSTINGS = "scope string, part int, bucket int, term string, block int, top int, items array<bigint>, weights array<int>"


def scopes(flag: str) -> Column:
    """The scopes of a question or a passage: its library, its thread, and the reference libraries."""
    keys = (
        F.when(F.col("library").isNotNull(), F.concat(F.lit("library:"), F.col("library").cast("string"))),
        F.when(F.col("thread").isNotNull(), F.concat(F.lit("thread:"), F.col("thread").cast("string"))),
        F.when(F.col(flag), F.lit("reference")),
    )
    return F.array_compact(F.array(*keys))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class LexicalIndex:
    """A written index: ``postings`` by bucket, and ``shards`` with the number of parts of each scope."""

    folder: str
    buckets: int
    scoped: bool

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings")

    def shards(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("scope string, parts int").parquet(f"{self.folder}/shards")


def _counted(rows: DataFrame) -> DataFrame:
    """``scope, part, item, terms, weights``: the words of each passage with their number of uses, counted row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, ROWS) for b in batches for start in range(0, len(b), ROWS)):
            words = pc.split_pattern_regex(batch.column("lowered"), pattern="[^a-z0-9]+")
            coded = words.flatten().dictionary_encode()
            known = coded.dictionary
            owner = np.repeat(np.arange(len(batch)), words.value_lengths().to_numpy())
            # a row and a word as one number; what stands before a first or behind a last mark is an empty word
            pairs, uses = np.unique(owner * max(1, len(known)) + coded.indices.to_numpy(), return_counts=True)
            owner, code = np.divmod(pairs, max(1, len(known)))
            real = (pc.binary_length(known).to_numpy() > 0)[code]
            owner, code, uses = owner[real], code[real], uses[real]
            ends = pa.array(np.searchsorted(owner, np.arange(len(batch) + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(ends, known.take(pa.array(code)))
            weights = pa.ListArray.from_arrays(ends, pa.array(uses, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("scopes", "item")), terms, weights], ["scopes", "item", "terms", "weights"])

    return rows.mapInArrow(run, "scopes array<string>, item bigint, terms array<string>, weights array<int>")


def _inverted(buckets: int, block: int):
    """All blocks of one shard."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        terms, weights = (table.column(c).combine_chunks() for c in ("terms", "weights"))
        item = np.repeat(table.column("item").to_numpy(), terms.value_lengths().to_numpy())
        weight = weights.flatten().to_numpy()
        coded = terms.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.lexsort((item, -weight, code))
        item, weight, code = item[order], weight[order], code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        nth = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        starts = np.flatnonzero(nth % block == 0)
        ends = pa.array(np.append(starts, len(code)).astype(np.int32))
        words = coded.dictionary.take(pa.array(code[starts]))
        place = np.array([0] * len(coded.dictionary), np.int32)
        for i, w in enumerate(coded.dictionary.to_pylist()):
            place[i] = zlib.crc32(w.encode()) % buckets
        columns = [
            pa.array([table.column("scope")[0].as_py()] * len(starts), pa.string()), pa.array(np.full(len(starts), table.column("part")[0].as_py()), pa.int32()),
            pa.array(place[code[starts]]), words, pa.array((nth[starts] // block).astype(np.int32)), pa.array(weight[starts]),
            pa.ListArray.from_arrays(ends, pa.array(item)), pa.ListArray.from_arrays(ends, pa.array(weight)),
        ]
        return pa.table(columns, ["scope", "part", "bucket", "term", "block", "top", "items", "weights"])

    return run


def write_index(
    passages: DataFrame, folder: str, scoped: bool = True, item: str = "chunk_id", text: str = "content", buckets: int = BUCKETS,
    shard_items: int = SHARD_ITEMS, block: int = BLOCK,
) -> LexicalIndex:
    """Write the index of all passages below ``folder`` (which must be new).

    ``passages``: item, text and, when scoped, ``library, thread, is_reference``. A passage is listed in each of its scopes.
    Null texts hold no word. A shard holds some ``shard_items`` passages, dealt by a hash of their ids, so no task holds the
    whole list of a word.
    """
    own = scopes("is_reference") if scoped else F.array(F.lit(EVERYWHERE))
    rows = passages.select(own.alias("scopes"), F.col(item).cast("bigint").alias("item"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("lowered"))
    sizes = rows.select(F.explode("scopes").alias("scope")).groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / shard_items).cast("int").alias("parts"))
    sizes.write.parquet(f"{folder}/shards")
    index = LexicalIndex(folder, buckets, scoped)
    placed = _counted(rows).withColumn("scope", F.explode("scopes")).join(index.shards(passages.sparkSession), "scope")
    placed = placed.select("scope", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int").alias("part"), "item", "terms", "weights")
    blocks = placed.groupBy("scope", "part").applyInArrow(_inverted(buckets, block), POSTINGS)
    # one file for each bucket and thousand shards, sorted by word, so that row groups can be skipped
    dealt = blocks.repartition(F.col("bucket"), F.floor(F.col("part") / 1000)).sortWithinPartitions("bucket", "term", "scope", "part", "block")
    dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
    return index


class _Lists:
    """The blocks of one shard by word, with local places instead of ids."""

    def __init__(self, held: pd.DataFrame):
        flat = [np.asarray(x, np.int64) for x in held["items"]]
        self.items = np.unique(np.concatenate(flat)) if flat else np.empty(0, np.int64)
        self.blocks: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for term, top, ids, weights in zip(held["term"], held["top"], flat, held["weights"], strict=True):
            self.blocks.setdefault(term, []).append((int(top), np.searchsorted(self.items, ids), np.asarray(weights, np.int64)))
        for blocks in self.blocks.values():
            blocks.sort(key=lambda b: -b[0])

    def best(self, terms: list[str], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best passages of the shard (ties to the smaller id), and how many blocks were read.

        The block with the highest maximum is read next. What is unread of a list can add its next block's maximum at most, so
        once k passages have more than all lists can still add together, no unseen passage enters, and of the seen ones
        only those that may still reach the k-th are looked up in what is left.
        """
        lists = [self.blocks[t] for t in terms if t in self.blocks]
        score = np.zeros(len(self.items), np.int64)
        queue = [(-blocks[0][0], i, 0) for i, blocks in enumerate(lists)]
        heapq.heapify(queue)
        left, read = sum(blocks[0][0] for blocks in lists), 0
        while queue:
            top, i, n = heapq.heappop(queue)
            _, places, weights = lists[i][n]
            score[places] += weights
            read += 1
            following = lists[i][n + 1][0] if n + 1 < len(lists[i]) else 0
            left += top + following
            if following:
                heapq.heappush(queue, (-following, i, n + 1))
            # A bound is worth taking only if it can hold: the highest scores so far lie above what is left.
            if queue and len(score) > k and read % 8 == 0:
                kth = np.partition(score, len(score) - k)[len(score) - k]
                if kth > left:
                    alive = score + left >= kth
                    for _, j, m in queue:
                        for _, places, weights in lists[j][m:]:
                            hit = alive[places]
                            score[places[hit]] += weights[hit]
                    score[~alive] = 0
                    break
        found = np.flatnonzero(score)
        order = found[np.lexsort((found, -score[found]))][:k]
        return self.items[order], score[order], read


def _cell(k: int, question: str):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, ids, scores = [], [], []
        if len(asked) and len(held):
            lists = _Lists(held.select(["term", "top", "items", "weights"]).to_pandas())
            for terms in asked.column("terms").to_pylist():
                found, score, _ = lists.best(terms, k)
                ids.append(found)
                scores.append(score)
            names = np.repeat(np.arange(len(asked)), [len(x) for x in ids])
        return pa.table(
            [asked.column(question).take(pa.array(names, pa.int64())), pa.array(np.concatenate([*ids, np.empty(0, np.int64)])), pa.array(np.concatenate([*scores, np.empty(0, np.int64)]))],
            [question, "item_id", "score"],
        )

    return run


def search(questions: DataFrame, index: LexicalIndex, k: int, question: str = "question_id") -> DataFrame:
    """Top k passages of each question by uses of its ``terms`` (ties to the smaller id): ``question, item_id, score, rank``.

    ``questions``: question, ``terms`` and, for a scoped index, ``library, thread, use_reference``. A question meets the shards
    of its scopes only; a shard's blocks of the asked words go to one task for each ``QUESTIONS`` questions. k rows for
    each question leave a shard.
    """
    spark = questions.sparkSession
    own = scopes("use_reference") if index.scoped else F.array(F.lit(EVERYWHERE))
    asked = questions.filter(F.size("terms") > 0).select(question, "terms", F.explode(own).alias("scope"))
    n = F.count(F.lit(1))
    grid = asked.groupBy("scope").agg(F.ceil(n / QUESTIONS).cast("int").alias("across")).join(index.shards(spark), "scope")
    asked = asked.join(grid, "scope").withColumn("across", F.pmod(F.xxhash64(question), F.col("across")).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    wanted = questions.select(F.explode("terms").alias("term")).distinct()
    # At most as many numbers as the index has buckets: they prune its folders.
    buckets = [r[0] for r in wanted.select(bucket_of(F.col("term"), index.buckets)).distinct().collect()]
    held = index.postings(spark).filter(F.col("bucket").isin(buckets)).drop("bucket").join(wanted, "term", "left_semi")
    held = held.join(grid, "scope").withColumn("across", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    place = ["scope", "part", "across"]
    kind = dict(questions.dtypes)[question]
    found = asked.groupBy(*place).cogroup(held.drop("parts", "block").groupBy(*place)).applyInArrow(_cell(k, question), f"`{question}` {kind}, item_id bigint, score bigint")
    # a passage can be in scope twice, as its own library's and as a reference
    found = found.distinct() if index.scoped else found
    return top_k(found, [question], [F.col("score").desc(), F.col("item_id")], k)
