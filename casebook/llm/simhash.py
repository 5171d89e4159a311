"""Near duplicates by SimHash: fingerprints, links within three bits through a grid of segment bit counts, components.

A fingerprint is cut into 32 segments of two bits, and each segment is mapped to its bit count (0 to 2). The
Manhattan distance of two count vectors never exceeds the Hamming distance of the fingerprints. If that is 3 or less,
the counts of one half (16 segments) differ by 1 or less in total, so a range join on the grid of half vectors, radius 1, meets
every link: a fingerprint stands in its own cell of each half and asks there and one step up in each segment.
Candidates of a cell are verified by exact Hamming distance inside the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import drop_folder, give_back, keyed_texts, slices, stored, stored_path

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = 16  # in a half


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The majority of the shingles' XXH64 bits, as a signed 64-bit number; no words: zero.

    Words are runs of non-blank characters (blank: space, U+0009 to U+000D), A-Z in lower case.
    """
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle_words:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-shingle_words] + 1])
        cuts = zip(starts.tolist(), ends[shingle_words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, n - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, sums: bool = False) -> DataFrame:
    """``doc_id, fp`` (and ``sum``, the text's SHA-256, if wanted) of every row, whole texts (null: empty)."""
    names = ["doc_id", "fp"] + ["sum"] * sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            columns = [batch.column("doc_id"), pa.array([fingerprint(t, shingle_words) for t in texts], pa.int64())]
            if sums:
                columns.append(pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    return keyed_texts(documents).mapInArrow(run, "doc_id long, fp long" + ", sum binary" * sums)


def _counts(fp: Column, half: int) -> Column:
    """The 16 bit counts of a half, packed two bits each."""
    bits = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    return bits - F.shiftright(bits, 1).bitwiseAND(F.lit(0x55555555))


def _raised(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x + F.lit(by))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` (a < b): every pair of different fingerprints of ``fp`` that differ in ``max_bits`` (3 at most) bits or fewer.

    A pair one step apart in a segment is met from its lower side only; within a cell the smaller fingerprint asks. A pair
    can come twice, once for each half. Nulls take no part.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid of halves holds for 3 bits at most")
    own = fps.select("fp").filter("fp IS NOT NULL").distinct()

    def cells(asks: bool) -> DataFrame:
        halves = []
        for half in range(2):
            v = _counts(F.col("fp"), half)
            steps = [F.when(F.shiftright(v, 2 * j).bitwiseAND(F.lit(3)) < 2, v + F.lit(1 << 2 * j)) for j in range(SEGMENTS)]
            places = F.array_compact(F.array(v, *steps)) if asks else F.array(v)
            halves.append(_raised(places, half << 32))
        return own.select("fp", F.explode(F.concat(*halves)).alias("cell"))

    x, y = cells(True).alias("x"), cells(False).alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    # In its own cell a pair would meet twice; elsewhere the two cells differ, and so does the asking side.
    half = F.shiftright(F.col("x.cell"), 32)
    at_home = F.col("x.cell") == F.when(half == 0, _counts(a, 0)).otherwise(_counts(a, 1) + F.lit(1 << 32))
    near = F.bit_count(a.bitwiseXOR(b)) <= max_bits
    pairs = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (a != b) & (~at_home | (a < b)) & near)
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from each node of the edges ``a, b``, by alternating large and small stars.

    Every round is written and reread. Minima are combined before they move, and each join is between two plain
    shuffles, so the many edges of one centre are split by the adaptive skew join.
    """
    spark = edges.sparkSession
    current, path = stored_path(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = stored_path(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "edges-least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = stored_path(large, "edges-large")
        least2, least2_path = stored_path(large.groupBy("u").agg(F.min("v").alias("m")), "edges-least")
        joined = large.join(least2, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least2.select("u", F.col("m").alias("v")))
        following, following_path = stored_path(small.distinct(), "edges")
        for done in (path, least_path, large_path, least2_path):
            drop_folder(spark, done)
        current, path = following, following_path
        now = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.min("u"), F.max("v")).first())
        if now == mark:
            break
        mark = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(fps: DataFrame, first: Column, max_bits: int) -> DataFrame:
    """``fp, first, root``: each fingerprint once, the least ``first`` of its rows, and its component."""
    nodes = stored(fps.groupBy("fp").agg(F.min(first).alias("first")), "fingerprint-nodes")
    roots = components(stored(links(nodes, max_bits), "fingerprint-links"))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return stored(rooted, "fingerprint-roots")


def near_duplicates(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the fingerprint in 16 hex digits and the smallest doc_id that links reach.

    Equal fingerprints are one node, so copies cost nothing beyond their first. Texts without words (null and empty too)
    have fingerprint zero, which links like any other. Repeated rows each give a row. A null doc_id is never the
    smallest; a component of null doc_ids only has a null id. No rows give no rows; other columns are left out.
    """
    fps = stored(fingerprints(documents, shingle_words), "fingerprints")
    rooted = _rooted(fps, F.col("doc_id"), max_bits)
    ids = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "fingerprint-components")
    named = stored(rooted.join(ids, "root").select("fp", "component_id"), "fingerprint-ids")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, all columns, of which each component keeps one row: that of its smallest doc_id.

    A null doc_id comes after all others. Of different texts under one doc_id in one component, that of the smallest SHA-256
    stays; in different components each text stays. Of rows of equal doc_id and text any one stays (null: as empty).
    """
    fps = stored(fingerprints(documents, shingle_words, sums=True), "fingerprints")
    # A doc_id and a text belong to one component only, so together they name what it keeps.
    rooted = _rooted(fps, F.struct(F.col("doc_id").isNull(), "doc_id", "sum"), max_bits)
    kept = stored(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.sum"), "fingerprint-kept")
    rows = documents.select(F.struct("*").alias("doc"))
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    rows = rows.select("doc", F.col("doc.doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sum"))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["sum"] == kept["sum"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "sum"]).select("doc.*")
