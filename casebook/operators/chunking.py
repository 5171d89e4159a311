"""Overlapping passages from blocks.

Packing is a fold along a document: a passage is a run of parts, and the start of the next run follows
from the start of this one alone. A document held in one row is packed where it lies. A document of many
block rows is packed by segments in parallel: each segment tells, for every part a run could enter it at,
where that run leaves it; chaining these small tables gives every segment its true entry. The passages are
the same as from one pass, and no task holds more than a segment.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import squash, token_count
from casebook.operators.windows import numbered

MAX_TOKENS = 420
OVERLAP = 60
SEGMENT_BLOCKS = 20_000
CHARS_OUT = 1 << 20  # passages leave a task in frames of some so many characters

CHUNKS = (
    "doc_id bigint, chunk_index int, content string, token_count int, page_start int, page_end int, section string"
)

_PIECE = re.compile(r"\w{1,6}|[^\w\s]")


def _tokens(text: str) -> int:
    return len(_PIECE.findall(text))


def _sums(counts: list[int]) -> list[int]:
    total, sums = 0, [0]
    for count in counts:
        total += count
        sums.append(total)
    return sums


def split_text(text: str, max_tokens: int, overlap: int) -> list[tuple[str, int]]:
    """(part, tokens) pieces of one block, each within ``max_tokens`` unless a single word is longer."""
    whole = _tokens(text)
    if whole <= max_tokens:
        return [(text, whole)]
    words = text.split()
    sums = _sums([_tokens(w) for w in words])
    wanted = min(max_tokens // 2, overlap)
    parts, start = [], 0
    while True:
        end = max(start + 1, bisect_right(sums, sums[start] + max_tokens) - 1)
        parts.append((" ".join(words[start:end]), sums[end] - sums[start]))
        if end >= len(words):
            return parts
        back = end
        while back > start and sums[end] - sums[back] < wanted:
            back -= 1
        start = max(start + 1, back)


def _run_end(sums: list[int], start: int, max_tokens: int) -> int:
    return max(start + 1, bisect_right(sums, sums[start] + max_tokens) - 1)


def _next_start(sums: list[int], start: int, end: int, max_tokens: int, overlap: int) -> int:
    """First part of the run after [start, end): a short tail is repeated, as far as the new part leaves room."""
    keep = end
    while overlap and keep > start and sums[end] - sums[keep] < overlap and sums[end] - sums[keep - 1] <= 2 * overlap:
        keep -= 1
    while keep < end and sums[end + 1] - sums[keep] > max_tokens:
        keep += 1
    return keep


def _passage(parts: list[tuple], start: int, end: int, sums: list[int]) -> tuple:
    run = parts[start:end]
    pages = [p[1] for p in run if p[1] is not None and p[1] == p[1]]
    sections = list(dict.fromkeys(p[2] for p in run if p[2]))
    return (
        "\n\n".join(p[0] for p in run),
        sums[end] - sums[start],
        int(min(pages)) if pages else None,
        int(max(pages)) if pages else None,
        " / ".join(sections),
    )


def _part_list(texts, pages, sections, max_tokens: int, overlap: int) -> tuple[list[tuple], list[int]]:
    parts, counts = [], []
    for text, page, section in zip(texts, pages, sections):
        clean = " ".join((text or "").split())
        if clean:
            for part, tokens in split_text(clean, max_tokens, overlap):
                parts.append((part, page, section))
                counts.append(tokens)
    return parts, _sums(counts)


def pack(texts, pages, sections, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple]:
    """The passages of one document's blocks."""
    parts, sums = _part_list(texts, pages, sections, max_tokens, overlap)
    out, start = [], 0
    while start < len(parts):
        end = _run_end(sums, start, max_tokens)
        out.append(_passage(parts, start, end, sums))
        if end >= len(parts):
            break
        start = _next_start(sums, start, end, max_tokens, overlap)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "chunk_index", "content", "token_count", "page_start", "page_end", "section"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def chunk_texts(documents: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Passages of plain-text documents, one document per row; nothing is shuffled.

    ``documents``: doc_id, text; an optional ``overlap`` column overrides the default (C5).
    """
    from casebook.sources.blocks import line_array

    own = F.col("overlap") if "overlap" in documents.columns else F.lit(overlap)
    rows = documents.select("doc_id", line_array(F.col("text")).alias("lines"), own.cast("int").alias("overlap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            # one document at a time is Python text; the others stay in the Arrow batch
            for doc, lines, own_overlap in zip(*batch.columns, strict=True):
                doc, lines = doc.as_py(), lines.as_py() or []
                blank = [None] * len(lines)
                for i, passage in enumerate(pack(lines, blank, blank, max_tokens, own_overlap.as_py())):
                    out.append((doc, i, *passage))
                    held += len(passage[0])
                    if held > CHARS_OUT:
                        yield _batch(out)
                        out, held = [], 0
            yield _batch(out)

    return rows.mapInArrow(run, CHUNKS)


def chunk_blocks(
    blocks: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, segment: int = SEGMENT_BLOCKS
) -> DataFrame:
    """Passages of block rows (doc_id, ord, text, page, section), any number of blocks per document."""
    halo = max_tokens + 1  # a block costs at least one token, so no run reaches further
    segment = max(segment, 2 * halo)
    filled = blocks.filter(squash(F.col("text")) != "").select("doc_id", "ord", "text", "page", "section")
    dense = numbered(filled, ["doc_id"], "ord", segment, "n").withColumn("seg", F.floor((F.col("n") - 1) / segment))
    into_previous = (F.col("seg") > 0) & ((F.col("n") - 1) % segment < halo)
    copies = F.when(into_previous, F.array(F.col("seg"), F.col("seg") - 1)).otherwise(F.array(F.col("seg")))
    spread = dense.withColumn("home", F.explode(copies)).select(
        "doc_id", F.col("home").alias("seg"), "n", "text", "page", "section"
    )
    sizes = dense.groupBy("doc_id").agg(F.max("n").alias("blocks"))
    spread = spread.join(sizes, "doc_id")

    def load(seg: int, rows: list[tuple]):
        """Parts of a segment with their (block, part) places, and where the segment itself ends."""
        limit = (seg + 1) * segment
        parts, places, counts = [], [], []
        for n, text, page, section, *_ in rows:
            for i, (part, tokens) in enumerate(split_text(" ".join(text.split()), max_tokens, overlap)):
                parts.append((part, page, section))
                places.append((n, i))
                counts.append(tokens)
        inside = bisect_right(places, (limit, 1 << 60))
        return parts, places, _sums(counts), inside, len(parts)

    def exits(doc: int, seg: int, rows: list[tuple]) -> Iterator[tuple]:
        _, places, sums, inside, total = load(seg, rows)
        first = seg * segment
        leave: dict[int, tuple[int, int]] = {}
        for start in range(inside - 1, -1, -1):
            end = _run_end(sums, start, max_tokens)
            after = _next_start(sums, start, end, max_tokens, overlap) if end < total else total
            leave[start] = (after, 1) if after >= inside else (leave[after][0], leave[after][1] + 1)
        for s, (a, passages) in leave.items():
            if places[s][0] <= first + halo:
                yield (doc, seg, *places[s], *(places[a] if a < total else (0, 0)), passages)

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        table = {
            (s, b, p): (ob, op, c)
            for s, b, p, ob, op, c in frame[["seg", "in_block", "in_part", "out_block", "out_part", "passages"]].itertuples(index=False)
        }
        place, index, rows = (1, 0), 0, []
        for seg in range(int(frame["seg"].max()) + 1):
            if place[0] == 0 or place[0] > (seg + 1) * segment:
                continue
            rows.append((frame["doc_id"].iloc[0], seg, place[0], place[1], index))
            out_block, out_part, passages = table[(seg, *place)]
            place, index = (out_block, out_part), index + passages
        return pd.DataFrame(rows, columns=["doc_id", "seg", "entry_block", "entry_part", "first_index"])

    place = "doc_id bigint, seg bigint, "
    passed = ["doc_id", "seg", "in_block", "in_part", "out_block", "out_part", "passages"]
    halves = ["n", "text", "page", "section"]
    long = spread.filter(F.col("blocks") > segment).select("doc_id", "seg", *halves)
    entries = (
        _segments(long)
        .mapInArrow(_by_segment(exits, lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], passed), lambda row: 64),
                    place + "in_block bigint, in_part bigint, out_block bigint, out_part bigint, passages bigint")
        .groupBy("doc_id")
        .applyInPandas(chain, place + "entry_block bigint, entry_part bigint, first_index bigint")
    )
    short = F.col("blocks") <= segment
    entered = spread.join(entries, ["doc_id", "seg"], "left").withColumn(
        "entry_block", F.when(short, F.lit(1)).otherwise(F.col("entry_block"))
    ).fillna({"entry_part": 0, "first_index": 0}).filter("entry_block IS NOT NULL")

    def emit(doc: int, seg: int, rows: list[tuple]) -> Iterator[tuple]:
        parts, places, sums, inside, total = load(seg, rows)
        *_, entry_block, entry_part, index = rows[0]
        start = places.index((entry_block, entry_part))
        while start < inside:
            end = _run_end(sums, start, max_tokens)
            yield (doc, index, *_passage(parts, start, end, sums))
            index += 1
            if end >= total:
                break
            start = _next_start(sums, start, end, max_tokens, overlap)

    rows = _segments(entered.select("doc_id", "seg", *halves, "entry_block", "entry_part", "first_index"))
    return rows.mapInArrow(_by_segment(emit, _batch, lambda row: len(row[2])), CHUNKS)


def _segments(rows: DataFrame) -> DataFrame:
    """The rows of a segment side by side and in order; a task reads its segments one after the other.

    They are dealt by a hash of their own: a deal by the columns themselves Spark leaves out behind a join on them, whose
    tasks it may then split.
    """
    return rows.repartition(F.xxhash64("doc_id", "seg")).sortWithinPartitions("doc_id", "seg", "n")


def _by_segment(step, packed, size):
    """``step(doc, seg, rows)`` for each run of rows of one segment; what it yields leaves in batches of some ``CHARS_OUT``.

    Segments are many and may be small, so they are told apart within the batches instead of being handed over one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, place, rows = [], 0, None, []

        def finished():
            return step(*place, rows) if rows else ()

        for batch in batches:
            # a slice of the batch at a time is Python text
            for start in range(0, len(batch), 1024):
                for doc, seg, *row in zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns), strict=True):
                    if (doc, seg) != place:
                        for found in finished():
                            out.append(found)
                            held += size(found)
                            if held > CHARS_OUT:
                                yield packed(out)
                                out, held = [], 0
                        place, rows = (doc, seg), []
                    rows.append(tuple(row))
        for found in finished():
            out.append(found)
            held += size(found)
            if held > CHARS_OUT:
                yield packed(out)
                out, held = [], 0
        if out:
            yield packed(out)

    return run


def chunk_id(doc: str = "doc_id", index: str = "chunk_index"):
    """A stable id that a re-run reproduces."""
    return F.xxhash64(F.col(doc), F.col(index))


def provenance(members: DataFrame) -> DataFrame:
    """Pages, ordered distinct sections, joined text and tokens of given passages (C4).

    ``members``: chunk_id, ord, text, page, section.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "section", "text")))
    grouped = members.groupBy("chunk_id").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), ordered.alias("_rows")
    )
    sections = F.filter(F.array_distinct(F.transform("_rows", lambda r: r["section"])), lambda s: s != "")
    content = F.array_join(F.transform("_rows", lambda r: r["text"]), "\n\n")
    return grouped.select(
        "chunk_id", "page_start", "page_end", F.array_join(sections, " / ").alias("section"),
        content.alias("content"), token_count(content).alias("token_count"),
    )
