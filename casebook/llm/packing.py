"""Documents packed into token sequences: best-fit decreasing by partition, certified by lower bounds, repacked by exchange.

Each partition packs its own pieces by best-fit decreasing. Dual-feasible functions give a lower bound for the number of
sequences. A partition that meets it is certified and gives only its least filled sequence into an exchange (its bound is
rounded up, and so can be beaten together with others); one with a gap gives all that are not full. Fewer partitions of new
neighbours pack these pieces again, until the bound over all open pieces is met or a round saves nothing.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import keyed_texts, slices, stored

SEQUENCE = 4096
END_ID = 1
GROUP_PIECES = 50_000
ROUNDS = 8
CACHED_CHUNKS = 700_000
CACHED_WORDS = 500_000
CACHED_CHARACTERS = 16_000_000
# White space as Unicode has it (what the tokenizer drops); Python's \s also holds U+001C to U+001F.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


_CHUNKS = re.compile(f"[^{_SPACE}]+").findall
# What the tokenizer does to a chunk of these characters (ASCII and the letters of Latin-1) is to lower its case, cut it into
# words and spell the words in its byte alphabet; other chunks go through the tokenizer as a whole.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def _byte_letters() -> dict[int, int]:
    """The byte alphabet: printable characters of Latin-1 stand for themselves, the other bytes for 256 upwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


class Chunks:
    """Ids of texts by their white-space chunks: white space is dropped and no token crosses it.

    Chunks and words met before are looked up, new words go to the tokenizer's model.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def cut(text: str) -> list[str]:
        return _CHUNKS(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelled)]
        self.words[word] = raw = struct.pack(f"<{len(ids)}i", *ids)
        return raw

    def _chunk(self, chunk: str) -> bytes:
        if not _SIMPLE(chunk):
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}i", *ids)
        lower = chunk.lower()
        words = self.words
        if lower.isalpha():
            return words.get(lower) or self._word(lower)
        return b"".join([words.get(w) or self._word(w) for w in _WORDS(lower)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        chunks = [self.cut(t) for t in texts]
        new = set(itertools.chain.from_iterable(chunks)).difference(self.known)
        if len(self.known) + len(new) > CACHED_CHUNKS:
            self.known, new = {}, set(itertools.chain.from_iterable(chunks))
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        self.known.update((c, self._chunk(c)) for c in new)
        find = self.known.__getitem__
        out = [b"".join(map(find, c)) for c in chunks]
        if sum(map(len, new)) > CACHED_CHARACTERS:  # a few very long chunks are not worth their memory
            self.known, self.words = {}, {}
        return out


def pieces(documents: DataFrame, definition: str | None = None, capacity: int = SEQUENCE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian 32-bit numbers, if wanted) of whole texts.

    A document is its token ids and the end id; one of more than ``capacity`` tokens is cut into full pieces and a rest. A
    null or empty text is the end id alone. Repeated rows give repeated pieces; a null doc_id stays null; other columns
    are left out. The tokenizer's definition (a few megabytes, whatever the corpus) is read on the driver and broadcast.
    """
    with open(definition or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        shipped = documents.sparkSession.sparkContext.broadcast({"definition": file.read()})
    end = struct.pack("<i", end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shipped.value  # a Python worker that serves several tasks keeps what it has met
        chunks = worker.get("chunks") or worker.setdefault("chunks", Chunks(worker["definition"]))
        for batch in slices(batches, "text"):
            rows = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), chunks(batch.column("text").to_pylist()), strict=True):
                raw += end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(own) // 4, zlib.crc32(own), *((own,) if ids else ())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return keyed_texts(documents).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int = SEQUENCE) -> int:
    """The best bound on the number of bins that two families of dual-feasible functions give (Fekete and Schepers).

    Such a function never maps lengths that fit into one bin to more than one bin, so the rounded-up sum of what it
    makes of all lengths is a bound.
    """
    bins = [-(-int((sizes * counts).sum()) // capacity)]
    # Lengths under a threshold vanish; those that leave less than the threshold fill their bin.
    for low in sizes[sizes <= capacity // 2]:
        value = np.where(sizes > capacity - low, capacity, np.where(sizes >= low, sizes, 0))
        bins.append(-(-int((value * counts).sum()) // capacity))
    # Rounding down to k-ths; a length that is a whole (k+1)-th keeps its share.
    for k in range(1, 33):
        shares = (k + 1) * sizes
        value = np.where(shares % capacity == 0, sizes * k, shares // capacity * capacity)
        bins.append(-(-int((value * counts).sum()) // (capacity * k)))
    return max(bins)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: longest first, each into the bin with the least room that takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, []  # bit r of rooms: some bin has room r
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_ = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = bin_, used[bin_]
        used[bin_] += n
        if room > n:
            by_room[room - n].append(bin_)
            rooms |= 1 << (room - n)
    return bins, offsets


def _packed(open_pieces: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """One round: pieces dealt to ``parts`` partitions by a hash that changes with the round, each packed for itself.

    Adds ``part, bin, offset, fill, bins, spare``; ``spare`` is not negative in the bins that a partition can give away.
    """
    columns = open_pieces.columns
    dealt = open_pieces.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "salt"), F.lit(parts)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        n, bound = len(fill), lower_bound(*np.unique(lengths, return_counts=True), capacity)
        for name, values in (("bin", bins), ("offset", offsets), ("fill", fill[bins]), ("bins", np.full(len(bins), n)), ("spare", np.where(n > bound, capacity, fill.min()) - fill[bins])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", bin long, offset long, fill long, bins long, spare long"
    return dealt.groupBy("part").applyInArrow(run, schema).select(*columns, "part", "bin", "offset", "fill", "bins", "spare")


def _total(packed: DataFrame) -> int:
    """Bins of a round."""
    row = packed.groupBy("part").agg(F.max("bins").alias("bins")).agg(F.sum("bins")).first()
    return int(row[0] or 0)


def _bound_of(rows: DataFrame, capacity: int) -> int:
    """The lower bound over all rows: of the count of each length, of which there are ``capacity`` at most."""
    counts = [(r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]
    sizes, n = (np.array(x, np.int64) for x in zip(*counts, strict=True)) if counts else (np.empty(0, np.int64),) * 2
    return lower_bound(sizes, n, capacity)


def pack(items: DataFrame, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``items`` (any columns, ``length`` from 1 to ``capacity`` among them) with ``sequence_id, offset``.

    Partitions hold about ``group_pieces`` pieces at any input size. Every round is written and reread. Repeated rows are
    pieces of their own; no rows give no rows. Lengths outside the range are an error.
    """
    rows = items.select(F.struct("*").alias("item"), F.col("length").cast("long").alias("length"))
    rows = stored(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id(), "length")), "pack-items")
    low, high, n = rows.agg(F.min("length"), F.max("length"), F.count(F.lit(1))).first()
    if n and not 1 <= low <= high <= capacity:
        raise ValueError(f"lengths run from {low} to {high}, outside 1 to {capacity}")
    closed: list[DataFrame] = []
    turn, current, before = 0, rows, None
    while True:
        parts = max(1, -(-n // group_pieces))
        result = stored(_packed(current, parts, turn, capacity), "pack-round")
        bins = _total(result)
        if before is not None and bins >= before[0]:
            result = before[1]  # nothing saved: the earlier packing of these pieces holds
            closed.append(result)
            break
        if parts == 1 or turn + 1 == rounds or bins <= _bound_of(current, capacity):
            closed.append(result)
            break
        opened = (F.col("spare") >= 0) & (F.col("fill") < capacity)
        rest = result.filter(opened)
        freed = rest.select("part", "bin").distinct().count()
        n = rest.count()
        if not n:
            closed.append(result)
            break
        closed.append(result.filter(~opened))
        current, before, turn = rest.select("item", "length", "salt"), (freed, rest), turn + 1
    out = None
    for i, done in enumerate(closed):
        ids = F.lit(i << 56) + F.shiftleft(F.col("part").cast("long"), 28) + F.col("bin")
        part = done.select("item", ids.alias("sequence_id"), "offset")
        out = part if out is None else out.unionByName(part)
    return out.select("item.*", "sequence_id", "offset")


def pack_documents(documents: DataFrame, capacity: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document."""
    return pack(pieces(documents, capacity=capacity, ids=ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed pieces (with their ``ids``) joined in order of offset; a sequence holds ``capacity`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids"))
