"""Passages that repeat across documents, byte by byte, by suffix sorting of bounded shards.

A document's windows (all its byte strings of ``length``) are dealt by content: each goes with its anchor, the 20 bytes inside it
of least hash, so equal windows meet wherever they stand. Consecutive windows with one anchor are a fragment.

1. Documents are written in slices of a few megabytes, which later steps read by name.
2. Each slice sends its distinct fragments (hashes and smallest doc_id only) to the shard of their anchor. There, equal fragments
   find their first document; an anchor with several different fragments leaves these open.
3. Open fragments travel as bytes, in two halves (windows that reach far to the left or to the right of the anchor), each
   dealt by 35 bytes that all its windows share. Halves of one such key go through external induced sorting
   (``induced``); runs of suffixes with a common prefix of ``length`` are equal windows, and all but those of the
   smallest doc_id are marked. A key with more than ``sort_bytes`` of halves is not sorted: its windows are dealt one by one.
4. Each slice collects what was found for its fragments and takes the covered bytes out.

A common passage counts once for each slice before it moves, and is compared as a fragment, not as pairs of documents. A short
common string inside many different passages sends a mark of each slice to its shard, and its fragments by their own hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from casebook.llm import induced
from casebook.llm.common import give_back, shared_folder, slices, stored
from casebook.llm.warc import store

LENGTH = 50
GRAM = 20
SLICE_BYTES = 4 << 20
SHARD_BYTES = 8 << 20  # of text whose fragments meet in one shard
SORT_BYTES = 4 << 20
HOT = 4  # fragments of one anchor in a slice from which on they do not all go to the anchor's shard
PART_BYTES = 1 << 19  # of a slice worked on at once
LAST = np.iinfo(np.int64).max
MARK = np.uint64(0)

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_PLACE = np.uint64((1 << 31) - 1)


def _words(data: bytes) -> np.ndarray:
    """Eight bytes from every place on."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def _hash(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start on, ``size`` of them."""
    out = size.astype(np.uint64) * _C
    for at in range(0, int(size.max()) if len(size) else 0, 8):
        left = size - at
        open_ = np.flatnonzero(left > 0)
        value = words[start[open_] + at]
        bits = (np.uint64(8) * np.minimum(left[open_], 8).astype(np.uint64)) & np.uint64(63)
        value = np.where(bits == 0, value, value & ((np.uint64(1) << bits) - np.uint64(1)))
        mixed = (out[open_] ^ value) * _A
        out[open_] = (mixed ^ (mixed >> np.uint64(29))) * _B
    return out ^ (out >> np.uint64(32))


def _gram(first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings of ``GRAM`` bytes, by their first eight, eight from the ninth on, and last eight."""
    grams = (first * _A) ^ ((last * _B) >> np.uint64(3))
    grams ^= middle * _C
    grams *= _A
    grams ^= grams >> np.uint64(32)
    grams *= _B
    return grams


class Fragments:
    """The fragments of some texts: ``doc`` (place in the list), ``start`` and ``size`` in ``data``, ``anchor`` place, ``gram`` and ``hash``.

    Finding the anchors is most of the work. ``cuts`` states them in two bytes a fragment, from which they are built again.
    """

    def __init__(self, texts: list[bytes], length: int, cuts: np.ndarray | None = None):
        self.data = b"\xff".join(texts) + b"\xff" * (2 * length + 16)  # no UTF-8 text has byte 255
        self.words = _words(self.data)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        if cuts is None:
            parts = [self._part(low, length) for low in range(0, int(self.ends[-1]) + 1, PART_BYTES)]
            self.doc, self.start, self.size, self.anchor, self.gram = (np.concatenate(p) for p in zip(*parts, strict=True))
        else:
            self._rebuilt(cuts, sizes, length)
        self.hash = _hash(self.words, self.start, self.size)

    def cuts(self, length: int) -> np.ndarray:
        """A row for each fragment: how many windows it has, and how far behind its start its anchor lies."""
        return np.stack([self.size - length + 1, self.anchor - self.start], axis=1).astype(np.uint8)

    def _rebuilt(self, cuts: np.ndarray, sizes: np.ndarray, length: int) -> None:
        """Fragments divide the windows of the texts, one text after the other, without a gap."""
        windows = cuts[:, 0].astype(np.int64)
        before, held = np.cumsum(windows) - windows, np.maximum(sizes - length + 1, 0)
        through = np.cumsum(held)
        self.doc = np.searchsorted(through, before, side="right")
        self.start = before - (through - held)[self.doc] + (self.ends - sizes)[self.doc]
        self.size = windows + length - 1
        self.anchor = self.start + cuts[:, 1]
        self.gram = _gram(*(self.words[self.anchor + at] for at in (0, 8, GRAM - 8)))

    def _part(self, low: int, length: int) -> tuple[np.ndarray, ...]:
        high, reach = min(int(self.ends[-1]) + 1, low + PART_BYTES), length - GRAM + 1
        m = high - low + reach
        grams = _gram(*(self.words[low + at : low + m + at] for at in (0, 8, GRAM - 8)))
        # Hash first, place second: the least of a window is its leftmost gram of least hash.
        least, width = (grams & ~_PLACE) | np.arange(m, dtype=np.uint64), 1
        while width * 2 <= reach:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        if width < reach:
            least = np.minimum(least[: -(reach - width)], least[reach - width :])
        place = (least[: high - low] & _PLACE).astype(np.int64)
        first, last = np.searchsorted(self.ends, [low, high - 1])
        doc = np.repeat(np.arange(first, last + 1), np.diff(np.clip(self.ends[first : last + 1] + 1, low, high), prepend=low))
        starts = np.arange(low, high)
        inside = starts + length <= self.ends[doc]
        place, doc, starts = place[inside], doc[inside], starts[inside]
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))[: len(starts)])
        last = np.append(new[1:], len(starts))[: len(new)] - 1
        return doc[new], starts[new], starts[last] - starts[new] + length, place[new] + low, grams[place[new]]


def _table(name: str) -> pa.Table:
    fs, path = store(name)
    with fs.open_input_file(path) as file:
        return pa.ipc.open_file(file).read_all()


def _put_table(name: str, batch: pa.RecordBatch) -> None:
    fs, path = store(name)
    with fs.open_output_stream(path) as out, pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
        file.write_batch(batch)


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Whole texts as bytes (null: empty) and doc_ids (null: larger than all others)."""
    texts = [b"" if t is None else t for t in table.column("text").cast(pa.binary()).to_pylist()]
    return texts, table.column("doc_id").fill_null(LAST).to_numpy()


def _fragments(name: str, length: int, new: bool = False) -> tuple[pa.Table, Fragments, np.ndarray, np.ndarray]:
    """A slice, its fragments, their doc_ids, and the smallest doc_id of each fragment's copies in the slice.

    When ``new``, the fragments are found and their cuts written beside the slice, where later steps read them. A repeated task
    writes the same bytes again.
    """
    table = _table(name)
    texts, ids = _texts(table)
    if new:
        found = Fragments(texts, length)
        cuts = found.cuts(length)
        _put_table(f"{name}.cuts", pa.RecordBatch.from_arrays([pa.array(c) for c in cuts.T], ["windows", "anchor"]))
    else:
        cuts = _table(f"{name}.cuts")
        found = Fragments(texts, length, np.stack([cuts.column(c).to_numpy() for c in ("windows", "anchor")], axis=1))
    docs = ids[found.doc]
    order = np.lexsort((docs, found.hash))
    new = np.append(True, found.hash[order][1:] != found.hash[order][:-1])[: len(order)]
    least = np.empty(len(docs), np.int64)
    least[order] = docs[order][new][np.cumsum(new) - 1]
    return table, found, docs, least


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    parts = [c for c in table.column(column).chunks if len(c)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in parts])
    return values, np.repeat(np.arange(len(table)), np.concatenate([c.value_lengths().fill_null(0).to_numpy() for c in parts]))


def _grouped(keys: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """List columns with one row for each run of equal (sorted) keys."""
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)) if len(keys) else np.empty(0, np.int64)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _first(keys: np.ndarray) -> np.ndarray:
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def written(documents: DataFrame) -> DataFrame:
    """Write all rows, with all columns, in slices; ``slice, bytes`` of each. Names belong to one attempt of a task."""
    spark = documents.sparkSession
    folder = shared_folder(spark, "slices")
    rows = documents.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        for part in slices(batches, "text", SLICE_BYTES):
            name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
            _put_table(f"{folder}/{name}", part)
            # not the buffers behind the part, which are those of the whole batch it was cut from
            yield pa.RecordBatch.from_pydict({"slice": [f"{folder}/{name}"], "bytes": pa.array([part.nbytes], pa.int64())})

    return stored(rows.mapInArrow(run, "slice string, bytes long"), "slice-names")


def _hot(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries belong to an anchor with more than ``HOT`` of them, and the place of one entry of each such anchor."""
    _, place, which, sizes = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
    return (sizes > HOT)[which], place[sizes > HOT]


def sent(names: DataFrame, shards: int, length: int) -> DataFrame:
    """``shard, slice, gram, hash, doc``: each distinct fragment of a slice with its smallest doc_id there, in the shard of its anchor.

    An anchor that many fragments of a slice share is open whatever other slices hold. Its fragments only have to meet their
    equals, so they are spread by their own hash (shards from ``shards`` on), and a mark tells the anchor's shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("slice").to_pylist():
                _, found, docs, least = _fragments(name, length, new=True)
                mine = np.flatnonzero(docs == least)
                mine = mine[np.unique(found.hash[mine], return_index=True)[1]]
                mixed = (found.gram[mine] ^ (found.gram[mine] >> np.uint64(31))) * _C
                shard = ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)
                hot, marks = _hot(found.gram[mine])
                # A hot anchor's fragments go by their own hash to a second set of shards. Its own shard gets a mark instead, so
                # that whatever comes there from other slices is open.
                hashes = found.hash[mine]
                spread = (hashes ^ (hashes >> np.uint64(31))) * _C
                second = ((spread >> np.uint64(33)) % np.uint64(shards)).astype(np.int32) + shards
                mixed = np.concatenate([np.where(hot, spread, mixed), mixed[marks]])
                shard = np.concatenate([np.where(hot, second, shard), shard[marks]])
                hashes = np.concatenate([hashes, np.full(len(marks), MARK)])
                first = np.concatenate([docs[mine], np.full(len(marks), LAST)])
                order = np.lexsort((first, shard))
                shard, mixed, hashes, first = shard[order], mixed[order], hashes[order], first[order]
                keys = _first(shard)
                columns = _grouped(shard, mixed.astype(np.uint32).view(np.int32), hashes.view(np.int64), first)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([name] * len(keys), pa.string()), *columns], ["shard", "slice", "gram", "hash", "doc"])
                give_back()

    return names.select("slice").mapInArrow(run, "shard int, slice string, gram array<int>, hash array<long>, doc array<long>")


def _decide(table: pa.Table, shards: int) -> pa.Table:
    """For each slice the fragments that it must hear of: their first document, and whether they are open.

    In the shards of hot anchors all are: equal fragments of slices in which the anchor is not hot are met when sorting.
    """
    hot = len(table) > 0 and table.column("shard")[0].as_py() >= shards
    names = table.column("slice").to_pylist()
    gram, row = _lists(table, "gram")
    (hash_, _), (doc, _) = _lists(table, "hash"), _lists(table, "doc")
    order = np.lexsort((doc, hash_, gram))
    gram, hash_, doc, row = gram[order], hash_[order], doc[order], row[order]
    new_gram = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
    new = new_gram | np.append(True, hash_[1:] != hash_[:-1])[: len(gram)]
    fragment, anchor = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
    first = doc[new]
    owner = anchor[new]  # of each fragment
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    low, high = (f.reduceat(first, starts) for f in (np.minimum, np.maximum)) if len(starts) else (first, first)
    several = np.diff(np.append(starts, len(owner))) > 1
    marked = np.logical_or.reduceat(hash_[new] == MARK.astype(np.int64), starts) if len(starts) else several
    open_ = (several & (low != high) | marked | hot)[owner]
    tell = np.flatnonzero((doc > first[fragment]) | open_[fragment])
    tell = tell[np.argsort(row[tell], kind="stable")]
    opened = open_[fragment[tell]] & (doc[tell] == first[fragment[tell]])
    columns = _grouped(row[tell], hash_[tell], first[fragment[tell]], opened)
    return pa.table([pa.array([names[r] for r in _first(row[tell])], pa.string()), *columns], ["slice", "hash", "first", "open"])


_HALVES = ["shard", "slice", "key", "hash", "doc", "first", "size", "body"]
_HALVES_SCHEMA = "shard int, slice string, key array<long>, hash array<long>, doc array<long>, first array<tinyint>, size array<tinyint>, body binary"


def _halves(found: Fragments, chosen: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The halves of fragments: index in ``chosen``, key, first window (counted in the fragment), start, size."""
    context = (length - GRAM) // 2
    start, anchor = found.start[chosen], found.anchor[chosen]
    last = start + found.size[chosen] - length  # where the last window starts
    size = np.full(len(chosen), GRAM + context, np.int64)
    out = []
    # A window that starts ``context`` bytes or more before the anchor holds that much on its left; any other as much on the right.
    for low, high, at, side in ((start, np.minimum(last, anchor - context), anchor - context, 0), (np.maximum(start, anchor - context + 1), last, anchor, 1)):
        there = np.flatnonzero(low <= high)
        key = _hash(found.words, at[there], size[there]) ^ np.uint64(side)
        out.append((there, key, low[there] - start[there], low[there], high[there] - low[there] + length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def opened(decided: DataFrame, shards: int, length: int, many: int = 0) -> DataFrame:
    """``shard, slice, key, hash, doc, first, size, body, heavy, heavy_bytes``: the open fragments' halves with their bytes, one after the other.

    ``heavy`` are the keys whose halves hold more than ``many`` bytes in the slice.
    """
    wanted = decided.select("slice", F.expr("transform(filter(arrays_zip(hash, open), x -> x.open), x -> x.hash)").alias("hash")).filter("size(hash) > 0")

    def run(table: pa.Table) -> pa.Table:
        name = table.column("slice")[0].as_py()
        _, found, docs, least = _fragments(name, length)
        ask = np.unique(_lists(table, "hash")[0])
        mine = np.flatnonzero(np.isin(found.hash.view(np.int64), ask) & (docs == least))
        mine = mine[np.unique(found.hash[mine], return_index=True)[1]]
        which, key, window, start, size = _halves(found, mine, length)
        shard = ((key >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        which, key, window, start, size, shard = (x[order] for x in (which, key, window, start, size, shard))
        parts = [found.data[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        keys = _first(shard)
        cuts = np.append(np.searchsorted(shard, keys), len(shard)).tolist()
        bodies = [b"".join(parts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        del parts
        give_back()
        columns = _grouped(shard, key.view(np.int64), found.hash[mine[which]].view(np.int64), docs[mine[which]], window.astype(np.int8), size.astype(np.uint8).view(np.int8))
        known, place, of = np.unique(key, return_index=True, return_inverse=True)
        held = np.bincount(of, weights=size, minlength=len(known)).astype(np.int64)
        heavy = np.flatnonzero(held > many)
        heavy = heavy[np.argsort(shard[place[heavy]], kind="stable")]
        cuts = np.append(np.searchsorted(shard[place[heavy]], keys), len(heavy)).astype(np.int32)
        reports = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(c)) for c in (known[heavy].view(np.int64), held[heavy])]
        return pa.table([pa.array(keys), pa.array([name] * len(keys), pa.string()), *columns, pa.array(bodies, pa.binary()), *reports], [*_HALVES, "heavy", "heavy_bytes"])

    schema = f"{_HALVES_SCHEMA}, heavy array<long>, heavy_bytes array<long>"
    return wanted.groupBy("slice").applyInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes, dict[str, np.ndarray]]]:
    """Each row of halves: shard, slice, body, and its lists as arrays, with the place ``at`` of each half in the body."""
    for batch in batches:
        for i in range(len(batch)):
            row = pa.Table.from_batches([batch.slice(i, 1)])
            lists = {c: _lists(row, c)[0] for c in _HALVES[2:7]}
            lists["size"] = lists["size"].view(np.uint8).astype(np.int64)
            lists["at"] = np.cumsum(lists["size"]) - lists["size"]
            yield row.column("shard")[0].as_py(), row.column("slice")[0].as_py(), row.column("body")[0].as_py(), lists


def hot_keys(halves: DataFrame, many: int) -> np.ndarray:
    """Keys of which the slices report more than ``many`` bytes together: one for each ``many`` bytes of all halves at most."""
    told = halves.select(F.explode(F.arrays_zip("heavy", "heavy_bytes")).alias("x")).groupBy("x.heavy").agg(F.sum("x.heavy_bytes").alias("n"))
    return np.array([r[0] for r in told.filter(F.col("n") > many).select("heavy").collect()], np.int64)


def _without(hot: np.ndarray):
    """Halves without those of hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, name, body, x in _rows(batches):
            left = np.flatnonzero(~np.isin(x["key"], hot))
            if not len(left):
                continue
            if len(left) < len(x["key"]):
                body = b"".join([body[a : a + n] for a, n in zip(x["at"][left].tolist(), x["size"][left].tolist(), strict=True)])
            lists = (x["key"][left], x["hash"][left], x["doc"][left], x["first"][left], x["size"][left].astype(np.uint8).view(np.int8))
            columns = _grouped(np.zeros(len(left), np.int8), *lists)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name], pa.string()), *columns, pa.array([body], pa.binary())], _HALVES)

    return run


def _single_windows(hot: np.ndarray, length: int):
    """Each different window in a slice's halves of hot keys: its smallest doc_id there, and all the fragments that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, name, body, x in _rows(batches):
            mine = np.flatnonzero(np.isin(x["key"], hot))
            mine = mine[np.argsort(x["key"][mine], kind="stable")]
            # Equal windows have one key, so keys may be taken one by one, and few windows are in memory at once.
            for part in np.split(mine, np.flatnonzero(np.diff(x["key"][mine])) + 1) if len(mine) else ():
                count = x["size"][part] - length + 1
                half = np.repeat(part, count)
                nth = np.arange(len(half)) - np.repeat(np.cumsum(count) - count, count)
                data = np.frombuffer(body, np.uint8)
                strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[x["at"][half] + nth]).view(f"V{length}").ravel()
                known, of = np.unique(strings, return_inverse=True)
                order = np.lexsort((x["doc"][half], of))
                half, nth, of = half[order], nth[order], of[order]
                new = np.append(True, of[1:] != of[:-1])
                columns = _grouped(of, x["hash"][half], x["doc"][half], (x["first"][half] + nth).astype(np.int8))
                windows = pa.array([k.tobytes() for k in known], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(known), pa.string()), windows, pa.array(x["doc"][half][new]), *columns], ["slice", "window", "least", "hash", "doc", "first"])
        give_back()

    return run


def repeated_by_window(halves: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """``slice, hash, first, mask`` for the halves of hot keys, whose windows meet one by one, byte by byte.

    The smallest doc_id of a window is combined before it moves, and the join back is between two plain shuffles, which the
    adaptive skew join can split: no task holds all that shares a key, or a window.
    """
    windows = stored(halves.mapInArrow(_single_windows(hot, length), "slice string, window binary, least long, hash array<long>, doc array<long>, first array<tinyint>"), "hot-windows")
    first = stored(windows.groupBy("window").agg(F.min("least").alias("smallest")), "hot-windows-first")
    held = windows.join(first, "window").select("slice", "smallest", F.explode(F.arrays_zip("hash", "doc", "first")).alias("x")).filter("x.doc > smallest")
    masks = held.groupBy("slice", "x.hash").agg(F.bit_or(F.expr("shiftleft(1L, x.first)")).alias("mask"))
    lists = masks.groupBy("slice").agg(F.collect_list(F.struct("hash", "mask")).alias("x"))
    return stored(lists.select("slice", "x.hash", F.transform("x", lambda _: F.lit(LAST)).alias("first"), "x.mask"), "hot-windows-found")


def repeated_windows(parts: list[bytes], docs: np.ndarray, length: int, scratch: induced.Scratch | None, most: int = induced.QUEUE_BYTES) -> list[np.ndarray]:
    """For each part the starts of windows that also stand in a part of a smaller doc_id, by suffix order of all parts."""
    # Bytes of UTF-8 end at 244: one up, and 0 between the parts.
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    ends = np.cumsum(sizes) - 1
    part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    marks = np.zeros(len(text), bool)
    for at, lcp in induced.ordered(text, length, scratch, most):
        starts = np.flatnonzero(lcp < length)
        if len(starts) == len(at):
            continue
        owner = part[at]
        whole = at + length <= ends[owner]
        doc = np.where(whole, docs[owner], LAST)
        runs = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(at))))
        marks[at[whole & (doc > runs)]] = True
    hits = np.flatnonzero(marks)
    owner = part[hits]
    return np.split(hits - (ends - sizes + 1)[owner], np.searchsorted(owner, np.arange(1, len(parts))))


def _sorted_shard(length: int, folder: str, sort_bytes: int, queue_bytes: int):
    def run(table: pa.Table) -> pa.Table:
        names, bodies = table.column("slice").to_pylist(), table.column("body").to_pylist()
        key, row = _lists(table, "key")
        (hash_, _), (doc, _), (window, _), (size, _) = (_lists(table, c) for c in ("hash", "doc", "first", "size"))
        window, size = window.astype(np.int64), size.view(np.uint8).astype(np.int64)
        before = np.cumsum(size) - size
        row_start = np.cumsum([0, *map(len, bodies)])
        order = np.lexsort((doc, key))
        ends = np.append(np.flatnonzero(key[order][1:] != key[order][:-1]) + 1, len(order)).tolist()
        masks = np.zeros(len(key), np.uint64)
        scratch = induced.Scratch(f"{folder}/{uuid.uuid4().hex}")

        def sort(chosen: np.ndarray) -> None:
            parts = [bodies[r][a - row_start[r] : a - row_start[r] + n] for r, a, n in zip(row[chosen].tolist(), before[chosen].tolist(), size[chosen].tolist(), strict=True)]
            for i, starts in zip(chosen.tolist(), repeated_windows(parts, doc[chosen], length, scratch, queue_bytes), strict=True):
                if len(starts):
                    masks[i] = np.bitwise_or.reduce(np.uint64(1) << (starts + window[i]).astype(np.uint64))

        try:
            group, held, start = [], 0, 0
            for end in ends:  # keys are independent of each other, so whole ones are sorted together up to a size
                mine, start = order[start:end], end
                if len(mine) < 2 or doc[mine[0]] == doc[mine[-1]]:
                    continue
                group.append(mine)
                held += int(size[mine].sum())
                if held > sort_bytes:
                    sort(np.concatenate(group))
                    group, held = [], 0
            if group:
                sort(np.concatenate(group))
        finally:
            scratch.close()
            give_back()
        hit = np.flatnonzero(masks)
        hit = hit[np.argsort(row[hit], kind="stable")]
        columns = _grouped(row[hit], hash_[hit], np.full(len(hit), LAST), masks[hit].view(np.int64))
        return pa.table([pa.array([names[r] for r in _first(row[hit])], pa.string()), *columns], ["slice", "hash", "first", "mask"])

    return run


def _taken_out(kind: pa.StructType, length: int):
    """A slice's rows without the bytes that were found to repeat."""

    def run(names: pa.Table, news: pa.Table) -> pa.Table:
        table, found, docs, least = _fragments(names.column("slice")[0].as_py(), length)
        (hash_, _), (first, _), (mask, _) = (_lists(news, c) for c in ("hash", "first", "mask"))
        order = np.argsort(hash_, kind="stable")
        starts = np.flatnonzero(np.append(True, hash_[order][1:] != hash_[order][:-1])[: len(order)])
        mine = found.hash.view(np.int64)
        masks = np.zeros(len(mine), np.uint64)
        if len(order):
            known = hash_[order][starts]
            where = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            told = known[where] == mine
            least = np.where(told, np.minimum(least, np.minimum.reduceat(first[order], starts)[where]), least)
            masks = np.where(told, np.bitwise_or.reduceat(mask[order].view(np.uint64), starts)[where], masks)
        whole = docs > least
        step = np.zeros(len(found.data) + 1, np.int32)
        np.add.at(step, found.start[whole], 1)
        np.add.at(step, found.start[whole] + found.size[whole], -1)
        some = np.flatnonzero(~whole & (masks != 0))
        for k in range(length - GRAM + 1):
            at = found.start[some[(masks[some] >> np.uint64(k)) & np.uint64(1) == 1]] + k
            np.add.at(step, at, 1)
            np.add.at(step, at + length, -1)
        gone = np.cumsum(step[:-1]) > 0
        data = np.frombuffer(found.data, np.uint8)
        kept, removed, spans = [], [], []
        for end, size in zip(found.ends.tolist(), np.diff(found.ends, prepend=-1).tolist(), strict=True):
            own = slice(end - size + 1, end)
            out = gone[own]
            removed.append(int(out.sum()))
            spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
            kept.append(data[own][~out].tobytes() if removed[-1] else found.data[own])
        texts = [None if t is None else t if not n else k.decode(errors="ignore") for t, n, k in zip(table.column("text").to_pylist(), removed, kept, strict=True)]
        columns = [pa.array(texts, pa.string()) if f.name == "text" else table.column(f.name).combine_chunks() for f in kind]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        sizes = np.diff(found.ends, prepend=-1) - 1
        del step, gone, data
        give_back()
        row = pa.StructArray.from_arrays(columns, fields=list(kind))
        return pa.table([row, pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, sort_bytes: int = SORT_BYTES, queue_bytes: int = induced.QUEUE_BYTES) -> DataFrame:
    """``doc, n_bytes, n_removed, n_spans, kept``: each row without the bytes covered by a string of ``length`` bytes that also
    starts in a document of smaller doc_id.

    Texts are whole, as UTF-8 bytes (null: empty); strings never cross documents, may overlap, and are judged on the input.
    ``kept`` holds the remaining bytes, ``n_spans`` counts maximal removed runs. ``doc`` is a struct of all columns
    in which ``text`` is what is left; a character that was cut in two is dropped from it (not from ``kept``), a null text
    stays null. Rows of equal doc_id do not remove each other's bytes; a null doc_id counts as larger than all others. No
    rows give no rows. ``length`` may be 24 to 79. Further columns ride inside the struct.
    """
    if not 24 <= length <= 79:
        raise ValueError("length must be from 24 to 79")
    names = written(documents)
    n_slices, n_bytes = names.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks, shards = max(1, -(-n_slices // 4)), max(1, -(-(n_bytes or 0) // shard_bytes))
    names = names.repartition(tasks, "slice")
    decide = "slice string, hash array<long>, first array<long>, open array<boolean>"
    decided = stored(
        sent(names, shards, length).repartitionById(2 * shards, F.col("shard")).groupBy("shard").applyInArrow(lambda t: _decide(t, shards), decide), "fragments-decided"
    )
    n_open = decided.agg(F.sum(F.expr("size(filter(open, x -> x))"))).first()[0] or 0
    sorts = max(1, -(-n_open * 2 * length // (4 * sort_bytes)))
    folder = shared_folder(documents.sparkSession, "queues")
    sort = _sorted_shard(length, folder, sort_bytes, queue_bytes)
    # A key that no slice reports holds half of sort_bytes at most, and what goes unreported of any other is no more than that.
    halves = stored(opened(decided.repartition(tasks, "slice"), sorts, length, sort_bytes // (2 * max(1, n_slices))), "fragments-open")
    hot = hot_keys(halves, sort_bytes // 2)
    cold = halves.select(*_HALVES)
    if len(hot):
        cold = cold.mapInArrow(_without(hot), _HALVES_SCHEMA)
    found = stored(
        cold.repartitionById(sorts, F.col("shard"))  # a task for each shard; by hash some would get several and others none
        .groupBy("shard")
        .applyInArrow(sort, "slice string, hash array<long>, first array<long>, mask array<long>"),
        "fragments-found",
    )
    if len(hot):
        found = found.unionByName(repeated_by_window(halves.select(*_HALVES), hot, length))
    news = decided.select("slice", "hash", "first", F.transform("hash", lambda x: F.lit(0).cast("long")).alias("mask")).unionByName(found)
    schema = documents.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).schema
    kind = pa.struct([f.with_nullable(True) for f in to_arrow_schema(schema)])
    out = names.groupBy("slice").cogroup(news.repartition(tasks, "slice").groupBy("slice"))
    return out.applyInArrow(_taken_out(kind, length), f"doc {schema.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    rows = remove_repeats(documents.select("doc_id", "text"), length)
    return rows.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
