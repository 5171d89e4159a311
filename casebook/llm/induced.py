"""Suffix order with common prefixes by external induced sorting.

A suffix is L if it is larger than the next one and S if smaller; an S behind an L is a seed. From the seeds in
order, one pass upwards over the symbols induces all L suffixes and one pass downwards all S suffixes: each suffix that is
taken from its symbol's queue puts the one before it into the queue of that one's symbol. Queue entries are tuples of position and
common prefix with the entry before. Seeds are put in order by the same two passes over unsorted seeds, which order the pieces
between seeds; the pieces are named, and the string of names is ordered by recursion.

Order and prefixes are right up to ``depth`` symbols, which is all that a search for repeats of that length needs.
Queues hold their entries in memory up to a budget; beyond it the entries that are needed last go to files of ``Scratch``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from casebook.llm.warc import store

BATCH = 1 << 20
QUEUE_BYTES = 16 << 20
RECURSION_SYMBOLS = 4096


class Scratch:
    """Runs of queue entries in files below a folder that the task's machine reaches; all are deleted at the end."""

    def __init__(self, folder: str):
        self.fs, path = store(folder)
        self.path, self.made, self.written = path, False, 0

    def put(self, rows: np.ndarray) -> str:
        if not self.made:
            self.fs.create_dir(self.path, recursive=True)
            self.made = True
        name = f"{self.path}/run-{self.written:06d}"
        self.written += 1
        with self.fs.open_output_stream(name) as out:
            out.write(rows.tobytes())
        return name

    def take(self, name: str) -> np.ndarray:
        with self.fs.open_input_stream(name) as file:
            raw = file.read()
        self.fs.delete_file(name)
        return np.frombuffer(raw, ENTRY)

    def close(self) -> None:
        if self.made:
            self.fs.delete_dir(self.path)


ENTRY = np.dtype([("at", np.int64), ("lcp", np.uint8)])


class Queues:
    """A first-in, first-out queue of entries for each symbol: together a priority queue by symbol.

    ``upwards`` says in which direction symbols will be taken; when the budget is spent, queues are written to disk
    from the far end.
    """

    def __init__(self, symbols: int, upwards: bool, scratch: Scratch | None, most: int):
        self.runs: list[list] = [[] for _ in range(symbols)]
        self.upwards, self.scratch, self.most, self.held = upwards, scratch, most, 0

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        rows = np.empty(len(at), ENTRY)
        rows["at"], rows["lcp"] = at, lcp
        self.runs[symbol].append(rows)
        self.held += rows.nbytes
        if self.held > self.most and self.scratch:
            self._spill()

    def _spill(self) -> None:
        order = range(len(self.runs) - 1, -1, -1) if self.upwards else range(len(self.runs))
        for symbol in order:
            memory = [r for r in self.runs[symbol] if not isinstance(r, str)]
            if memory:
                # Entries on disk are older than those in memory, so the order stays.
                on_disk = [r for r in self.runs[symbol] if isinstance(r, str)]
                rows = np.concatenate(memory)
                self.runs[symbol] = [*on_disk, self.scratch.put(rows)]
                self.held -= rows.nbytes
            if self.held <= self.most // 2:
                return

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """The entries so far, oldest first, in batches; what is pushed meanwhile waits for the next call."""
        runs, self.runs[symbol] = self.runs[symbol], []
        for run in runs:
            if isinstance(run, str):
                run = self.scratch.take(run)
            else:
                self.held -= run.nbytes
            for first in range(0, len(run), BATCH):
                yield run[first : first + BATCH]


def types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last symbol must be 0 and counts as the smallest suffix."""
    n = len(text)
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))  # the last place of each run of equal symbols
    rising = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    small = np.repeat(rising, np.diff(ends, prepend=-1))
    small[n - 1] = True
    return small


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, up to ``depth``."""
    out, open_ = np.zeros(len(a), np.uint8), np.arange(len(a))
    for k in range(depth):
        x, y = a[open_] + k, b[open_] + k
        inside = (x < len(text)) & (y < len(text))
        open_, x, y = open_[inside], x[inside], y[inside]
        same = text[x] == text[y]
        open_ = open_[same]
        if not len(open_):
            break
        out[open_] = k + 1
    return out


class _Induction:
    """One pass: scans entries in order and pushes those before them that have the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, depth: int, carry: bool):
        self.text, self.wanted, self.queues, self.depth, self.carry = text, wanted, queues, depth, carry
        # Smallest common prefix scanned since the last push, by symbol; a first push shares nothing.
        self.least = np.full(len(queues.runs), 255, np.uint8)
        self.empty = np.ones(len(queues.runs), bool)

    def scan(self, rows: np.ndarray) -> None:
        before = rows["at"] - 1
        hits = np.flatnonzero((before >= 0) & self.wanted[before])
        lcp = np.append(rows["lcp"], np.uint8(255))
        symbols = self.text[before[hits]]
        order = np.argsort(symbols, kind="stable")
        hits, symbols = hits[order], symbols[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        touched = []
        for group in np.split(np.arange(len(hits)), cuts) if len(hits) else ():
            symbol, places = int(symbols[group[0]]), hits[group]
            shared = np.zeros(len(places), np.uint8)
            if self.carry:
                least = np.minimum.reduceat(lcp, np.concatenate([[0], places + 1]))
                least[0] = min(least[0], self.least[symbol])
                shared = np.minimum(least[:-1], self.depth - 1).astype(np.uint8) + np.uint8(1)
                if self.empty[symbol]:
                    shared[0], self.empty[symbol] = 0, False
                touched.append((symbol, least[-1]))
            self.queues.push(symbol, before[places], shared)
        if self.carry and len(rows):
            np.minimum(self.least, lcp[:-1].min(), out=self.least)
            for symbol, least in touched:
                self.least[symbol] = least


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int, depth: int, carry: bool, scratch: Scratch | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes by first symbol, symbols downwards: positions in order, and common prefixes with the suffix before (0 for the first).

    ``seeds`` are in order among those of a symbol. ``small`` holds the types.
    """
    ups, kept = Queues(symbols, True, scratch, most), Queues(symbols, False, scratch, most)
    large = ~small
    up = _Induction(text, large, ups, depth, carry)

    def boundary(a: int, b: int) -> int:
        return int(common(text, np.array([a]), np.array([b]), depth)[0]) if carry else 0

    # The end of the text is the smallest suffix of all; nothing induces it, and it comes before all others of its symbol.
    end = np.array([(len(text) - 1, 0)], ENTRY)
    seeds = seeds[seeds != len(text) - 1]
    by_symbol = np.searchsorted(text[seeds], np.arange(symbols + 1))
    up.scan(end)
    for c in range(symbols):
        last = None if c else len(text) - 1
        while ups.runs[c]:
            for rows in ups.pop(c):
                if not c and last == len(text) - 1:
                    rows = rows.copy()
                    rows["lcp"][0] = boundary(last, int(rows["at"][0]))
                up.scan(rows)
                kept.push(c, rows["at"], rows["lcp"])
                last = int(rows["at"][-1])
        own = seeds[by_symbol[c] : by_symbol[c + 1]]
        for first in range(0, len(own), BATCH):
            part = own[first : first + BATCH]
            rows = np.empty(len(part), ENTRY)
            rows["at"], rows["lcp"] = part, 0
            if carry:
                ahead = own[first - 1] if first else last
                rows["lcp"][1:] = common(text, part[:-1], part[1:], depth)
                rows["lcp"][0] = 0 if ahead is None else boundary(ahead, part[0])
            up.scan(rows)
    downs = Queues(symbols, False, scratch, most)
    down = _Induction(text, small, downs, depth, carry)
    for c in range(symbols - 1, -1, -1):
        s_at, s_lcp = [], []
        while downs.runs[c]:
            for rows in downs.pop(c):
                down.scan(rows)
                s_at.append(rows["at"])
                s_lcp.append(rows["lcp"])
        l_rows = list(kept.pop(c))
        if c == 0:
            l_rows.insert(0, end)
        l_at = np.concatenate([r["at"] for r in l_rows]) if l_rows else np.empty(0, np.int64)
        l_lcp = np.concatenate([r["lcp"] for r in l_rows]) if l_rows else np.empty(0, np.uint8)
        s_down = np.concatenate(s_at) if s_at else np.empty(0, np.int64)
        d_down = np.concatenate(s_lcp) if s_lcp else np.empty(0, np.uint8)
        meet = boundary(int(l_at[-1]), int(s_down[-1])) if len(l_at) and len(s_down) else 0
        # Downwards an entry shares with the one above it what upwards the one above shares with it.
        for first in range(len(l_at), 0, -BATCH):
            part = slice(max(0, first - BATCH), first)
            rows = np.empty(part.stop - part.start, ENTRY)
            rows["at"] = l_at[part][::-1]
            rows["lcp"] = np.append(l_lcp[part.start + 1 : first], l_lcp[first] if first < len(l_at) else meet)[::-1]
            down.scan(rows)
        yield np.concatenate([l_at, s_down[::-1]]), np.concatenate([l_lcp, [np.uint8(meet)] * bool(len(s_down)), d_down[:0:-1]]).astype(np.uint8)


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string of names in order, by doubling: for alphabets too large to be queued by symbol."""
    rank, width = names.astype(np.int64), 1
    while width < depth:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-width] = rank[width:] + 1
        _, rank = np.unique(rank * (int(nxt.max()) + 1) + nxt, return_inverse=True)
        width *= 2
        if int(rank.max()) + 1 == len(rank):
            break
    return np.argsort(rank, kind="stable")


def _names(text: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names from 0 of seeds in order: equal for equal pieces (from a seed to the next one, inclusive)."""
    length = ends - order
    same = length[1:] == length[:-1]
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        open_ = open_[length[open_] >= k]
        equal = text[order[open_] + k] == text[order[open_ + 1] + k]
        same[open_[~equal]] = False
        open_ = open_[equal]
        k += 1
    return np.cumsum(np.append(False, ~same))


def sorted_seeds(text: np.ndarray, small: np.ndarray, symbols: int, depth: int, scratch: Scratch | None, most: int) -> np.ndarray:
    """The S suffixes behind an L suffix, in order."""
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(seeds) < 2:
        return seeds
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    start = seeds[np.argsort(text[seeds], kind="stable")]
    found = [at[is_seed[at]] for at, _ in induce(text, small, start, symbols, depth, False, scratch, most)]
    order = np.concatenate(found[::-1])
    following = np.append(seeds[1:], len(text) - 1)
    number = np.searchsorted(seeds, order)
    by_order = _names(text, order, following[number])
    if int(by_order[-1]) + 1 == len(seeds):
        return order
    names = np.empty(len(seeds), np.int64)
    names[number] = by_order
    count = int(by_order[-1]) + 1
    # The last seed is the end of the text, whose piece is the smallest and its own name, as the recursion needs.
    if count <= RECURSION_SYMBOLS:
        return seeds[_positions(names, count, depth, scratch, most)]
    return seeds[_doubled(names, depth)]


def _positions(text: np.ndarray, symbols: int, depth: int, scratch: Scratch | None, most: int) -> np.ndarray:
    small = types(text)
    seeds = sorted_seeds(text, small, symbols, depth, scratch, most)
    return np.concatenate([at for at, _ in induce(text, small, seeds, symbols, depth, False, scratch, most)][::-1])


def ordered(text: np.ndarray, depth: int, scratch: Scratch | None = None, most: int = QUEUE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` (numbers under 256, the last one 0) by first symbol, symbols downwards.

    For each symbol the positions upwards, ordered by their first ``depth`` symbols at least, and the common prefix of
    each with the one before, up to ``depth`` (at most 254).
    """
    if not len(text) or text[-1] != 0:
        raise ValueError("the text must end in symbol 0")
    if not 1 <= depth <= 254:
        raise ValueError("depth must be from 1 to 254")
    symbols = int(text.max()) + 1
    small = types(text)
    seeds = sorted_seeds(text, small, symbols, depth, scratch, most)
    yield from induce(text, small, seeds, symbols, depth, True, scratch, most)
