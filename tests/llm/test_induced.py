"""Induced order against a plain sort of all suffixes."""

import numpy as np
import pytest

from casebook.llm import induced


def brute(text, depth):
    """Prefixes of ``depth`` symbols in order; the end of the text is smaller than any symbol."""
    t = text.tolist()
    return sorted(tuple(t[i : i + depth]) for i in range(len(t)))


def texts():
    rng = np.random.default_rng(3)
    yield np.array([0], np.uint8)
    yield np.array([0, 0], np.uint8)
    yield np.array([5, 0], np.uint8)
    yield np.array([1] * 300 + [0], np.uint8)
    yield np.array([2, 1] * 200 + [0], np.uint8)
    yield np.array([1, 2, 3, 3, 2, 1] * 60 + [0], np.uint8)
    for symbols in (2, 3, 5, 200):
        for _ in range(6):
            yield np.append(rng.integers(0, symbols, rng.integers(1, 700)), 0).astype(np.uint8)
    piece = rng.integers(1, 6, 80)
    parts = [np.append(piece[rng.integers(0, 20) : rng.integers(40, 80)], 0) for _ in range(30)]
    yield np.concatenate(parts).astype(np.uint8)


@pytest.mark.parametrize("depth", [1, 3, 10, 50])
def test_order_and_common_prefixes(depth):
    for text in texts():
        buckets = list(induced.ordered(text, depth))[::-1]
        at = np.concatenate([b[0] for b in buckets])
        assert sorted(at.tolist()) == list(range(len(text)))
        t = text.tolist()
        assert [tuple(t[i : i + depth]) for i in at] == brute(text, depth)
        for places, lcp in buckets:
            assert len(places) == len(lcp) and (not len(lcp) or lcp[0] == 0)
            for k in range(1, len(places)):
                x, y = t[places[k - 1] : places[k - 1] + depth], t[places[k] : places[k] + depth]
                n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
                assert lcp[k] == n, (places[k], lcp[k], n)


def test_recursion_without_doubling(monkeypatch):
    monkeypatch.setattr(induced, "_doubled", None)
    monkeypatch.setattr(induced, "RECURSION_SYMBOLS", 10**9)
    text = np.append(np.random.default_rng(1).integers(1, 4, 3000), 0).astype(np.uint8)
    at = np.concatenate([b[0] for b in induced.ordered(text, 50)][::-1])
    t = text.tolist()
    assert [tuple(t[i : i + 50]) for i in at] == brute(text, 50)


def test_queues_on_disk_and_small_batches(tmp_path, monkeypatch):
    """A budget of a few entries sends nearly all of them through files; the result is the same and no file stays."""
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(0, 4, 4000), 0).astype(np.uint8)
    want = [(a.tolist(), b.tolist()) for a, b in induced.ordered(text, 20)]
    monkeypatch.setattr(induced, "BATCH", 64)
    scratch = induced.Scratch(f"file://{tmp_path}/scratch")
    got = [(a.tolist(), b.tolist()) for a, b in induced.ordered(text, 20, scratch, most=2000)]
    assert got == want and scratch.written > 50
    scratch.close()
    assert not list(tmp_path.rglob("*"))


def test_wrong_text():
    with pytest.raises(ValueError, match="end in symbol 0"):
        list(induced.ordered(np.array([1], np.uint8), 5))
