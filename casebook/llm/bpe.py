"""Byte-level BPE through sentencepiece: a model serialised from a rank file, encoding by pre-token, exact decoding.

The rank file lists byte strings in merge order. Every byte is written as one letter (``chr(256 + byte)``), so
each token becomes a piece of plain letters; its score is the negative rank and normalisation is the identity. The library's
best-score-first merge is then the lowest-rank-first merge of byte-level BPE, ties to the left.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.llm.common import keyed_texts, slices

# White space as the pattern's \s has it; Python's own \s also holds U+001C to U+001F.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CACHED_SEGMENTS = 400_000
CACHED_CHARACTERS = 16_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line. Its size is that of the vocabulary, not of the corpus."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _letters(value: bytes) -> str:
    return "".join(chr(256 + b) for b in value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the vocabulary: piece i is the token of rank i, the unknown piece comes last."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without a gap")
    if not {bytes([b]) for b in range(256)} <= ranks.keys():
        raise ValueError("every single byte must be a token")
    normal, unknown, bpe = 1, 2, 2
    pieces = [(_letters(t), -float(i), normal) for i, t in enumerate(tokens)] + [("<unk>", 0.0, unknown)]
    out = [_bytes(1, _bytes(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _number(3, kind)) for p, s, kind in pieces]
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _bytes(2, trainer) + _bytes(3, normalizer)


class Encoder:
    """Encodes slices of texts. Segments met before are looked up; new ones go to sentencepiece together."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import re

        import regex
        import sentencepiece

        self.words = regex.compile(pattern).findall
        self.single = {token: struct.pack("<i", rank) for token, rank in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Tokens never run from a visible character into white space, so a text may be cut there first.
        self.cut = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
        self.known: dict[str, bytes] = {}

    def _learn(self, segments: set[str]) -> None:
        """Find the ids of new segments, as bytes: the words of all of them go to sentencepiece in one call."""
        new = [s for s in segments if s not in self.known]
        if len(self.known) + len(new) > CACHED_SEGMENTS:
            self.known, new = {}, list(segments)
        # One optional space and letters only: the pattern takes such a segment whole.
        plain = [s for s in new if s.isalpha() or (s[0] == " " and s[1:].isalpha())]
        if plain:
            self.known.update(zip(plain, self._words("\n".join(plain).encode().split(b"\n")), strict=True))
        mixed = [s for s in new if s not in self.known]
        parts = [[w.encode() for w in self.words(s)] for s in mixed]
        ids = iter(self._words([w for words in parts for w in words]))
        self.known.update((s, b"".join(itertools.islice(ids, len(words)))) for s, words in zip(mixed, parts, strict=True))

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        out = [self.single.get(w) for w in words]
        rest = [i for i, ids in enumerate(out) if ids is None]
        if rest:
            # No UTF-8 text has byte 255, so it parts the words while all bytes become letters at once.
            raw = np.frombuffer(b"\xff".join([words[i] for i in rest]), np.uint8)
            letters = (raw.astype("<u2") + 256).tobytes().decode("utf-16-le").split(chr(256 + 255))
            found = self.model.encode(letters, num_threads=1)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) * 4
            flat = np.fromiter(itertools.chain.from_iterable(found), "<i4", int(ends[-1]) // 4).tobytes()
            for i, a, b in zip(rest, [0, *ends.tolist()], ends.tolist(), strict=False):
                out[i] = flat[a:b]
        return out

    def __call__(self, texts: list[str]) -> tuple[bytes, list[int]]:
        """The ids of all texts as little-endian 32-bit numbers, and where each text's ids end (from 0)."""
        segments = [self.cut(t) for t in texts]
        self._learn(set(itertools.chain.from_iterable(segments)))
        find = self.known.__getitem__
        parts = [b"".join(map(find, s)) for s in segments]
        if sum(map(len, self.known)) > CACHED_CHARACTERS:
            self.known = {}
        return b"".join(parts), [0, *itertools.accumulate(len(p) // 4 for p in parts)]


def encode(documents: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, each match of the pattern encoded for itself.

    A null or empty text has no ids. Repeated rows each give a row; a null doc_id stays null; an empty table gives
    an empty table; other columns are left out, whatever their names. The vocabulary (fixed in size, about a
    megabyte) is read on the driver and broadcast.
    """
    spark = documents.sparkSession
    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    shipped = spark.sparkContext.broadcast((serialise_model(ranks), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shipped.value, pattern)
        for batch in slices(batches, "text"):
            ids, ends = encoder(batch.column("text").to_pylist())
            values = pa.array(np.frombuffer(ids, "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return keyed_texts(documents).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for (no ids or null: empty). An id outside the vocabulary fails."""
    spark = encoded.sparkSession
    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    shipped = spark.sparkContext.broadcast(sorted(ranks, key=ranks.__getitem__))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shipped.value.__getitem__
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.column("ids").slice(first, 256)
                ends, ids = part.offsets.to_numpy(), part.values.to_numpy()
                texts = [b"".join(map(token, ids[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, 256), part, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digests(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document the number of ids, the SHA-256 of the ids as decimal text, and that of the decoded bytes."""
    both = decode(encode(documents, vocabulary), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
