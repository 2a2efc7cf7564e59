"""Encoding with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's split pattern. The merges of a piece run on a segment
tree over its byte positions: a leaf holds the rank of the pair that starts there, an inner node the
smaller of its children, so the root is the leftmost pair of lowest rank. A merge updates the leaves of
the merged pair, of the one swallowed and of the live neighbour before it: O(log n) each, so a piece of
a million bytes takes n log n steps, not n squared. Pieces repeat, so a worker keeps the ids of the
pieces it has met, up to a bound.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimi.staging import spread

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("GARIMI_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed split pattern of the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 300_000  # pieces a worker keeps
_KEEP_BYTES = 64  # longer pieces seldom repeat and are not kept
_INF = 1 << 62


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of lowest rank is merged until none is left."""
    whole = rank.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(0, (n - 2).bit_length())  # leaves; leaf i is the pair of the parts at i and after it
    # A node holds rank * 2**32 + position: the minimum is the lowest rank and, among equals, the leftmost.
    tree = [_INF] * (2 * size)
    get = rank.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1)) + [n]  # start of the next live part
    before = list(range(-1, n))

    def put(i: int, value: int) -> None:
        i += size
        if tree[i] == value:
            return
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while tree[1] < _INF:
        i = tree[1] & 0xFFFFFFFF
        gone = after[i]
        end = after[i] = after[gone]
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
            put(i, _INF if r is None else r << 32 | i)
        else:
            put(i, _INF)
        if gone < size:
            put(gone, _INF)
        prev = before[i]
        if prev >= 0:
            r = get(piece[prev:end])
            put(prev, _INF if r is None else r << 32 | prev)
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Texts to ids, with a bounded store of pieces met before."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.find = regex.compile(SPLIT).findall
        self.kept: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        ids = np.array(encode_piece(data, self.rank), np.int32).tobytes()
        if len(data) <= _KEEP_BYTES:
            if len(self.kept) >= CACHE_PIECES:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids as int32 bytes; a null or an empty text has none."""
        if not text:
            return b""
        kept, make = self.kept, self._piece
        return b"".join([kept.get(p) or make(p) for p in self.find(text)])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder."""
    return Encoder(path)


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # the ids take more room than the text: small outputs
                part = batch.slice(at, 500)
                ids = [enc(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return run


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path).encode
        for batch in batches:
            n = pa.array([len(enc(t)) // 4 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["doc_id", "n_tokens"])

    return run


def _vocabulary(folder: str | None, vocabulary: str) -> str:
    return os.path.join(folder or TOKENIZERS, vocabulary)


def encode(documents: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: each row's text as token ids, without special tokens (their strings are ordinary
    text). A null or an empty text gives an empty list. Each row by itself; no shuffle."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(_ids(_vocabulary(folder, vocabulary)), schema)


def count_tokens(documents: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens: the length of ``encode``'s list, which is not kept."""
    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(_counts(_vocabulary(folder, vocabulary)), "doc_id long, n_tokens long")
