"""Byte-level BPE: texts to token ids by a rank file, and back.

A text is cut by a pattern and each piece is encoded on its own.  A piece that is itself a
token is that token; any other starts as single bytes.  A segment tree over the piece's byte
positions holds the rank of the pair that starts at each live position, and at its root the
lowest rank; going left wherever the left side holds it leads to the leftmost place of that
rank.  A merge kills one position and updates the ranks at its live neighbours, each in
logarithmic time, so a piece of n bytes takes O(n log n) however long it is.

Pieces repeat, so a Python worker keeps the ids of short ones, up to a number.  Ids are packed as little-endian
unsigned 32-bit integers.  A null text counts as empty and has no ids; empty tables stay
empty; repeated rows each give a row; other columns are not looked at.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumenstep.llm._common import over_texts

#: Above every rank: no pair starts here.
NO_PAIR = 1 << 32
#: Ids of pieces up to so many characters are kept, at most so many pieces in a task at once.
KEEP_CHARS, KEEP_PIECES = 40, 1 << 20
#: Texts from this length on are cut into pieces bit by bit.
LONG_TEXT, PIECES_AT_ONCE = 1 << 20, 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each token of a rank file: a token in base64 and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTree:
    """Lowest pair rank of a piece, over its byte positions."""

    __slots__ = ("low", "size")

    def __init__(self, ranks: list[int]):
        """ranks: of the pair at each position."""
        self.size = size = 1 << max(0, len(ranks) - 1).bit_length()
        level = ranks + [NO_PAIR] * (size - len(ranks))
        low = level
        while len(level) > 1:
            level = [a if a <= b else b for a, b in zip(level[::2], level[1::2])]
            low = level + low
        self.low = [NO_PAIR, *low]

    def leftmost_lowest(self) -> int | None:
        """The leftmost position of the lowest rank; None if no pair is left."""
        low, k, size = self.low, 1, self.size
        rank = low[1]
        if rank == NO_PAIR:
            return None
        while k < size:
            k += k
            if low[k] != rank:
                k += 1
        return k - size

    def put(self, at: int, rank: int) -> None:
        low, k = self.low, at + self.size
        low[k] = rank
        while k > 1:
            other = low[k ^ 1]
            if other < rank:
                rank = other
            k >>= 1
            if low[k] == rank:
                return
            low[k] = rank


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n, rank_of = len(piece), ranks.get
    # of the token that starts at a live position: its end, and where the token before it starts
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = PairTree([rank_of(piece[i : i + 2], NO_PAIR) for i in range(n - 1)])
    put, lowest = tree.put, tree.leftmost_lowest
    while (at := lowest()) is not None:
        gone = end[at]
        end[at] = after = end[gone]
        if after < n:
            before[after] = at
            put(gone, NO_PAIR)
            put(at, rank_of(piece[at : end[after]], NO_PAIR))
        else:
            if gone < n - 1:
                put(gone, NO_PAIR)
            put(at, NO_PAIR)
        if at:
            left = before[at]
            put(left, rank_of(piece[left:after], NO_PAIR))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


def pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


class Encoder(dict):
    """Packed ids by piece; unknown pieces are encoded when they are asked for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)

    def __missing__(self, piece: str) -> bytes:
        ids = pack(encode_piece(piece.encode(), self.ranks))
        if len(piece) <= KEEP_CHARS:
            if len(self) >= KEEP_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(text) < LONG_TEXT:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        found, parts = (m.group() for m in self.pattern.finditer(text)), []
        while some := list(islice(found, PIECES_AT_ONCE)):
            parts.append(b"".join(map(self.__getitem__, some)))
        return b"".join(parts)


#: Encoders of this Python worker by vocabulary; tasks that follow one another share what was encoded.
_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(name: tuple, ranks: dict[bytes, int], pattern: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(ranks, pattern)
    return _ENCODERS[name]


def _read_back(ids: Iterator[bytes], token: dict[int, bytes]) -> list[bytes]:
    """The bytes that packed ids stand for."""
    return [b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text", back: bool = False) -> DataFrame:
    """(id_column, ids binary) of each row; ranks of one vocabulary, which is broadcast.

    back: also `decoded` binary, read back from the ids as decode() does, without another pass.
    """
    known, name = docs.sparkSession.sparkContext.broadcast(ranks), (uuid.uuid4().hex, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, known.value, pattern)
        token = {rank: piece for piece, rank in known.value.items()} if back else {}
        for batch in batches:
            ids = [encoder.encode(x.as_py() or "") for x in batch.column(1)]
            columns = [batch.column(0), pa.array(ids, pa.binary()), *([pa.array(_read_back(ids, token), pa.binary())] if back else [])]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "ids", "decoded"][: len(columns)])

    slim = docs.select(id_column, text_column)
    return over_texts(slim, run, f"`{id_column}` {slim.schema[0].dataType.simpleString()}, ids binary" + ", decoded binary" * back)


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_column: str = "doc_id") -> DataFrame:
    """(id_column, ids, decoded binary) of rows (id_column, ids); null ids give no bytes, unknown ids are refused."""
    known = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: piece for piece, rank in known.value.items()}
        for batch in batches:
            whole = pa.array(_read_back((x.as_py() or b"" for x in batch.column(1)), token), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole], [id_column, "ids", "decoded"])

    slim = encoded.select(id_column, "ids")
    return over_texts(slim, run, f"`{id_column}` {slim.schema[0].dataType.simpleString()}, ids binary, decoded binary")
