"""Vectorised tokens and hashes over the UTF-8 bytes of Arrow string columns.

Each helper works on a block of rows at once, half a MB of text, so memory stays
bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words between white space.
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}
#: Bytes of text in a block, and entries of a table of powers that is kept between blocks.
BLOCK, KEPT = 1 << 19, 1 << 20


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if len(have) <= KEPT:
            _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows within these bytes); null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, whole[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def tokens(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes in `member`, never across rows."""
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial by prefix sums, then mixed."""
    n = len(data)
    inverse = pow(BASE, -1, 1 << 64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", BASE, n + 1)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", inverse, n + 1)[starts] + (ends - starts).astype(np.uint64) * MULT)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each white-space word, A-Z lower-cased."""
    low = LOWER[data]
    starts, ends, row = tokens(low, offs, WORD)
    return span_hash(low, starts, ends), row


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `size` words; a shorter row's words form one shingle."""
    weight = mix(np.arange(1, size + 1, dtype=np.uint64) * MULT) | np.uint64(1)
    counts = np.bincount(row, minlength=n_rows)
    n = len(words)
    full = max(0, n - size + 1)
    acc = np.zeros(full, np.uint64)
    for j in range(size):
        acc += words[j : j + full] * weight[j]
    ok = row[:full] == row[n - full :] if full else np.zeros(0, bool)
    hashes, rows = mix(acc[ok]), row[:full][ok]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        extra = [mix(np.atleast_1d(np.sum(words[first[r] : first[r] + counts[r]] * weight[: counts[r]]) + np.uint64(counts[r])))[0] for r in short]
        hashes, rows = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows


def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, rising within their row; rows come in order."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]
