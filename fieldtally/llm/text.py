"""Words of Arrow text columns as numpy arrays: spans and 64-bit hashes, without a Python object per word.

A word is a run of characters other than space and the control characters 9 to 13. Texts stay UTF-8; positions are bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: bytes of text that are worked on at a time; a longer text is a piece of its own
PIECE_BYTES = 1 << 20
PIECE_ROWS = 8192

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: letters and digits of ASCII, and every byte of other characters
WORDY = np.zeros(256, dtype=bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = WORDY[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mixed(np.arange(256, dtype=np.uint64))
BASE = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 4096), BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every window of n values; each is made from the last by one multiplication in effect."""
    if len(values) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(values) - n + 1, dtype=np.uint64)
    for i in range(n):
        out *= BASE
        out += values[i : i + len(out)]
    return out


@dataclass
class Piece:
    """Some rows of a text column: their bytes, and row r at bounds[r]:bounds[r + 1]."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, by row."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The rows of a string column in order, in pieces of about ``limit`` bytes. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), start + PIECE_ROWS, len(texts))
        yield Piece(slice(start, stop), whole[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start])
        start = stop


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends where its row ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = bounds[:-1][bounds[1:] > bounds[:-1]]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[rows] = False
    after[rows[1:] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] of disjoint, ordered, non-empty spans; the same in every task and run."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # a bounded number of bytes at a time
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, side="right")))
        lengths = ends[at:upto] - starts[at:upto]
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
        codes = BYTE_CODES[data[within + np.repeat(starts[at:upto], lengths)]]
        codes *= powers(int(lengths.max()))[within]
        out[at:upto] = np.add.reduceat(codes, first)
        at = upto
    return mixed(out ^ (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a piece: byte spans, hashes, and the words of row r at rows[r]:rows[r + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray

    @property
    def row(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def words(piece: Piece, lower: bool = False, inside: np.ndarray = ~SPACE) -> Words:
    """All words of a piece. lower: A to Z count as a to z. inside: the bytes that words are made of."""
    data = LOWER[piece.data] if lower else piece.data
    starts, ends = spans(inside[data], piece.bounds)
    return Words(starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, piece.bounds))
