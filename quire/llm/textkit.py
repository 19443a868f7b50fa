"""Vectorised text kernels over Arrow string columns: words, hashes and shingles.

Every function works on the UTF-8 bytes of many texts laid end to end, in pieces
of bounded size, so memory does not depend on the number or length of rows
beyond the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

PIECE_BYTES = 1 << 19
U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LANE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(predicate) -> np.ndarray:
    return np.array([bool(predicate(b)) for b in range(256)])


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case.
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: ASCII letters and all bytes of non-ASCII characters.
LETTERS = byte_class(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that near inputs give unrelated hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.concatenate(([U64(1)], np.cumprod(np.full(size, BASE, U64))))
                self.down = np.concatenate(([U64(1)], np.cumprod(np.full(size, INVERSE, U64))))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null text is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif column.type != pa.large_binary():
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Piece:
    """Rows ``first`` to ``last`` of a column, as bytes ``raw`` cut at ``at``."""

    first: int
    last: int
    raw: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The column in runs of whole rows of about ``limit`` bytes; a longer row stands alone."""
    raw, at = utf8(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Piece(i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def prefix_hash(raw: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span_hash`` takes any span from them.

    Only for spans of fewer than SPAN_LIMIT bytes: modulo 2**64, longer ones can be built to collide.
    """
    up, _ = POWERS.get(len(raw) + 1)
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTE_HASH[fold[raw]] * up[:-1], out=out[1:])
    return out


#: BASE - 1 has two factors of 2, so words over two letters built to collide (Thue-Morse words) have 512 bytes at least.
SPAN_LIMIT = 512


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``[start, end)``, equal for equal bytes wherever they stand."""
    _, down = POWERS.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


#: Longer spans are hashed one by one.
CHUNKED = 512


def chunk_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """Hashes of spans of any length, eight bytes a step; every step mixes, so no structure of the bytes survives.

    Spans are not empty.
    """
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:-8] = fold[raw]
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    left = (end - start).astype(np.int64)
    out = mix(left.astype(np.uint64) * LANE[50])
    for k in np.flatnonzero(left > CHUNKED).tolist():
        out[k] = xxhash.xxh3_64_intdigest(padded[start[k] : end[k]].tobytes())
        left[k] = 0
    live = np.flatnonzero(left)
    at, left = start[live], left[live]
    while len(live):
        keep = (U64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - U64(1)
        keep[left >= 8] = ~U64(0)
        out[live] = mix(out[live] * LANE[51] ^ (eights[at] & keep))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


@dataclass
class Words:
    """Word spans of a piece, their hashes, and ``at``: the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def words(piece: Piece, kind: np.ndarray) -> Words:
    """The words of ``piece``: maximal runs of bytes of ``kind``, A-Z taken as a-z."""
    raw, at = piece.raw, piece.at
    inside = kind[raw]
    left = inside.copy()
    left[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    left[firsts] = inside[firsts]
    right = inside.copy()
    right[:-1] &= ~inside[1:]
    lasts = at[1:][at[:-1] < at[1:]] - 1
    right[lasts] = inside[lasts]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    h = chunk_hash(raw, start, end) if len(start) else np.zeros(0, U64)
    return Words(start, end, h, np.searchsorted(start, at))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words that stay within a row, and the word each begins at."""
    total = len(w.hash)
    if total < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.zeros(total - size + 1, U64)
    for j in range(size):
        h += w.hash[j : total - size + 1 + j] * LANE[j]
    fits = np.zeros(total + 1, bool)
    room = w.counts >= size
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, w.at[:-1][room], 1)
    np.add.at(step, w.at[1:][room] - size + 1, -1)
    fits = np.cumsum(step)[: total - size + 1] > 0
    begin = np.flatnonzero(fits)
    return mix(h[begin] + U64(size)), begin


def row_of(at: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that holds each position, given where each row begins."""
    return np.searchsorted(at, positions, "right") - 1


def lower_ascii(text: str) -> str:
    return text.translate(_TO_LOWER)


_TO_LOWER = {c: c + 32 for c in range(65, 91)}
