"""Vectorised word handling over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes are never part of a
multi-byte UTF-8 character, so working on bytes equals working on code points.  Hashes are prefix
sums of byte polynomials modulo 2**64, finished with a bit mixer, so a batch of texts is hashed
without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WS = b" \t\n\x0b\f\r"
CHUNK = 1 << 20
U = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[list(WS)] = True
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        one = np.full(size, base, dtype=np.uint64)
        one[0] = 1
        inv = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        inv[0] = 1
        have = (np.multiply.accumulate(one), np.multiply.accumulate(inv))
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hash of values[start:end] for each span; equal content gives equal hashes wherever it stands."""
    p, inv = _pow(base, len(values) + 1)
    acc = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p[: len(values)], out=acc[1:])
    h = (acc[ends] - acc[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


class Words:
    """Words of consecutive texts: byte spans, hashes, and the first word of each text (``first`` has one more)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        offs = (offsets - offsets[0]).astype(np.int64)
        seg = data[offsets[0] : offsets[-1]]
        if lower:
            seg = np.where((seg >= 65) & (seg <= 90), seg | 32, seg)
        ws = _WS[seg]
        full = offs[:-1] < offs[1:]
        start, end = ~ws, ~ws
        start[1:] &= ws[:-1]
        end[:-1] &= ws[1:]
        at = offs[:-1][full]
        start[at] = ~ws[at]
        at = offs[1:][full] - 1
        end[at] = ~ws[at]
        self.bytes, self.offs = seg, offs
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        return span_hash(self.bytes.astype(np.uint64) + U(1), self.start, self.end, base)


@lru_cache(1)
def _empty() -> np.ndarray:
    return np.zeros(0, dtype=np.uint8)


def text_chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, data, offsets) of pieces of about ``size`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else _empty()
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offs, offs[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, stop, data, offs[row : stop + 1]
        row = stop


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes; null as empty."""
    for value in column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column:
        yield value.as_py() or b""


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, type=kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
