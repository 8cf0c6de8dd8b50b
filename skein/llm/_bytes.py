"""Vectorised work on UTF-8 buffers: words, rolling hashes, window minima.

Everything works on blocks of documents cut from an Arrow string column, so
memory follows the block and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLAB = 1 << 20
_RNG = np.random.default_rng(20240607)
#: One odd 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to a slab, made anew beyond."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLAB + 4096)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLAB:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (multiply, xor, shift)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def blocks(column: pa.Array, most: int = 2 * SLAB) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of at most ``most`` bytes, or one longer row.

    A null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row that it belongs to; words do not cross rows."""
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = ~WS[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and do not overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(starts, lo + SLAB))
        piece = buf[lo : ends[j - 1]]
        if lower:
            piece = LOWER[piece]
        sums = np.empty(len(piece) + 1, U64)
        sums[0] = 0
        np.cumsum(BYTE[piece] * powers(BASE, len(piece)), out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * powers(BASE_INV, len(piece))[a] + (b - a).astype(U64)
        i = j
    return mix(out)


def gram_hashes(symbols: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each k consecutive symbols (already 64-bit values)."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    base, inv = BASE ^ (seed << 1), pow(BASE ^ (seed << 1), -1, 1 << 64)
    for lo in range(0, n, SLAB):
        hi = min(n, lo + SLAB)
        part = symbols[lo : hi + k - 1]
        sums = np.empty(len(part) + 1, U64)
        sums[0] = 0
        np.cumsum(part * powers(base, len(part)), out=sums[1:])
        out[lo:hi] = (sums[k:] - sums[:-k]) * powers(inv, hi - lo)
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if w <= 1 or len(x) < w:
        return x[: max(0, len(x) - w + 1)].copy()
    have, cur = 1, x
    while have * 2 <= w:
        cur = np.minimum(cur[:-have], cur[have:])
        have *= 2
    if have < w:
        cur = np.minimum(cur[: len(cur) - (w - have)], cur[w - have :])
    return cur


def longs(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
