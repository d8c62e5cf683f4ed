"""Words of many texts at once, as NumPy arrays over their bytes.

Words are runs of bytes outside ASCII white space, so UTF-8 needs no decoding. A word's hash is a polynomial over a
random table modulo 2**64 with a mixing step; equal words have equal hashes, and two hashes of n different words
collide with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _pow(which: str, n: int) -> np.ndarray:
    got = _powers.get(which)
    if got is None or len(got) < n:
        x = np.full(max(n, 1 << 18), _BASE if which == "up" else _INVERSE, np.uint64)
        x[0] = 1
        _powers[which] = got = np.cumprod(x, dtype=np.uint64)
    return got[:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each text begins (one more entry at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each text's words begin among them (one more entry at the end)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~_SPACE[buf]
    first = np.empty(len(buf), bool)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    heads = off[:-1][off[:-1] < len(buf)]
    first[heads] = True
    last = np.empty(len(buf), bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    last[heads[heads > 0] - 1] = True
    starts, ends = np.flatnonzero(first & solid), np.flatnonzero(last & solid) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each slice; the slices are in order and apart from each other."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        at, n = int(starts[i]), int(ends[j - 1] - starts[i])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buf[at : at + n]] * _pow("up", n), dtype=np.uint64, out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * _pow("down", n)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k hashes in a row: len(h) - k + 1 of them, at least none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, by = h[:n].copy(), np.uint64(_BASE)
    for i in range(1, k):
        out *= by
        out += h[i : i + n]
    return mix(out)


def runs(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each h[start:end]; equal runs have equal hashes."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _pow("up", len(h)), dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _pow("down", len(h) + 1)[starts] + (ends - starts).astype(np.uint64))


def batches(table: pa.Table | pa.RecordBatch, column: str, most: int = 2 << 20):
    """Slices of the table whose texts have about `most` bytes each; a longer text comes alone."""
    if not table.num_rows:
        return
    size = pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy()
    ends = np.cumsum(size.astype(np.int64))
    i = 0
    while i < table.num_rows:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        yield table.slice(i, j - i)
        i = j
