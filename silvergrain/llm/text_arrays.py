"""Texts of an Arrow batch as numpy arrays: words, shingles and window hashes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE = 1 << 21
_STEP = 0x9E3779B97F4A7C15
BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _sequence(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(_STEP) + U(seed))


BYTES = _sequence(256, 1)
PLACES = _sequence(8, 2) | U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_held: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n + 1 of each."""
    size = SLICE
    while size < n + 1:
        size *= 2
    if size not in _held:
        if size > SLICE:  # a very long text: not kept
            return _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
        _held[size] = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
    return _held[size]


def flat(column: pa.Array | pa.ChunkedArray, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of the column, of so many bytes at most (SLICE, if not given) or one text; null texts are empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if len(chunk):
            kind = np.int64 if pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type) else np.int32
            at = np.frombuffer(chunk.buffers()[1], kind)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
            data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] is not None else np.zeros(0, np.uint8)
            lo = 0
            while lo < len(chunk):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (most or SLICE), "right")) - 1)
                yield row + lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                lo = hi
        row += len(chunk)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each lower-cased word, and words per text as offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    data = LOWER[data]
    solid = ~SPACES[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    a, z = np.flatnonzero(starts), np.flatnonzero(ends)
    with np.errstate(over="ignore"):
        up, down = powers(n)
        total = np.cumsum(BYTES[data] * up[:n], dtype=U)
        before = np.where(a > 0, total[a - 1], U(0))
        hashed = mix((total[z] - before) * down[a] + (z - a + 1).astype(U) * U(_STEP))
    return hashed, np.searchsorted(a, offsets)


def shingles(hashed: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words (all its words, if fewer), and their offsets."""
    n = np.diff(at)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(len(hashed) - k + 1, 0), U)
        for j in range(k):
            runs += hashed[j : j + len(runs)] * PLACES[j]
        runs = mix(runs)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        out_at = np.r_[0, np.cumsum(count)]
        first = np.repeat(at[:-1], count) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], count)
        out = np.zeros(out_at[-1], U)
        full = np.repeat(n >= k, count)
        out[full] = runs[first[full]]
        for t in np.flatnonzero((n < k) & (n > 0)):
            w = hashed[at[t] : at[t + 1]]
            out[out_at[t]] = mix(np.array([(w * PLACES[: len(w)]).sum(dtype=U) + U(len(w)) * U(_STEP)], U))[0]
    return out, out_at


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width bytes."""
    n = len(data)
    if n < width:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        up, down = powers(n)
        total = np.cumsum(BYTES[data] * up[:n], dtype=U)
        out = total[width - 1 :].copy()
        out[1:] -= total[: n - width]
        out *= down[: n - width + 1]
        return mix(out)
