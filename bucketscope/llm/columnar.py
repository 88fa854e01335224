"""Arrow text columns as numpy byte arrays: slicing, words, shingles, n-grams.

Every helper works on whole texts. Work memory is bounded by slicing a batch into runs of
documents of about ``SLICE_BYTES``; a text longer than that forms a slice of its own.
Words follow one rule in all operators: A-Z lower-cased, split at bytes 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Bytes that are hashed at once (a longer word alone).
PIECE_BYTES = 1 << 18
SHINGLE_WORDS = 5

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_POWERS: list[np.ndarray] = []


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings; null becomes the empty string."""
    return [x or "" for x in column.to_pylist()]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) of runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, body[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (rows + 1)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * PIECE_BYTES)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_P, inverse)]
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes; the same in every process."""
    out = np.zeros(len(starts), np.uint64)
    at, step = 0, PIECE_BYTES
    while at < len(starts):  # piece by piece; the hash of a word is the same in any
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, "right")))
        base = starts[at]
        piece = data[base : ends[to - 1]].astype(np.uint64) + np.uint64(1)
        up, down = _powers(len(piece) + 1)
        piece *= up[: len(piece)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece)])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _Q[0]
        at = to
    return mixed(out)


def shingle_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each row the hashes of its word shingles in text order, repeats kept.

    Fewer than five words form one shingle of the whole sequence; no words give none.
    """
    low = lowered(data)
    starts, ends, first = word_bounds(low, offsets)
    h = word_hashes(low, starts, ends)
    k = SHINGLE_WORDS
    joined = np.zeros(0, np.uint64)
    if len(h) >= k:
        joined = h[: len(h) - k + 1] * _Q[0]
        for j in range(1, k):
            joined = joined + h[j : len(h) - k + 1 + j] * _Q[j]
        joined = mixed(joined)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield joined[a : b - k + 1]
        elif b > a:
            total = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for j in range(b - a):
                    total = total + h[a + j] * _Q[j]
            yield mixed(np.array([total ^ _Q[4]], np.uint64))
        else:
            yield joined[:0]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of each segment, one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
    return flat[np.cumsum(step)]
