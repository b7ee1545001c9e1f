"""Vectorised work on the bytes of a batch of texts.

A batch is one uint8 array with the texts' UTF-8 bytes back to back and int64 offsets into it, taken
from an Arrow column without a copy. Words are runs of bytes outside ``\\x20 \\x09-\\x0D``; all of these
are ASCII, so cutting bytes and cutting code points give the same words. Null texts count as empty.

Memory: batches are cut to about CHUNK_BYTES of text, so a worker holds some 60 bytes for each byte of
one chunk, or of the longest single text if that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, at least a row each."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; no other character changes."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each text the range of its words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~WHITE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.logical_not(word[:-1], out=edge[1:-1])
    edge[offsets] = True
    first = np.flatnonzero(word & edge[:-1])
    np.logical_not(word[1:], out=edge[1:-1])
    edge[offsets] = True
    return first, np.flatnonzero(word & edge[1:]) + 1, np.searchsorted(first, offsets)


_STEP_IN, _STEP_ON = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
LONG_SPAN = 128  # bytes of a span that are hashed eight at a time; the rest goes through a cryptographic hash


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as an integer; zeros follow the data."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes at a time are mixed in, with what was there fed forward."""
    if not len(first):
        return np.zeros(0, np.uint64)
    window, length = eights(data), end - first
    out = mix(length.astype(np.uint64) * _STEP_ON + np.uint64(salt))
    which, at, left = None, first, length
    for _ in range(LONG_SPAN // 8):
        chunk = window[at] & _MASKS[np.minimum(left, 8)]
        state = out if which is None else out[which]
        state = mix((state ^ chunk) * _STEP_IN) + (state * _STEP_ON ^ chunk)
        if which is None:
            out = state
        else:
            out[which] = state
        more = np.flatnonzero(left > 8)
        if not len(more):
            return mix(out)
        which, at, left = more if which is None else which[more], at[more] + 8, left[more] - 8
    raw = memoryview(np.ascontiguousarray(data))
    for i, a, n in zip(which.tolist(), at.tolist(), left.tolist()):
        digest = hashlib.blake2b(raw[a : a + n], digest_size=8, salt=int(out[i]).to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return mix(out)


def same_spans(data: np.ndarray, first: np.ndarray, end: np.ndarray, other: np.ndarray, other_first: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether the spans of one array of bytes equal those of another, byte by byte."""
    length = end - first
    out = length == other_end - other_first
    x, y = eights(data), eights(other)
    which = np.flatnonzero(out)
    at, to, left = first[which], other_first[which], length[which]
    while len(which):
        mask = _MASKS[np.minimum(left, 8)]
        equal = (x[at] & mask) == (y[to] & mask)
        out[which[~equal]] = False
        more = np.flatnonzero(equal & (left > 8))
        which, at, to, left = which[more], at[more] + 8, to[more] + 8, left[more] - 8
    return out


_STEPS = [np.uint64(x | 1) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(hashes: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, the word each begins at, and the range of windows of each text.

    A text of 1 to k - 1 words gives its whole word sequence as one window; one without words gives none.
    """
    counts = np.diff(ranges)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_ranges = np.concatenate(([0], np.cumsum(made)))
    begin = np.repeat(ranges[:-1] - out_ranges[:-1], made) + np.arange(out_ranges[-1])
    full = np.repeat(counts >= k, made)
    out = np.zeros(len(begin), np.uint64)
    n = len(hashes)
    for j in range(k):
        at = begin + j
        if j and not full.all():
            part = mix(hashes[np.minimum(at, n - 1)] + np.uint64(j + 1)) * _STEPS[j % 5]
            left = np.repeat(ranges[1:], made)
            out += np.where(at < left, part, np.uint64(0))
        else:
            out += mix(hashes[at] + np.uint64(j + 1)) * _STEPS[j % 5]
    lengths = np.repeat(np.minimum(counts, k), made).astype(np.uint64)
    return mix(out + lengths), begin, out_ranges


def code_points(data: np.ndarray) -> np.ndarray:
    """1 at each byte that begins a code point."""
    return (data & 0xC0) != 0x80


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the given ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def sums(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """The sum over each range; 0 for an empty one."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[ranges[1:]] - total[ranges[:-1]]


def blobs(values: np.ndarray, ranges: np.ndarray) -> pa.Array:
    """A binary value with the bytes of each range's elements."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(ranges) - 1, [None, pa.py_buffer(np.ascontiguousarray(ranges * values.itemsize, np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def distinct(values: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each range in ascending order, and their ranges."""
    group = np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    return values[keep], np.concatenate(([0], np.cumsum(np.bincount(group[keep], minlength=len(ranges) - 1))))
