"""Distinct words of a batch and the character n-grams inside them."""

from __future__ import annotations

import numpy as np

from pantry.llm import text as T

_STEP = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and range by text of each run of ASCII letters and non-ASCII bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = (data >= 128) | ((data | 32) - 97 < 26)
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = letter[1:] != letter[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = letter[at[:-1]]
    first = at[:-1][keep]
    return first, at[1:][keep], np.searchsorted(first, offsets)


def distinct_words(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the first occurrence of each, and for each occurrence its distinct word."""
    return np.unique(T.span_hashes(data, first, end), return_index=True, return_inverse=True)


def by_text(back: np.ndarray, ranges: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, distinct word, occurrences) of each distinct word of each text."""
    doc = np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
    key, count = np.unique(doc * max(n_words, 1) + back, return_counts=True)
    return key // max(n_words, 1), key % max(n_words, 1), count


def ngrams(data: np.ndarray, first: np.ndarray, end: np.ndarray, orders: tuple[int, ...], edges: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the 64-bit hashes of all n-grams of code points of the words and the range of each word.

    edges: a word is taken with a blank on both sides. A word shorter than the order has no n-gram of it.
    """
    n = len(first)
    lengths = end - first
    room = lengths + 2 * edges
    place = np.cumsum(room) - room
    flat = np.full(int(room.sum()), 32, np.uint8)
    flat[T.ragged(place + edges, lengths)] = data[T.ragged(first, lengths)]
    points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(T.code_points(flat))))[np.append(place, len(flat))]
    sizes = np.diff(starts)
    out, running = [], np.zeros(len(points), np.uint64)
    made = {}
    for k in range(1, max(orders) + 1):
        size = len(points) - k + 1
        if size <= 0:
            made[k] = np.zeros(0, np.uint64)
            continue
        running = running[:size] * _STEP + T.mix(points[k - 1 :] + np.uint64(k))
        made[k] = running
    for k in orders:
        count = np.maximum(sizes - k + 1, 0)
        out.append((T.mix(made[k][T.ragged(starts[:-1], count)]), np.concatenate(([0], np.cumsum(count)))))
    return out if n else [(np.zeros(0, np.uint64), np.zeros(1, np.int64)) for _ in orders]
