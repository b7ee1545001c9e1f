"""Counts of a batch of texts: words, lines, repeats, kinds of characters."""

from __future__ import annotations

import numpy as np

from pantry.llm import text as T

SYMBOLS = b"#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(SYMBOLS)
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT = _table(bytes(range(48, 58)))
_MARK = _table(b".,;:?'\"()-")


def _count(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return T.sums(flags.astype(np.int8).astype(np.int64), offsets)


def lines(data: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that have a word, and the range of each text. Lines end at a line feed or the text's end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    breaks = data == 10
    edge[1:] |= breaks
    start = np.flatnonzero(edge[:-1])
    end = np.append(start[1:], len(data))
    end = end - (breaks[end - 1] if len(end) else 0)
    has = np.searchsorted(first, end) > np.searchsorted(first, start)
    start, end = start[has], end[has]
    return T.span_hashes(data, start, end, salt=7), np.searchsorted(start, offsets)


def base(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text (and, for more statistics, first, end, ranges and hashes of the words)."""
    first, end, ranges = T.words(data, offsets)
    hashes = T.span_hashes(data, first, end)
    n = len(offsets) - 1
    points = np.concatenate(([0], np.cumsum(T.code_points(data))))
    line, line_ranges = lines(data, offsets, first)
    counts = np.diff(ranges)
    windows, begin, own = T.shingles(hashes, ranges, 3)
    covered = np.zeros(len(first) + 3, np.int64)
    if len(windows):
        doc = np.repeat(np.arange(n), np.diff(own))
        order = np.lexsort((windows, doc))
        same = (windows[order][1:] == windows[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = begin[twice & np.repeat(counts >= 3, np.diff(own))]
        for j in range(3):
            covered[at + j] = 1
    return {
        "n_words": counts,
        "word_chars": T.sums(points[end] - points[first], ranges),
        "n_symbols": _count(_SYMBOL[data], offsets),
        "n_dup_lines": np.diff(line_ranges) - np.diff(T.distinct(line, line_ranges)[1]),
        "n_repeat_words": T.sums(covered[: len(first)], ranges),
        "first": first, "end": end, "ranges": ranges, "hashes": hashes, "n_lines": np.diff(line_ranges),
    }


NAMES = ("words", "word_length", "word_spread", "distinct", "symbols", "upper", "digits", "marks", "exclamations", "double_words", "repeats", "dup_lines", "line_words", "top_word", "letters")


def transformed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text, near to normal: logs of sizes, roots of shares. All 0 for a text without words."""
    b = base(data, offsets)
    n, ranges = np.maximum(b["n_words"], 1), b["ranges"]
    size = np.maximum(np.diff(offsets), 1)
    length = (b["end"] - b["first"]).astype(np.float64)
    mean = T.sums(length, ranges) / n
    spread = np.sqrt(np.maximum(T.sums(length**2, ranges) / n - mean**2, 0))
    unique, _, back = np.unique(b["hashes"], return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(offsets) - 1), b["n_words"])
    key, count = np.unique(doc * max(len(unique), 1) + back, return_counts=True)
    owner = key // max(len(unique), 1)
    top = np.zeros(len(offsets) - 1)
    np.maximum.at(top, owner, count)
    double = np.zeros(len(doc), np.int64)
    if len(doc) > 1:
        double[1:] = (b["hashes"][1:] == b["hashes"][:-1]) & (doc[1:] == doc[:-1])
    letters = np.maximum(_count(_LETTER[data], offsets), 1)
    out = np.stack([
        np.log1p(b["n_words"]),
        np.log1p(mean),
        np.log1p(spread),
        np.sqrt(np.bincount(owner, minlength=len(n)) / n),
        np.sqrt(b["n_symbols"] / size),
        np.sqrt(_count(_UPPER[data], offsets) / letters),
        np.sqrt(_count(_DIGIT[data], offsets) / size),
        np.sqrt(_count(_MARK[data], offsets) / n),
        np.sqrt(_count(data == 33, offsets) / n),
        np.sqrt(T.sums(double, ranges) / n),
        np.sqrt(b["n_repeat_words"] / n),
        np.sqrt(b["n_dup_lines"] / np.maximum(b["n_lines"], 1)),
        np.log1p(b["n_words"] / np.maximum(b["n_lines"], 1)),
        np.sqrt(top / n),
        np.sqrt(letters / size),
    ], 1)
    out[b["n_words"] == 0] = 0
    return out
