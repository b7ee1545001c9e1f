"""Benchmark decontamination by SimHash of item-sized windows.

An item of L words (lower-cased A-Z) is compared with windows of L words, and with shorter texts as a whole. Both are weighted sets of shingles
of five words (of L words if L is smaller), the weight of a shingle being how often it occurs. Their
similarity is the sum of the lesser weights over the sum of the greater; from 0.8 on a window is a leak.

 1. A window can only reach that if at least 0.8 of as many places as the item has shingles hold a shingle of some item of
    that length. Places are found by look-up, and the windows that hold enough of them from their order.
 2. Each such window gets a 64-bit SimHash (the signs of the weighted sums of its shingles' bits).
 3. Fingerprints are cut into BLOCKS blocks of BITS bits. Two within RADIUS bits agree within RADIUS // BLOCKS bits in some
    block. Half of these are varied in a table of the items' block values, half when a window looks it up, so all items
    within the radius are found; of random fingerprints a seventh are, and the distance decides on these.
    RADIUS is more than three standard deviations above the mean distance at a similarity of 0.8: of windows right at that
    similarity three in ten thousand are further away.
 4. The exact similarity decides. Of the windows of a text the best of each item is returned.

Items are taken in blocks of at most ``block_items`` (and ``block_words`` words), each sent to the tasks, so
what is broadcast has a fixed bound; every block is compared with all texts. Texts are scanned where they lie:
no shuffle.

Nulls: a null or wordless text or item matches nothing. Null keys are kept. Repeated texts and items give rows
each. Other columns are ignored. Empty tables give no rows. Ties of windows go to the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantry.llm import text as T

K, BLOCKS, BITS, RADIUS = 5, 4, 16, 19
_NEAR = np.array([sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS // 2 + 1) for bits in combinations(range(BITS), n)], np.int64)
SCHEMA = "key long, item long, similarity double, start_word long, n_words long, distance long, n_windows long"


@dataclass
class Length:
    """All items of a number of words."""

    words: int
    items: np.ndarray  # numbers of the items
    shingles: list[np.ndarray]  # of each, sorted, repeats kept
    prints: np.ndarray
    table: np.ndarray  # sorted (block << BITS | value)
    table_item: np.ndarray  # index into items


@dataclass
class Index:
    keys: list[int | None]
    lengths: list[Length]
    known: dict[int, tuple[np.ndarray, np.ndarray]]  # by shingle size: sorted shingles and the length each belongs to
    sieve: dict[int, np.ndarray]
    share: float


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingles."""
    out = np.empty(len(shingles), np.uint64)
    width = shingles.shape[1]
    step = max(1, (1 << 22) // (64 * width))
    for i in range(0, len(shingles), step):
        part = np.ascontiguousarray(T.mix(shingles[i : i + step]))
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), width, 8), axis=2)
        out[i : i + step] = np.packbits(2 * bits.sum(1, dtype=np.int32) > width, axis=1).view(np.uint64).ravel()
    return out


def near_blocks(prints: np.ndarray) -> np.ndarray:
    """The values near to each block of each fingerprint, with the block's number above: (fingerprint, block, value)."""
    blocks = np.ascontiguousarray(prints).view(np.uint16).reshape(-1, BLOCKS).astype(np.int64)
    return (np.arange(BLOCKS)[None, :, None] << BITS) | (blocks[:, :, None] ^ _NEAR[None, None, :])


def near_items(group: "Length", prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, item) of all pairs that come near in some block; among them are all within RADIUS bits."""
    found = [np.zeros(0, np.int64)]
    for i in range(0, len(prints), 4096):
        entry = near_blocks(prints[i : i + 4096]).reshape(-1, BLOCKS * len(_NEAR))
        lo = np.searchsorted(group.table, entry.ravel(), "left")
        n = np.searchsorted(group.table, entry.ravel(), "right") - lo
        window = np.repeat(np.repeat(np.arange(i, i + len(entry)), entry.shape[1]), n)
        found.append(np.unique(window * len(group.items) + group.table_item[T.ragged(lo, n)]))
    pair = np.concatenate(found)
    return pair // len(group.items), pair % len(group.items)


def build(items: list[tuple[int | None, str | None]], share: float = 0.8) -> Index:
    data, offsets = T.view(pa.array([x for _, x in items], pa.string()))
    data = T.lower(data)
    first, end, ranges = T.words(data, offsets)
    hashes = T.span_hashes(data, first, end)
    counts = np.diff(ranges)
    lengths, known = [], {}
    for n in np.unique(counts[counts > 0]).tolist():
        own = np.flatnonzero(counts == n)
        k = min(K, n)
        rows = np.stack([T.shingles(hashes[ranges[i] : ranges[i + 1]], np.array([0, n]), k)[0] for i in own])
        prints = simhash(rows)
        entry = near_blocks(prints)
        item = np.broadcast_to(np.arange(len(own))[:, None, None], entry.shape).ravel()
        order = np.argsort(entry.ravel(), kind="stable")
        known.setdefault(k, []).append((np.unique(rows), len(lengths)))
        lengths.append(Length(n, own, [np.sort(r) for r in rows], prints, entry.ravel()[order], item[order]))
    pairs, sieve = {}, {}
    for k, found in known.items():
        shingles, of = np.concatenate([s for s, _ in found]), np.concatenate([np.full(len(s), i) for s, i in found])
        order = np.argsort(shingles, kind="stable")
        pairs[k] = (shingles[order], of[order])
        sieve[k] = np.zeros(1 << 20, bool)
        sieve[k][(shingles >> np.uint64(44)).astype(np.int64)] = True
    return Index([x for x, _ in items], lengths, pairs, sieve, share)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted lists of shingles: the sum of the lesser counts over the sum of the greater."""
    values, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(place[: len(a)], minlength=len(values)), np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _starts(at: np.ndarray, doc: np.ndarray, own: np.ndarray, m: int, need: int) -> np.ndarray:
    """First places of all windows of m places within a text that hold at least ``need`` of the sorted places ``at``."""
    if len(at) < need:
        return np.zeros(0, np.int64)
    head, tail = at[: len(at) - need + 1], at[need - 1 :]
    ok = (tail - head < m) & (doc[: len(at) - need + 1] == doc[need - 1 :])
    low = np.maximum(tail[ok] - m + 1, own[doc[: len(ok)][ok]])
    high = np.minimum(head[ok], own[doc[: len(ok)][ok] + 1] - m)
    size = np.maximum(high - low + 1, 0)
    return np.unique(T.ragged(low, size))


def leaks(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int, int, int]]:
    """(text, item, similarity, first word, words, distance, windows) of the best window of each item in each text."""
    data = T.lower(data)
    first, end, ranges = T.words(data, offsets)
    hashes = T.span_hashes(data, first, end)
    best: dict[tuple[int, int], list] = {}
    for k, (known, of) in index.known.items():
        shingles, _, own = T.shingles(hashes, ranges, k)
        maybe = np.flatnonzero(index.sieve[k][(shingles >> np.uint64(44)).astype(np.int64)])
        low = np.searchsorted(known, shingles[maybe], "left")
        count = np.searchsorted(known, shingles[maybe], "right") - low
        place, length = np.repeat(maybe, count), of[T.ragged(low, count)]
        if not len(place):
            continue
        order = np.lexsort((place, length))
        place, length = place[order], length[order]
        doc = np.searchsorted(own, place, "right") - 1
        edges = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1])))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(length)]):
            group = index.lengths[int(length[a])]
            m = group.words - k + 1
            need = max(1, int(np.ceil(index.share * m - 1e-9)))
            starts = _starts(place[a:b], doc[a:b], own, m, need)
            step = max(1, (1 << 20) // m)
            found = [(some, shingles[some[:, None] + np.arange(m)]) for some in (starts[s : s + step] for s in range(0, len(starts), step))]
            held = np.bincount(doc[a:b], minlength=len(own) - 1)
            size = np.diff(own)  # texts that are shorter than the item: each as a whole
            short = np.flatnonzero((held >= need) & (size < m) & (np.diff(ranges) >= k))
            found += [(own[d : d + 1], shingles[None, own[d] : own[d + 1]]) for d in short.tolist()]
            for some, rows in found:
                prints = simhash(rows)
                window, item = near_items(group, prints)
                distance = np.bitwise_count(prints[window] ^ group.prints[item])
                near = distance <= RADIUS
                for w, i, d in zip(window[near].tolist(), item[near].tolist(), distance[near].tolist()):
                    value = similarity(np.sort(rows[w]), group.shingles[i])
                    if value >= index.share:
                        text = int(np.searchsorted(own, some[w], "right") - 1)
                        have = best.setdefault((text, int(group.items[i])), [value, int(some[w] - own[text]), group.words, d, 0])
                        have[4] += 1
                        if value > have[0]:
                            have[:4] = [value, int(some[w] - own[text]), group.words, d]
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def _blocks(items: DataFrame, key: str, text: str, block_items: int, block_words: int) -> Iterator[list[tuple[int | None, str | None]]]:
    held, words = [], 0
    for r in items.select(F.col(key).cast("long"), F.col(text).cast("string")).toLocalIterator():
        held.append((r[0], r[1]))
        words += len((r[1] or "").split())
        if len(held) >= block_items or words >= block_words:
            yield held
            held, words = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = 0.8, block_items: int = 5000, block_words: int = 500_000) -> DataFrame:
    """A row for each text and item that leaks into it: key, item, similarity, start_word, n_words, distance, n_windows."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def scan(block: list[tuple[int | None, str | None]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(build(block, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for part in T.slices(batch):
                    found = leaks(index, *T.view(part.column("text")))
                    if found:
                        text, item, value, start, n, distance, windows = zip(*found)
                        keys = part.column("key").take(pa.array(text))
                        yield pa.RecordBatch.from_arrays([keys, pa.array([index.keys[i] for i in item], pa.int64()), pa.array(value), *[pa.array(x, pa.int64()) for x in (start, n, distance, windows)]], ["key", "item", "similarity", "start_word", "n_words", "distance", "n_windows"])

        return rows.mapInArrow(run, SCHEMA)

    scans = [scan(b) for b in _blocks(items, item_key, item_text, block_items, block_words)]
    return reduce(DataFrame.unionByName, scans) if scans else docs.sparkSession.createDataFrame([], SCHEMA)
