"""Fuzzy passages that repeat across documents, by collinear chaining of shared k-mer seeds.

 1. Seeds: of each K consecutive words (lower-cased A-Z) a 64-bit hash; of each WINDOW neighbouring hashes the
    least one is a seed. Two texts that share K + WINDOW - 1 words in a row share a seed there, so a passage of
    50 words at a similarity of 0.8 has one at least. (Of a seed that recurs within WINDOW words, as in
    periodic text, the first counts and then, from it on, the first in each WINDOW words.)
 2. Seeds are joined by hash. Each occurrence is first matched with the first document that has the seed and with
    the document just before its own in order of keys, the n-th occurrence with its n-th (round and round if it has
    fewer) and with its first: fewer than 2 N matches for a seed that N documents have. Sorted rows stream through.
 3. The matches of a document with a partner are chained: in order in both, gaps cost GAP a word on either
    side. The best chain before a match is a prefix maximum in a Fenwick tree over the partner's places. Chains are
    cut at gaps of more than WIDE words. A chain of which four seeds in five lie in chains with earlier partners is left out.
 4. Chains are aligned word by word: seeds grow as long as the words agree, gaps between them are aligned by longest
    common runs, and the ends go on over up to four differing words. An alignment whose two sides have a Jaccard
    similarity of five-word shingles under 0.8 is cut at its widest gap, and its parts are looked at again; parts of
    50 words or more remain.
 5. Shared seeds that no passage covers by then are compared with all their earlier holders, whatever their number. A
    passage of 50 words at 0.8 has 24 equal words in a row at least (an edit costs five shingles or so, and one in nine may
    be lost), so it has a seed with 16 equal words in a row to one side. Occurrences are dealt by these 16 words, each
    with the CONTEXT words around it (a byte a word); equal contexts are one class, held by its first
    occurrence. In a group each open class is compared with every earlier class by the number of words that agree over one
    edit on either side, until one is found that reaches SURE words; the best from NEAR words on is chained and aligned as before.
    A group is dealt out by salts, so that a task compares at most MOST open classes with it.
 6. Overlapping passages of a document become one.
A passage counts against the later document (the greater key); the earlier one is its source. Only documents
with chains are read again, as word hashes. Tables go when no later step reads them.

Nulls: a null or short text has no seeds; rows with a null key take no part. Rows with the same key are one
document (its longest text, of equally long ones the greatest), and nothing is cut from their other texts. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantry.llm import bitmap
from pantry.llm import text as T
from pantry.llm.shared import fresh, gone, kept

K, WINDOW, GAP = 8, 12, 0.1
LEAST_WORDS, SHARE, SHINGLE = 50, 0.8, 5
WIDE = 64  # words of a gap at which a chain is cut
CONTEXT = 48  # words on either side of a seed that are compared
EXACT = 24  # equal words in a row that every passage has
NEAR, SURE = LEAST_WORDS - 4, 64  # agreeing words around a seed from which on a partner is aligned, and the search for a better one ends
MOST = 4096
MARGIN = 64  # words beyond a chain's ends that an alignment may use


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = T.view(column)
    data = T.lower(data)
    first, end, ranges = T.words(data, offsets)
    return T.span_hashes(data, first, end), ranges


_STEPS = [T.mix(np.array([j + 1], np.uint64))[0] | np.uint64(1) for j in range(max(K, SHINGLE))]


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on, as far as k follow; the words' hashes are mixed already."""
    n = max(len(hashes) - k + 1, 0)
    out = hashes[:n] * _STEPS[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _STEPS[j]
    return out


def seeds(hashes: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of the chosen k-mers."""
    counts = np.diff(ranges)
    size = np.maximum(counts - K + 1, 0)
    own = np.concatenate(([0], np.cumsum(size)))
    doc, begin = np.repeat(np.arange(len(counts)), size), T.ragged(ranges[:-1], size)
    n = len(begin)
    if not n:
        return np.zeros(0, np.uint64), doc, begin
    mers = T.mix(_grams(hashes, K)[begin])
    # The least of each window, by its value and its place: each step makes windows of the first span + step k-mers.
    least, best, span = mers, np.arange(n), 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        best = np.where(least[step:] < least[:-step], best[step:], best[:-step])
        least = np.minimum(least[step:], least[:-step])
        span += step
    whole = np.arange(len(best)) + WINDOW <= own[doc[: len(best)] + 1]
    few = np.flatnonzero((size > 0) & (size < WINDOW))  # texts of less than a window: the least of all
    place = own[few][:, None] + np.arange(WINDOW - 1)
    inside = place < own[few + 1][:, None]
    alone = np.where(inside, mers[np.where(inside, place, 0)], ~np.uint64(0)).argmin(1) + own[few]
    chosen = np.unique(np.concatenate((best[whole], alone)))
    order = chosen[np.lexsort((chosen, mers[chosen], doc[chosen]))]
    linked = np.zeros(len(order), bool)
    linked[1:] = (mers[order][1:] == mers[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (np.diff(order) < WINDOW)
    lead = order[np.maximum.accumulate(np.where(linked, 0, np.arange(len(order))))]
    part = (order - lead) // WINDOW
    again = np.zeros(len(order), bool)
    again[1:] = linked[1:] & (part[1:] == part[:-1])
    chosen = order[~again]
    return mers[chosen], doc[chosen], begin[chosen] - ranges[doc[chosen]]


def _postings(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                mers, doc, at = seeds(*word_hashes(part.column("text")))
                if len(mers):
                    yield pa.RecordBatch.from_arrays([pa.array(mers.view(np.int64)), part.column("key").take(pa.array(doc)), pa.array(at.astype(np.int32))], ["seed", "key", "at"])

    return docs.mapInArrow(run, "seed long, key long, at int")


def _matches(postings: DataFrame) -> DataFrame:
    """(key, partner, at, there, seed): an occurrence and the same seed in an earlier document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            n_held = len(held[0])
            seed, key, at = (np.concatenate((h, batch.column(c).to_numpy().astype(np.int64))) for h, c in zip(held, ("seed", "key", "at")))
            new_seed = np.concatenate(([True], seed[1:] != seed[:-1]))
            new_run = new_seed | np.concatenate(([True], key[1:] != key[:-1]))
            run_start = np.flatnonzero(new_run)
            run_of = np.cumsum(new_run) - 1
            seed_of_run = np.cumsum(new_seed)[run_start]
            first_run = np.searchsorted(seed_of_run, seed_of_run)
            before = np.arange(len(run_start)) - 1
            rows = np.flatnonzero(first_run[run_of] != run_of)
            rows = rows[rows >= n_held]
            own = run_of[rows]
            near = rows[before[own] != first_run[own]]
            here = np.concatenate((rows, near))
            other = np.concatenate((first_run[own], before[run_of[near]]))
            turn = (here - run_start[run_of[here]]) % np.diff(np.append(run_start, len(seed)))[other]
            here = np.concatenate((here, here[turn > 0]))
            there = np.concatenate((run_start[other] + turn, run_start[other[turn > 0]]))
            if len(here):
                yield pa.RecordBatch.from_arrays([pa.array(key[here]), pa.array(key[there]), pa.array(at[here].astype(np.int32)), pa.array(at[there].astype(np.int32)), pa.array(seed[here])], ["key", "partner", "at", "there", "seed"])
            last = len(run_start) - 1
            keep = np.flatnonzero((run_of == first_run[last]) | (run_of >= max(last - 1, first_run[last])))
            held = [x[keep] for x in (seed, key, at)]

    return postings.repartition("seed").sortWithinPartitions("seed", "key", "at").mapInArrow(run, "key long, partner long, at int, there int, seed long")


def chain(at: list[int], there: list[int], least: int = 2) -> list[list[int]]:
    """Chains (numbers of the matches, in order) of at least ``least`` matches, given the matches in order of ``at``, then ``there`` descending."""
    x, y = np.diff(at), np.diff(there)
    new = np.minimum(np.minimum(x, y), K)
    if (new > 0).all() and (new > GAP * (x + y - 2 * new)).all():  # in order in both, no gap costs more than its match is worth: one chain, as the tree would find
        cuts = (np.flatnonzero(np.maximum(x, y) > K + WIDE) + 1).tolist()
        return [list(range(a, b)) for a, b in zip([0, *cuts], [*cuts, len(at)]) if b - a >= least]
    places = sorted(set(there))
    tree: list[int] = [-1] * (len(places) + 1)  # the best match with a place in the node's range
    score, worth, parent = [0.0] * len(at), [0.0] * len(at), [-1] * len(at)
    for i, (x, y) in enumerate(zip(at, there)):
        p, best = bisect_left(places, y), -1
        q = p
        while q > 0:
            t = tree[q]
            if t >= 0 and (best < 0 or worth[t] > worth[best]):
                best = t
            q -= q & -q
        gain = float(K)
        if best >= 0:
            new = min(K, x - at[best], y - there[best])
            linked = score[best] + new - GAP * ((x - at[best] - new) + (y - there[best] - new))
            if linked > gain:
                gain, parent[i] = linked, best
        score[i], worth[i] = gain, gain + GAP * (x + y)
        q = p + 1
        while q < len(tree):
            if tree[q] < 0 or worth[i] > worth[tree[q]]:
                tree[q] = i
            q += q & -q
    used, out = [False] * len(at), []
    for i in sorted(range(len(at)), key=lambda i: -score[i]):
        members = []
        while i >= 0 and not used[i]:
            used[i] = True
            members.append(i)
            i = parent[i]
        members.reverse()
        cuts = [n for n in range(1, len(members)) if max(at[members[n]] - at[members[n - 1]], there[members[n]] - there[members[n - 1]]) > K + WIDE]
        out += [members[a:b] for a, b in zip([0, *cuts], [*cuts, len(members)]) if b - a >= least]
    return out


def _chains(matches: DataFrame, least: int = 2) -> DataFrame:
    """(key, partner, anchors, low, high, base, top): a row a chain; anchors are its places in both, 32-bit, in turn; an alignment
    may use the words low to high of the document and base to top of the partner. A document's matches (some for each of its seeds) are held together."""

    def reach(places: np.ndarray) -> tuple[int, int]:
        return max(int(places[0]) - MARGIN, 0), int(places[-1]) + K + MARGIN

    def of(key: int, partner: np.ndarray, at: np.ndarray, there: np.ndarray, out: list) -> None:
        made, edge = [], np.flatnonzero(partner[1:] != partner[:-1]) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(partner)]):
            if b - a < least:
                continue
            pairs = np.unique(at[a:b] << 32 | (1 << 32) - 1 - there[a:b])
            x, y = pairs >> 32, (1 << 32) - 1 - (pairs & (1 << 32) - 1)
            for members in chain(x.tolist(), y.tolist(), least):
                made.append((-len(members), int(partner[a]), x[members], y[members]))
        made.sort(key=lambda m: (m[1], m[0]))  # an earlier partner first
        taken = np.zeros(int(at.max()) + K + 1, bool)
        for n, other, x, y in made:
            if 5 * int(taken[x].sum()) < 4 * -n:
                taken[x[0] : x[-1] + K] = True
                out.append((key, other, np.stack((x, y), 1).astype(np.int32).tobytes(), *reach(x), *reach(y)))

    def flush(out: list) -> pa.RecordBatch:
        kinds = {"key": pa.int64(), "partner": pa.int64(), "anchors": pa.binary(), "low": pa.int32(), "high": pa.int32(), "base": pa.int32(), "top": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds.values())], [*kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, partner, at, there in _groups(batches, ("key", "partner", "at", "there")):
            out: list = []
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
                of(int(key[a]), partner[a:b], at[a:b], there[a:b], out)
            if out:
                yield flush(out)

    return matches.repartition("key").sortWithinPartitions("key", "partner").mapInArrow(run, "key long, partner long, anchors binary, low int, high int, base int, top int")


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns as 64-bit integers (binary ones as rows of bytes), cut only between different values of the first, by which they are sorted."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) if pa.types.is_binary(c.type) else c.to_numpy().astype(np.int64) for c in (batch.column(n) for n in names)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if (np.diff(held[0]) >= 0).all() else int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
            if cut:
                yield [c[:cut] for c in held]
                held = [c[cut:] for c in held]
        elif held is not None:
            yield held


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _similar(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two lists of shingles."""
    x, y = np.sort(a), np.sort(b)
    x, y = (v[np.append(True, v[1:] != v[:-1])] if len(v) else v for v in (x, y))
    z = np.sort(np.concatenate((x, y)))
    both = int((z[1:] == z[:-1]).sum())
    return both / max(len(x) + len(y) - both, 1)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """The number of equal words at the beginning."""
    n, step, at = min(len(a), len(b)), 32, 0
    while at < n:
        end = min(at + step, n)
        other = a[at:end] != b[at:end]
        if other.any():
            return at + int(other.argmax())
        at, step = end, 4 * step
    return n


_EDITS = ((1, 1), (1, 0), (0, 1), (2, 2), (3, 3), (2, 1), (1, 2), (2, 0), (0, 2), (4, 4))


def _grow(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal words from the beginning on, over up to four differing words in a row on a side if four equal ones follow."""
    runs, i, j = [], 0, 0
    while True:
        n = _agree(a[i:], b[j:])
        if n:
            runs.append((i, j, n))
        i, j = i + n, j + n
        for x, y in _EDITS:
            p, q = i + x, j + y
            if p + 4 <= len(a) and q + 4 <= len(b) and a[p] == b[q] and (a[p : p + 4] == b[q : q + 4]).all():
                i, j = p, q
                break
        else:
            return runs


def align(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]]) -> list[tuple[int, int, int, int, float]]:
    """Passages (first word and end in a, in b, similarity) of two word sequences that a chain of seeds connects."""
    x, y = anchors[0]
    runs = [(x - i - n, y - j - n, n) for i, j, n in _grow(a[:x][::-1], b[:y][::-1])][::-1]  # equal words: place in a, in b, number
    i, j = x, y
    for p, q in anchors:
        if p < i or q < j:  # within what has grown already, or out of step with it
            continue
        if p > i or q > j:
            matcher = SequenceMatcher(None, a[i:p].tolist(), b[j:q].tolist(), autojunk=False)
            runs += [(i + m.a, j + m.b, m.size) for m in matcher.get_matching_blocks() if m.size]
        n = _agree(a[p:], b[q:])
        if n:
            runs.append((p, q, n))
        i, j = p + n, q + n
    runs += [(i + p, j + q, n) for p, q, n in _grow(a[i:], b[j:])]
    found, left, shingles = [], [runs], None
    while left:
        part = left.pop()
        if not part:
            continue
        (a0, b0, _), (x, y, n) = part[0], part[-1]
        a1, b1 = x + n, y + n
        if min(a1 - a0, b1 - b0) < LEAST_WORDS:
            continue
        if len(part) > 1 and shingles is None:
            shingles = [_grams(T.mix(v.astype(np.uint64)), SHINGLE) for v in (a, b)]
        value = 1.0 if len(part) == 1 else _similar(shingles[0][a0 : a1 - SHINGLE + 1], shingles[1][b0 : b1 - SHINGLE + 1])
        if value >= SHARE:
            found.append((a0, a1, b0, b1, value))
        elif len(part) > 1:
            gaps = [max(part[t + 1][0] - part[t][0] - part[t][2], part[t + 1][1] - part[t][1] - part[t][2]) for t in range(len(part) - 1)]
            cut = int(np.argmax(gaps)) + 1
            left += [part[:cut], part[cut:]]
    return found


def _words_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, words): word hashes, 32 bits each, of at least the given documents."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap.of(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = bitmap.has(sent.value, batch.column("place").to_numpy())
            for part in T.slices(batch.filter(pa.array(wanted))):
                hashes, ranges = word_hashes(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), T.blobs((hashes >> np.uint64(32)).astype(np.uint32), ranges)], ["key", "words"])

    return docs.withColumn("place", bitmap.place("key")).mapInArrow(run, "key long, words binary")


def _aligned(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """(key, start, stop, partner, there, there_stop, similarity) of the passages of all chains, written. Only the words an alignment may use leave the joins:
    a batch of chains would hold a long document's words as often as it has chains."""
    keys = chains.select(F.explode(F.array("key", "partner")).alias("key"))
    words = kept(_words_of(docs, keys), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "start", "stop", "partner", "there", "there_stop", "similarity"]
        for batch in batches:
            out = []
            for key, partner, x, low, base, own, other in zip(*(batch.column(c) for c in ("key", "partner", "anchors", "low", "base", "own", "other"))):
                anchors = np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2).astype(np.int64)
                a, b = np.frombuffer(own.as_buffer(), np.uint32), np.frombuffer(other.as_buffer(), np.uint32)
                low, base = low.as_py(), base.as_py()
                for a0, a1, b0, b1, value in align(a, b, [(int(p) - low, int(q) - base) for p, q in anchors]):
                    out.append((key.as_py(), a0 + low, a1 + low, partner.as_py(), b0 + base, b1 + base, value))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for n, c in zip(names, zip(*out))], names)

    part = "substring(words, 4 * {0} + 1, 4 * ({1} - {0}))"  # ends with the words
    owner, holder = (words.select(F.col("key").alias(c), "words") for c in ("later", "partner"))  # alike, so the words are shuffled once for both joins
    mine = chains.withColumnRenamed("key", "later").join(owner, "later").select("later", "partner", "anchors", "low", "base", "top", F.expr(part.format("low", "high")).alias("own"))
    both = mine.join(holder, "partner").select(F.col("later").alias("key"), "partner", "anchors", "low", "base", "own", F.expr(part.format("base", "top")).alias("other"))
    passages = kept(both.mapInArrow(run, "key long, start long, stop long, partner long, there long, there_stop long, similarity double"), "passages")
    gone(words)
    return passages


def _by_key(points: DataFrame, found: DataFrame, of: Callable, schema: str) -> DataFrame:
    """of(key, starts, stops, at, seed) of each document's passages and points: places and a number each; starts and places ascend."""
    spans = found.select("key", F.lit(0).alias("kind"), F.col("start").alias("at"), F.col("stop").alias("other"))
    both = spans.unionByName(points.select("key", F.lit(1).alias("kind"), F.col("at").cast("long").alias("at"), F.col("seed").alias("other")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in _with_end(batches):
            new = [np.zeros(0, np.int64)] * 4 if batch is None else [batch.column(c).to_numpy().astype(np.int64) for c in ("key", "kind", "at", "other")]
            key, kind, at, other = columns = [np.concatenate(x) for x in zip(held, new)]
            if not len(key):
                continue
            bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), *([len(key)] if batch is None else [])]
            for a, b in zip(bounds, bounds[1:]):
                m = a + int(np.searchsorted(kind[a:b], 1))
                if m < b and (rows := of(int(key[a]), at[a:m], np.maximum.accumulate(other[a:m]), at[m:b], other[m:b])) is not None:
                    yield rows
            held = [c[bounds[-1] :] for c in columns]

    return both.repartition("key").sortWithinPartitions("key", "kind", "at").mapInArrow(run, schema)


def _outside(starts: np.ndarray, stops: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Whether at .. at + width is in none of the spans."""
    if not len(starts):
        return np.ones(len(at), bool)
    before = np.searchsorted(starts, at, "right") - 1
    return (before < 0) | (stops[np.maximum(before, 0)] < at + width)


def _uncovered(matches: DataFrame, found: DataFrame) -> DataFrame:
    """(seed, key, at): shared occurrences outside the passages found."""

    def of(key: int, starts: np.ndarray, stops: np.ndarray, at: np.ndarray, seed: np.ndarray) -> pa.RecordBatch | None:
        out = _outside(starts, stops, at, K)
        return pa.RecordBatch.from_arrays([pa.array(seed[out]), pa.array(np.full(int(out.sum()), key)), pa.array(at[out].astype(np.int32))], ["seed", "key", "at"]) if out.any() else None

    return _by_key(matches, found, of, "seed long, key long, at int")


def contexts(hashes: np.ndarray, ranges: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A byte a word (0 beyond the text) of CONTEXT words before each seed, its own, and CONTEXT after it: a row a seed."""
    word = (hashes >> np.uint64(56)).astype(np.uint8)
    word[word == 0] = 1
    place = at[:, None] + np.arange(-CONTEXT, K + CONTEXT)
    inside = (place >= 0) & (place < np.diff(ranges)[doc][:, None])
    return np.where(inside, word[np.where(inside, place + ranges[doc][:, None], 0)], np.uint8(0))


def _runs(q: np.ndarray, t: np.ndarray, shift: int) -> np.ndarray:
    """For each column (of words by pairs) the number of equal words from each place i of q and i + shift of t on."""
    n = len(q)
    out = np.zeros((n + 8, q.shape[1]), np.uint8)
    for i in range(n - 1, -1, -1):
        if 0 <= i + shift < n:
            np.multiply(out[i + 1] + np.uint8(1), (q[i] == t[i + shift]) & (q[i] != 0), out=out[i], casting="unsafe")
    return out


def _over_one_edit(q: np.ndarray, t: np.ndarray, first: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """The longest run of four equal words or more behind up to five differing ones on a side, after ``first`` equal ones."""
    best, column = np.zeros(len(first), np.int64), np.arange(len(first))
    for shift in range(-3, 4):
        runs = _runs(q, t, shift) if shift else plain
        for x in range(max(0, -shift), 6 - max(0, shift)):
            n = runs[np.minimum(first + x, len(runs) - 1), column].astype(np.int64)
            best = np.maximum(best, np.where(n >= 4, n, 0))
    return best


def agreement(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The words around each seed that agree over one edit on either side, of rows of contexts; 0 under EXACT equal ones in a row."""
    q, t = np.ascontiguousarray(q.T), np.ascontiguousarray(t.T)
    sides = [(q[CONTEXT + K :], t[CONTEXT + K :]), (q[:CONTEXT][::-1], t[:CONTEXT][::-1])]
    plain = [_runs(x, y, 0) for x, y in sides]
    first = [p[0].astype(np.int64) for p in plain]
    out = np.where(first[0] + first[1] + K >= EXACT, first[0] + first[1] + K, 0)
    use = np.flatnonzero(out)
    if len(use):
        for (x, y), p, f in zip(sides, plain, first):
            out[use] += _over_one_edit(x[:, use], y[:, use], f[use], p[:, use])
    return out


def _best(group: np.ndarray, key: np.ndarray, query: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, its best earlier row) by agreement, of whole groups sorted by group and key."""
    n = np.arange(len(group))
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    new_key = new_group | np.concatenate(([True], key[1:] != key[:-1]))
    low, high = (np.maximum.accumulate(np.where(x, n, 0)) for x in (new_group, new_key))
    rows = np.flatnonzero(query)
    best, partner = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    done, step = np.zeros(len(rows), np.int64), 64
    active = np.arange(len(rows))
    while True:
        active = active[(best[active] < SURE) & (low[rows[active]] + done[active] < high[rows[active]])]
        if not len(active):
            break
        begin = low[rows[active]] + done[active]
        size = np.minimum(high[rows[active]] - begin, step)
        for part in np.split(np.arange(len(active)), np.flatnonzero(np.diff(np.cumsum(size) // 16384)) + 1):
            own = np.repeat(active[part], size[part])
            other = T.ragged(begin[part], size[part])
            worth = agreement(context[rows[own]], context[other]) << 32 | (np.int64(1 << 32) - 1 - other)
            top = np.maximum.reduceat(worth, np.cumsum(size[part]) - size[part])
            better = (top >> 32) > best[active[part]]
            best[active[part][better]] = top[better] >> 32
            partner[active[part][better]] = (1 << 32) - 1 - (top[better] & ((1 << 32) - 1))
        done[active] += size
        step = 1024
    found = best >= NEAR
    return rows[found], partner[found]


def _held(docs: DataFrame, loose: DataFrame) -> DataFrame:
    """(seed, key, at, context, kind): all occurrences of at least the seeds of the loose ones; kind is the context's hash."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap.of(loose, "seed", hashed=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                hashes, ranges = word_hashes(part.column("text"))
                mers, doc, at = seeds(hashes, ranges)
                use = bitmap.has(sent.value, mers)
                mers, doc, at = mers[use], doc[use], at[use]
                for i in range(0, len(mers), 20_000):
                    m, d, p = (x[i : i + 20_000] for x in (mers, doc, at))
                    rows = contexts(hashes, ranges, d, p)
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), part.column("key").take(pa.array(d)), pa.array(p.astype(np.int32)), T.blobs(rows.ravel(), np.arange(len(rows) + 1) * rows.shape[1])], ["seed", "key", "at", "context"])

    return docs.mapInArrow(run, "seed long, key long, at int, context binary").withColumn("kind", F.xxhash64("context"))


def _grouped(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """At least the rows whose group has a size, so that few others are shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap.of(sizes, "group", hashed=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.has(sent.value, batch.column("group").to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def _wider(docs: DataFrame, loose: DataFrame) -> DataFrame:
    """(key, partner, at, there): each loose occurrence with the earlier one whose surroundings agree best, where a passage may be; written."""
    held = _held(docs, loose)  # read twice, from the texts: contexts are the most of all tables, and so stand on disk only once a class
    wanted = kept(held.select("seed", "kind", "key", "at").join(loose.select("seed", "key", "at").distinct(), ["seed", "key", "at"], "left_semi"), "wanted")
    first = held.groupBy("seed", "kind").agg(F.min(F.struct("key", "at", "context")).alias("first"))
    marks = wanted.select("seed", "kind").distinct().withColumn("open", F.lit(1))
    classes = kept(first.join(marks, ["seed", "kind"], "left").select("seed", "kind", "first.*", F.coalesce("open", F.lit(0)).alias("open")), "classes")
    sides = []
    for side, begin, outer in ((0, CONTEXT - 8, CONTEXT - 8), (1, CONTEXT + K, CONTEXT + K + 7)):
        whole = classes.where(F.expr(f"substring(context, {outer + 1}, 1) <> x'00'"))
        sides.append(whole.withColumn("group", F.xxhash64("seed", F.lit(side), F.expr(f"substring(context, {begin + 1}, 8)"))))
    rows = sides[0].unionByName(sides[1])
    sizes = kept(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any")).where("n > 1 and any = 1").select("group", F.ceil(F.col("n") / MOST).cast("int").alias("salts")), "sizes")
    dealt = _grouped(rows, sizes).join(sizes, "group").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = dealt.withColumn("query", F.when(F.col("salt") == F.pmod(F.xxhash64("kind"), "salts"), F.col("open")).otherwise(0)).withColumn("group", F.xxhash64("group", "salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, key, at, query, seed, kind, context in _groups(batches, ("group", "key", "at", "query", "seed", "kind", "context")):
            own, other = _best(group, key, query, context)
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seed[own], kind[own], key[other], at[other])], ["seed", "kind", "partner", "there"])

    best = dealt.repartition("group").sortWithinPartitions("group", "key", "at").select("group", "key", "at", "query", "seed", "kind", "context").mapInArrow(run, "seed long, kind long, partner long, there long")
    best = kept(best.groupBy("seed", "kind").agg(F.min(F.struct("partner", "there")).alias("best")), "best")
    gone(sizes)
    both = wanted.join(classes.select("seed", "kind", F.col("key").alias("first_key"), F.col("at").alias("first_at")), ["seed", "kind"]).join(best, ["seed", "kind"], "left")
    own = F.when(F.col("first_key") < F.col("key"), F.struct(F.col("first_key").alias("partner"), F.col("first_at").cast("long").alias("there"))).otherwise(F.col("best"))
    wider = kept(both.select("key", "at", own.alias("own")).where("own is not null").select("key", "own.partner", "at", "own.there"), "wider")
    gone(classes, wanted, best)
    return wider


def _united(passages: DataFrame) -> DataFrame:
    """Overlapping passages of a document as one; the source is the earliest one of those that begin first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "start", "stop", "partner", "there", "there_stop", "similarity"]
        now, done = None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for n, c in zip(names, zip(*done))], names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if now and now[0] == row[0] and row[1] < now[2]:
                    now[2] = max(now[2], row[2])
                    continue
                if now:
                    done.append(now)
                now = list(row)
            if done:
                yield flush()
                done.clear()
        if now:
            done.append(now)
            yield flush()

    dealt = passages.repartition("key").sortWithinPartitions("key", "start", "partner", "stop", "there")
    return dealt.mapInArrow(run, "key long, start long, stop long, partner long, there long, there_stop long, similarity double")


def _chosen(rows: DataFrame) -> DataFrame:
    """(key, text) of the keys that stand in several rows: the text that counts."""
    several = kept(rows.groupBy("key").count().where("count > 1").select("key"), "several")  # few as a rule: no text moves then
    best = rows.join(several, "key", "left_semi").groupBy("key").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("best"))
    chosen = kept(best.select("key", "best.text"), "chosen")
    gone(several)
    return chosen


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a passage that an earlier document has too: key, start, stop (words), partner, there, there_stop, similarity."""
    rows = _rows(docs, key, text)
    if not (chosen := _chosen(rows)).isEmpty():
        rows = rows.join(chosen.select("key"), "key", "left_anti").unionByName(chosen)
    matches = kept(_matches(_postings(rows)), "matches")
    chains = kept(_chains(matches), "chains")
    found = _aligned(rows, chains)
    loose = kept(_uncovered(matches, found), "loose")
    gone(chains, matches)
    if not loose.isEmpty():
        wider = _wider(rows, loose)
        chains = kept(_chains(wider, least=1), "more_chains")
        gone(wider)
        found = found.unionByName(_aligned(rows, chains))
        gone(chains)
    gone(loose, chosen)
    return _united(found)


def removed(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = None) -> DataFrame:
    """The documents without the passages' words: from each one's first byte up to the word after it. size: a column that holds the number of characters."""
    own_key, own_spans = fresh("_key", docs), fresh("_spans", docs)
    spans = passages.groupBy(F.col("key").alias(own_key)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(own_spans))
    joined = docs.join(spans, F.col(key).cast("long") == F.col(own_key), "left").drop(own_key)
    if not (chosen := _chosen(_rows(docs, key, text))).isEmpty():
        other_key, own_text = fresh("_key", joined), fresh("_text", joined)
        joined = joined.join(chosen.toDF(other_key, own_text), F.col(key).cast("long") == F.col(other_key), "left")
        joined = joined.withColumn(own_spans, F.when(F.col(own_text).isNull() | (F.col(own_text) == F.col(text)), F.col(own_spans)))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text):
                spans, column = part.column(own_spans).to_pylist(), part.column(text)
                if any(spans):
                    data, offsets = T.view(column)
                    first, _, ranges = T.words(data, offsets)
                    values, raw = column.to_pylist(), data.tobytes()
                    for d, own in enumerate(spans):
                        if own:
                            begin = [*first[ranges[d] : ranges[d + 1]].tolist(), int(offsets[d + 1])]
                            parts, at = [], int(offsets[d])
                            for s in own:
                                lo, hi = (begin[min(s[e], len(begin) - 1)] for e in ("start", "stop"))
                                parts.append(raw[at:lo])
                                at = max(at, hi)
                            values[d] = b"".join([*parts, raw[at : int(offsets[d + 1])]]).decode("utf-8")
                    column = pa.array(values, pa.string())
                yield pa.RecordBatch.from_arrays([column if c == text else part.column(c) for c in names], names)

    out = joined.select(*docs.columns, own_spans).mapInArrow(run, docs.schema)
    return out.withColumn(size, F.length(text).cast(docs.schema[size].dataType)) if size else out
