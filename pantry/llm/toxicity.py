"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and taken as the set of its distinct letter runs; its features are the character
n-grams (orders 3 to 5, with word edges) of that set, hashed to 2**18 columns. Each column is multiplied by
its log-count ratio r = log((a + p) / |a + p|) - log((a + q) / |a + q|), p and q being the numbers of toxic
and other training texts that have it, and divided by a root of the number of distinct words. Logistic
regression with an L2 penalty is fitted on that, both classes weighing the same. Words score as a whole (the
sum of their n-grams' weights), so a text costs one look-up a distinct word.

Training takes a bounded sample of the labelled rows: up to ``per_class`` texts of each label (twice as
many of label 0), those with the smallest hash of their key. Scoring covers every whole text.

Nulls: a null or wordless text is scored by the intercept; null labels or keys are not learned from. Labels
that contradict each other for a key count as toxic. Without labels of both kinds all scores are 0.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pantry.llm import grams
from pantry.llm import text as T
from pantry.llm.shared import fresh

ORDERS, BITS = (3, 4, 5), 18


@dataclass
class Model:
    weights: np.ndarray  # float32, a column each
    bias: float
    power: float


def _columns(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of all n-grams of the words, and the range of each word."""
    parts = grams.ngrams(data, first, end, ORDERS)
    counts = sum(np.diff(r) for _, r in parts)
    ranges = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(int(ranges[-1]), np.int32)
    at = ranges[:-1].copy()
    for hashes, own in parts:
        n = np.diff(own)
        out[T.ragged(at, n)] = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
        at += n
    return out, ranges


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (text, column, count) of each column of each text, and the number of distinct words by text."""
    first, end, ranges = grams.letter_runs(data, offsets)
    _, place, back = grams.distinct_words(data, first, end)
    doc, word, _ = grams.by_text(back, ranges, len(place))
    columns, own = _columns(data, first[place], end[place])
    n = np.diff(own)[word]
    key, count = np.unique(np.repeat(doc, n) << BITS | columns[T.ragged(own[:-1][word], n)], return_counts=True)
    return key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int32), count, np.bincount(doc, minlength=len(offsets) - 1)


def fit(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, penalty: float = 1e-4, steps: int = 200, smooth: float = 6.0, least: float = 0.5, power: float = 0.25) -> Model:
    """docs: as ``features`` gives them, for consecutive texts; labels: 0 or 1 of all of them.

    smooth: texts added to each column, dealt to the classes by their sizes, so that a rare column's ratio is
    near 0. Columns with a ratio under ``least`` get no weight.
    """
    sizes = [len(x[3]) for x in docs]
    y, width = labels.astype(np.float64), 1 << BITS
    at = np.cumsum([0, *sizes])
    toxic, seen = np.zeros(width), np.zeros(width)
    for x, b in zip(docs, at):
        toxic += np.bincount(x[1], weights=y[b + x[0]], minlength=width)
        seen += np.bincount(x[1], minlength=width)
    rate = y.mean()
    ratio = np.log((toxic + smooth * rate) / (seen - toxic + smooth * (1 - rate))) - np.log(rate / (1 - rate))
    ratio[np.abs(ratio) < least] = 0
    used = [ratio[x[1]] != 0 for x in docs]
    row = np.concatenate([(x[0] + b)[u] for x, b, u in zip(docs, at, used)])
    column = np.concatenate([x[1][u] for x, u in zip(docs, used)])
    n_words = np.concatenate([x[3] for x in docs])
    names, column = np.unique(column, return_inverse=True)
    value = ratio[names][column] * np.concatenate([x[2][u] for x, u in zip(docs, used)]) / (np.maximum(n_words, 1) ** power)[row]
    square = np.bincount(row, weights=value**2, minlength=len(y))
    norm = np.sqrt(square.mean()) or 1.0
    value /= norm
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    pace = 4.0 / (1 + (weight * square).sum() / norm**2)
    w, b, mw, mb = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0
    for step in range(steps):
        momentum = step / (step + 3)
        look, ahead = w + momentum * mw, b + momentum * mb
        z = np.bincount(row, weights=value * look[column], minlength=len(y)) + ahead
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.bincount(column, weights=value * slope[row], minlength=len(names)) + penalty * look
        w, b, old_w, old_b = look - pace * gradient, ahead - pace * slope.sum(), w, b
        mw, mb = w - old_w, b - old_b
    weights = np.zeros(width, np.float32)
    weights[names] = w * ratio[names] / norm
    return Model(weights, float(b), power)


def score(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text."""
    first, end, ranges = grams.letter_runs(data, offsets)
    _, place, back = grams.distinct_words(data, first, end)
    doc, word, _ = grams.by_text(back, ranges, len(place))
    columns, own = _columns(data, first[place], end[place])
    worth = T.sums(model.weights[columns].astype(np.float64), own)
    n = len(offsets) - 1
    z = np.bincount(doc, weights=worth[word], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1) ** model.power + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled(labels: DataFrame, label: str, learn: Column | None, key: str = "doc_id") -> DataFrame:
    """(key, y): one row a key that is learned from."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    return (rows.where(learn) if learn is not None else rows).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, key: str = "doc_id", text: str = "text", per_class: int = 1500) -> Model | None:
    """learn: which rows of labels may be learned from.

    The fit runs in one task on at most 3 * per_class texts. That task gets columns and counts, at most 2**BITS of each a text,
    which the tasks before it have taken from the texts, so its memory does not grow with a text's length.
    """
    known = labelled(labels, label, learn, key)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(per_class * (2 - y)) for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")).join(F.broadcast(sample), "key")
    rows = rows.groupBy("key").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # a key that many rows have counts once

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                doc, column, count, n_words = features(*T.view(part.column("text")))
                ranges = np.searchsorted(doc, np.arange(len(n_words) + 1))
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("y"), pa.array(n_words), T.blobs(column, ranges), T.blobs(count.astype(np.int32), ranges)], ["place", "y", "n_words", "columns", "counts"])

    def learn_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, y = [], []
        for batch in batches:
            columns, counts = ([np.frombuffer(x, np.int32) for x in batch.column(c).to_pylist()] for c in ("columns", "counts"))
            if columns:
                doc = np.repeat(np.arange(len(columns)), [len(x) for x in columns])
                found.append((doc, np.concatenate(columns), np.concatenate(counts), batch.column("n_words").to_numpy()))
                y.append(batch.column("y").to_numpy())
        if found:
            model = fit(found, np.concatenate(y))
            yield pa.RecordBatch.from_pydict({"bias": [model.bias], "power": [model.power], "weights": [model.weights.tobytes()]})

    sparse = rows.select(F.xxhash64("key").alias("place"), "text", "y").mapInArrow(reduced, "place long, y int, n_words long, columns binary, counts binary")
    made = sparse.repartition(1).sortWithinPartitions("place").mapInArrow(learn_one, "bias double, power double, weights binary").collect()
    return Model(np.frombuffer(bytes(made[0]["weights"]), np.float32), made[0]["bias"], made[0]["power"]) if made else None


def scored(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with one more column, the score; a column of the caller's with that name is replaced (give another ``name``)."""
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lowered = fresh("_lowered_text", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, lowered):
                values = score(sent.value, *T.view(part.column(lowered)))
                rest = part.select([c for c in part.schema.names if c != lowered])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(values)], [*rest.schema.names, name])

    return docs.withColumn(lowered, F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))).mapInArrow(run, schema)
