"""Language identification by words first, then by ever shorter character n-grams.

A text is lower-cased and cut into runs of letters. A word of the table adds, for each language, the log of
its frequency there. For a word that is not in the table the longest order (4, 3, 2, 1) of which any n-gram
of the word is known is used (by its full hash): the mean over its known n-grams of their log frequency by language. The
language with the largest sum wins; the score is its posterior after dividing the sums by a power of the
number of words, so that long texts do not all score 1.

The model comes from a bounded sample: of each language the ``per_language`` texts with the smallest hash
of their key. The words and n-grams of the sample are counted in the cluster, each under its full 64-bit hash. Of each
language the ``most_words`` most frequent words and the ``most_grams`` most frequent n-grams of each order are learned
(those seen once are left out but for a language's last resort, its single characters), so what reaches the driver is bounded for each language by
these parameters, and no language takes room from another. All languages are learned, however many there are.

Nulls: a null text, or one without any letter, is ``und`` with score 0. Null languages are not learned from;
with no language at all every text is ``und``. A text whose words are all unknown to every order gets the
language with most texts. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pantry.llm import grams
from pantry.llm import text as T
from pantry.llm.shared import fresh, kept

ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"


@dataclass
class Table:
    """Log frequencies of hashed words, or n-grams of one order, by language; only pairs that were seen are held."""

    hashes: np.ndarray  # sorted
    starts: np.ndarray  # where the pairs of each begin, and their end
    owner: np.ndarray  # the language of each pair
    logs: np.ndarray  # and its log frequency there
    unseen: np.ndarray  # by language, that of one which it does not have

    @classmethod
    def of(cls, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], totals: np.ndarray, smooth: float) -> "Table":
        """pairs: (hash, language, times); totals: of each language, all occurrences."""
        order = np.lexsort((pairs[1], pairs[0]))
        hashes, own, times = (x[order] for x in pairs)
        known, starts = np.unique(hashes, return_index=True)
        room = totals + smooth * max(len(known), 1)
        return cls(known, np.append(starts, len(hashes)), own.astype(np.int32), np.log((times + smooth) / room[own]).astype(np.float32), np.log(smooth / room).astype(np.float32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for those unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, out: np.ndarray, target: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> None:
        """Adds to each target row of ``out`` the weighted logs of a row of the table."""
        np.add.at(out, target, weight[:, None] * self.unseen)
        n = self.starts[rows + 1] - self.starts[rows]
        pair = T.ragged(self.starts[rows], n)
        np.add.at(out, (np.repeat(target, n), self.owner[pair]), np.repeat(weight, n) * (self.logs[pair] - self.unseen[self.owner[pair]]))


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: dict[int, Table]  # by order
    prior: np.ndarray


def counted_grams(words: pa.RecordBatch) -> pa.RecordBatch:
    """(language, kind, h, n): of words (language, word, h, n) the words, as kind 0, and their n-grams by order."""
    data, offsets = T.view(words.column("word"))
    times = words.column("n").to_numpy()
    names, owner = np.unique(np.array(words.column("language").to_pylist(), object).astype(str), return_inverse=True)
    made = [(owner, np.zeros(len(owner), np.int64), words.column("h").to_numpy(), times)]
    for k, (found, own) in zip(ORDERS, grams.ngrams(data, offsets[:-1], offsets[1:], ORDERS)):
        which = np.repeat(np.arange(words.num_rows), np.diff(own))
        order = np.lexsort((found, owner[which]))
        o, h, n = owner[which][order], found[order], times[which][order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))) if len(h) else np.zeros(0, np.int64)
        made.append((o[new], np.full(len(new), k), h[new].view(np.int64), np.add.reduceat(n, new) if len(new) else n))
    o, kind, h, n = (np.concatenate(x) for x in zip(*made))
    return pa.RecordBatch.from_arrays([pa.array(names[o].tolist(), pa.string()), pa.array(kind), pa.array(h), pa.array(n)], ["language", "kind", "h", "n"])


def assembled(shares: dict[str, int], totals: dict[tuple[str, int], float], rows: pa.Table, smooth: float = 0.5) -> Model:
    """shares: texts of each language; totals: occurrences by language and kind; rows: (language, kind, h, n), what is learned."""
    languages = sorted(shares)
    index = {x: i for i, x in enumerate(languages)}
    own = np.array([index[x] for x in rows.column("language").to_pylist()], np.int64)
    kind, h, n = (rows.column(c).to_numpy() for c in ("kind", "h", "n"))
    tables = []
    for k in (0, *ORDERS):
        use = kind == k
        tables.append(Table.of((h[use].view(np.uint64), own[use], n[use]), np.array([max(totals.get((x, k), 0), 1) for x in languages], np.float64), smooth))
    prior = np.log(np.array([shares[x] for x in languages]) / sum(shares.values()))
    return Model(languages, tables[0], dict(zip(ORDERS, tables[1:])), prior)


def fit(counts: list[tuple[str, str, int]], shares: dict[str, int], smooth: float = 0.5) -> Model | None:
    """The model of a few words, without Spark. counts: (language, word, times); shares: texts of each language."""
    if not shares or not counts:
        return None
    words = pa.array([w for _, w, _ in counts], pa.string())
    data, offsets = T.view(words)
    hashes = T.span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in counts]), words, pa.array(hashes), pa.array([n for _, _, n in counts], pa.int64())], ["language", "word", "h", "n"])
    rows = pa.Table.from_batches([counted_grams(batch)])
    sums = rows.group_by(["language", "kind"]).aggregate([("n", "sum")]).to_pylist()
    return assembled(shares, {(r["language"], r["kind"]): r["n_sum"] for r in sums}, rows, smooth)


def word_scores(model: Model, hashes: np.ndarray, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log frequencies of distinct words, a column a language; zeros for a word of which nothing is known."""
    out = np.zeros((len(hashes), len(model.languages)), np.float64)
    at = model.words.find(hashes)
    hit = np.flatnonzero(at >= 0)
    model.words.add(out, hit, at[hit], np.ones(len(hit)))
    left = np.flatnonzero(at < 0)
    for k in reversed(ORDERS):
        if not len(left):
            break
        ((found, own),) = grams.ngrams(data, first[left], end[left], (k,))
        at = model.grams[k].find(found)
        use = at >= 0
        which = np.repeat(np.arange(len(left)), np.diff(own))[use]
        n = np.bincount(which, minlength=len(left))
        model.grams[k].add(out, left[which], at[use], 1 / n[which])
        left = left[n == 0]
    return out


def predict(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; the texts are lower-cased already."""
    n = len(offsets) - 1
    first, end, ranges = grams.letter_runs(data, offsets)
    lettered = np.diff(ranges) > 0
    doubtful = np.flatnonzero(lettered & (T.sums(((data | 32) - 97 < 26).astype(np.int64), offsets) == 0))
    for i in doubtful.tolist():  # only non-ASCII bytes: are any of them letters?
        lettered[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    if model is None:
        return [UNKNOWN] * n, np.zeros(n)
    hashes, place, back = grams.distinct_words(data, first, end)
    logs = word_scores(model, hashes, data, first[place], end[place])
    doc, word, times = grams.by_text(back, ranges, len(place))
    size = np.maximum(np.diff(ranges), 1)[:, None]
    total = np.stack([np.bincount(doc, weights=logs[word, i] * times, minlength=n) for i in range(len(model.languages))], 1)
    z = total / size**0.75 + 0.01 * model.prior
    z = np.exp(z - z.max(1, keepdims=True))
    best = z.argmax(1)
    score = z[np.arange(n), best] / z.sum(1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, score, 0.0)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", per_language: int = 2000, most_words: int = 200_000, most_grams: int = 50_000) -> Model | None:
    """docs: the rows that may be learned from."""
    rows = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).alias("key"), F.col(language).alias("language"))
    shares = {r["language"]: r["count"] for r in rows.groupBy("language").count().collect()}
    if not shares:
        return None
    # The n smallest hashes of each language, first within each of a number of salts, so no task holds a language.
    salted = rows.withColumn("salt", F.pmod(F.col("h"), F.lit(64)))
    near = salted.withColumn("r", F.row_number().over(Window.partitionBy("language", "salt").orderBy("h", "key"))).where(F.col("r") <= per_language)
    sample = near.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy("h", "key"))).where(F.col("r") <= per_language).select("key", F.col("language").alias("own"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(language).alias("own"), F.lower(text).alias("text")).join(F.broadcast(sample.distinct()), ["key", "own"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                data, offsets = T.view(part.column("text"))
                first, end, ranges = grams.letter_runs(data, offsets)
                hashes, place, back = grams.distinct_words(data, first, end)
                names, owner = np.unique(np.array(part.column("own").to_pylist(), object).astype(str), return_inverse=True)
                of_word = np.repeat(owner, np.diff(ranges))
                key, times = np.unique(of_word * max(len(place), 1) + back, return_counts=True)
                raw = data.tobytes()
                word = [raw[first[p] : end[p]].decode("utf-8", "replace") for p in place[key % max(len(place), 1)].tolist()]
                yield pa.RecordBatch.from_pydict({"language": names[key // max(len(place), 1)].tolist(), "word": word, "h": hashes[key % max(len(place), 1)].view(np.int64), "n": times.astype(np.int64)}, schema=pa.schema([("language", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (counted_grams(batch) for batch in batches if batch.num_rows)

    words = texts.select("own", "text").mapInArrow(count, "language string, word string, h long, n long").groupBy("language", "word", "h").agg(F.sum("n").alias("n"))
    counted = kept(words.mapInArrow(sums, "language string, kind long, h long, n long").groupBy("language", "kind", "h").agg(F.sum("n").alias("n")), "counted")
    totals = {(r["language"], r["kind"]): float(r["n"]) for r in counted.groupBy("language", "kind").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    # A sample's words and n-grams are bounded by its texts, so the ranking of a language is too.
    rank = F.row_number().over(Window.partitionBy("language", "kind").orderBy(F.desc("n"), "h"))
    most = F.when(F.col("kind") == 0, most_words).otherwise(most_grams)
    learned = counted.where("n > 1 or kind = 1").withColumn("r", rank).where(F.col("r") <= most).select("language", "kind", "h", "n").toArrow()
    return assembled(shares, totals, learned)


def identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows with lang_pred and score; columns of the caller's with these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    sent, lowered = docs.sparkSession.sparkContext.broadcast(model), fresh("_lowered_text", docs)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, lowered):
                names, score = predict(sent.value, *T.view(part.column(lowered)))
                rest = part.select([c for c in part.schema.names if c != lowered])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(names, pa.string()), pa.array(score)], [*rest.schema.names, "lang_pred", "score"])

    return docs.withColumn(lowered, F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))).mapInArrow(run, schema)
