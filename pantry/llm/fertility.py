"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback measures each text: characters per token, the share of tokens that
are raw bytes, and the entropy of its tokens over the largest that so many tokens can have. Texts are
compared with those of their own script, language and size (SIZES classes, each twice the one before): a band is the
median of a measure, plus and minus ``reach`` robust standard deviations (the distance of the quartiles over 1.349; at
least SLACK, so that a group of near equal texts rejects none). A text outside any band is rejected. Texts that fail
the base rules are left out of the bands.

Every group has a band: to its texts' counts the counts of all languages of its script and size are added with the weight of PRIOR
texts, and to those in turn the counts of all scripts of that size. So a small group's band is near its script's, and no
number of texts switches a rule on or off.

The base rules: too few words, or most words in windows of three that are found again in the text.

Quantiles are exact over fixed bins (BINS), from whole numbers, so the same texts give the same bands however they are dealt out.
What is counted is a row a group, measure and bin, whatever the number of texts.

Nulls: a null text has no words and so fails the base rules; a null language is a group of its own. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantry.llm import stats
from pantry.llm import text as T
from pantry.llm import vocab
from pantry.llm.shared import kept

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
BROADCAST_GROUPS = 10_000  # bands of more groups are joined by a shuffle
SLACK = {"chars_per_token": 0.02, "byte_share": 0.02, "token_entropy": 0.01}
BINS = {"chars_per_token": 0.005, "byte_share": 0.002, "token_entropy": 0.002}  # the width of a bin; the last one, LAST_BIN, holds all above
LAST_BIN = 4000
SIZES = tuple(50 * 2**i for i in range(1, 8))  # words from which on the next class begins
PRIOR = 30  # texts that the wider group counts for
UNIT = 1 << 20  # weights are whole numbers of this part of a text

# Scripts by the first byte of a code point in UTF-8; bytes not named belong to none.
_RANGES = (("latin", 65, 91), ("latin", 97, 123), ("latin", 0xC3, 0xCA), ("greek", 0xCD, 0xD0), ("cyrillic", 0xD0, 0xD4), ("armenian", 0xD5, 0xD7), ("hebrew", 0xD7, 0xD8), ("arabic", 0xD8, 0xDC), ("indic", 0xE0, 0xE1), ("kana", 0xE3, 0xE4), ("han", 0xE4, 0xEA), ("hangul", 0xEA, 0xEE))
SCRIPTS = (*dict.fromkeys(x for x, _, _ in _RANGES), "none")
_SCRIPT_OF = np.full(256, len(SCRIPTS) - 1, np.int64)
for _name, _a, _b in _RANGES:
    _SCRIPT_OF[_a:_b] = SCRIPTS.index(_name)


def scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The script of most letters of each text; "none" without letters."""
    of = _SCRIPT_OF[data]
    counts = np.stack([T.sums((of == i).astype(np.int64), offsets) for i in range(len(SCRIPTS) - 1)], 1)
    best = np.where(counts.any(1), counts.argmax(1), len(SCRIPTS) - 1)
    return np.array(SCRIPTS, object)[best]


def measures(encoder: vocab.UnitEncoder, data: np.ndarray, offsets: np.ndarray, b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ids, ranges = encoder.encode(data, offsets)
    n = len(offsets) - 1
    made = np.maximum(np.diff(ranges), 1)
    doc = np.repeat(np.arange(n), np.diff(ranges))
    key, count = np.unique(doc * encoder.size + ids.astype(np.int64), return_counts=True)
    owner = key // encoder.size
    share = count / made[owner]
    entropy = np.bincount(owner, weights=-share * np.log(share), minlength=n)
    return {
        "chars_per_token": b["word_chars"] / made,
        "byte_share": T.sums(encoder.is_byte[ids].astype(np.int64), ranges) / made,
        "token_entropy": entropy / np.log(np.maximum(made, 2)),
    }


def measured(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """key, language, script, the base counts and the measures of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.piece_encoder(vocabulary)
        for batch in batches:
            for part in T.slices(batch):
                data, offsets = T.view(part.column("text"))
                b = stats.base(data, offsets)
                m = measures(encoder, data, offsets, b)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("language"), pa.array(scripts(data, offsets).tolist(), pa.string()), *[pa.array(b[x].astype(np.int64)) for x in BASE], *[pa.array(m[x].astype(np.float64)) for x in MEASURES]],
                    ["key", "language", "script", *BASE, *MEASURES],
                )

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(language).cast("string"), F.lit("und")).alias("language"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return kept(rows.mapInArrow(run, f"key {kind}, language string, script string, {', '.join(f'{x} long' for x in BASE)}, {', '.join(f'{x} double' for x in MEASURES)}"), "measured")


def size_class(n_words: str = "n_words") -> Column:
    return sum((F.col(n_words) >= n).cast("int") for n in SIZES)


def histogram(rows: DataFrame) -> DataFrame:
    """(script, language, size, measure, bin, n)."""
    bins = [F.struct(F.lit(m).alias("measure"), F.least(F.floor(F.col(m) / BINS[m]), F.lit(LAST_BIN)).cast("int").alias("bin")) for m in MEASURES]
    return rows.select("script", "language", "size", F.explode(F.array(*bins)).alias("of")).groupBy("script", "language", "size", "of.measure", "of.bin").agg(F.count(F.lit(1)).alias("n"))


def bands(counts: DataFrame, reach: float) -> DataFrame:
    """For each script, language and size of a histogram a low and a high bound of each measure."""
    group = ["script", "language", "size"]
    groups = counts.where(F.col("measure") == MEASURES[0]).groupBy(*group).agg(F.sum("n").alias("texts"))
    wide = counts.groupBy("script", "size", "measure", "bin").agg(F.sum("n").alias("n"))
    widest = counts.groupBy("size", "measure", "bin").agg(F.sum("n").alias("n"))
    wide_texts = groups.groupBy("script", "size").agg(F.sum("texts").alias("wide_texts"))
    widest_texts = groups.groupBy("size").agg(F.sum("texts").alias("widest_texts"))
    of = groups.join(wide_texts, ["script", "size"]).join(widest_texts, "size")
    out = [*group, "measure", "bin"]

    def units(weight: Column) -> Column:
        return F.floor(weight * UNIT).cast("long").alias("weight")

    own = counts.select(*out, (F.col("n") * UNIT).alias("weight"))
    second = of.join(wide, ["script", "size"]).select(*out, units(F.col("n") * PRIOR / (F.col("wide_texts") + PRIOR)))
    third = of.join(widest, "size").select(*out, units(F.col("n") * PRIOR / F.col("widest_texts") * PRIOR / (F.col("wide_texts") + PRIOR)))
    weights = own.unionByName(second).unionByName(third).groupBy(*out).agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy(*group, "measure")  # at most LAST_BIN + 1 rows
    summed = weights.withColumn("up_to", F.sum("weight").over(order.orderBy("bin"))).withColumn("all", F.sum("weight").over(order))
    quartiles = [F.min(F.when(4 * F.col("up_to") >= i * F.col("all"), F.col("bin"))).alias(f"q{i}") for i in (1, 2, 3)]
    made = summed.groupBy(*group, "measure").agg(*quartiles)
    bounds = []
    for m in MEASURES:
        half = F.greatest(F.lit(reach / 1.349 * BINS[m]) * (F.col("q3") - F.col("q1")), F.lit(SLACK[m]))
        middle = (F.col("q2") + 0.5) * BINS[m]
        bounds += [F.max(F.when(F.col("measure") == m, x)).alias(f"{m}_{e}") for x, e in ((middle - half, "low"), (middle + half, "high"))]
    return made.groupBy(*group).agg(*bounds)


def judged(rows: DataFrame, least_words: int = 50, most_repeated: int = 50, reach: float = 3.0) -> DataFrame:
    """``measured`` rows with base_failed, kept and the reasons of a rejection.

    most_repeated: largest share of repeated words, in hundredths.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    names = rows.columns
    rows = rows.withColumn("base_failed", failed).withColumn("size", size_class())
    counts = kept(histogram(rows.where(~F.col("base_failed"))), "histogram")
    made = kept(bands(counts, reach), "bands")
    if made.count() <= BROADCAST_GROUPS:
        made = F.broadcast(made)
    out = rows.join(made, ["script", "language", "size"], "left")
    outside = [F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in MEASURES]
    reasons = F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *outside))
    return out.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0).select(*names, "base_failed", "reasons", "kept")
