"""Free text: every word must occur; BM25 ranks.

Nothing is split into arrays: a token of the query is counted by a pattern, and so is a text's length, in generated code.
What is shuffled is one row of totals. The statistics of the whole corpus (documents, mean length, documents with each token)
are one aggregate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantry.functions import scalars as S
from pantry.plans.schema import CatalogSpec

K1, B = 1.2, 0.75


def terms(query: str) -> list[str]:
    """The distinct tokens of a query, in order."""
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


_LETTER = r"[\p{L}\p{N}]"


def _times(text: Column, term: str) -> Column:
    """How often a token stands in a lower-cased text. Most texts without it are passed by a plain search."""
    return F.when(F.contains(text, F.lit(term)), F.regexp_count(text, F.lit(rf"(?<!{_LETTER}){re.escape(term)}(?!{_LETTER})"))).otherwise(0)


def bm25(docs: DataFrame, query: str, spec: CatalogSpec, condition=None) -> DataFrame:
    """The rows that hold all terms, with their score. condition: a filter on rows; scores count all documents."""
    wanted = terms(query)
    if not wanted:
        return docs.where(F.lit(False)).withColumn("score", F.lit(None).cast("double"))
    low = F.lower(F.concat_ws(" ", *[F.col(c) for c in spec.text]))
    counted = docs.withColumn("_low", low)
    own = [_times(F.col("_low"), t) for t in wanted]
    counted = counted.select(*docs.columns, F.regexp_count("_low", F.lit(f"{_LETTER}+")).alias("_len"), *[c.alias(f"_tf{i}") for i, c in enumerate(own)])
    totals = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(wanted))])
    hits = counted.where(S.all_of([F.col(f"_tf{i}") > 0 for i in range(len(wanted))]))
    if condition is not None:
        hits = hits.where(condition)
    scored = hits.crossJoin(F.broadcast(totals))  # totals is one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.ln(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return scored.select(*docs.columns, score.alias("score"))


def postings(docs: DataFrame, spec: CatalogSpec) -> DataFrame:
    """(token, key, tf, len): the inverted index of a corpus, to be written sorted by token."""
    words = docs.select(F.col(spec.key).alias("key"), S.tokens(*[F.col(c) for c in spec.text]).alias("words"))
    each = words.select("key", F.size("words").alias("len"), F.explode("words").alias("token"))
    return each.groupBy("token", "key", "len").agg(F.count(F.lit(1)).alias("tf")).select("token", "key", "tf", "len")


def bm25_from_index(index: DataFrame, query: str, n: int, avg: float) -> DataFrame:
    """(key, score) from written postings: reads the query's tokens only."""
    wanted = terms(query)
    hits = index.where(F.col("token").isin(wanted))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg)))
    # df has a row a query term
    return hits.join(F.broadcast(df), "token").groupBy("key").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("found")).where(F.col("found") == len(wanted)).drop("found")
