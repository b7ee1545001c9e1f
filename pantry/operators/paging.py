"""Sort, page and count."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantry.plans.schema import COUNT_CEILING, RESULT_WINDOW


@dataclass(frozen=True)
class Total:
    count: int
    is_lower_bound: bool


def sorted_rows(df: DataFrame, by: str | None, key: str) -> DataFrame:
    """Largest first, absent last; the key settles ties and stands alone without a sort key."""
    return df.orderBy(F.desc_nulls_last(by), F.asc(key)) if by else df.orderBy(F.asc(key))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Rows of a 1-based page of a sorted table; plans to one top-k."""
    return df.offset((number - 1) * size).limit(size) if number > 1 else df.limit(size)


def exact_total(df: DataFrame) -> Total:
    return Total(df.count(), False)


def clipped_total(df: DataFrame, ceiling: int = COUNT_CEILING) -> Total:
    """Counts up to the ceiling and says whether there are more; exactly the ceiling is exact. Stops reading early."""
    n = df.limit(ceiling + 1).count()
    return Total(min(n, ceiling), n > ceiling)


def clipped_total_row(df: DataFrame, ceiling: int = COUNT_CEILING) -> DataFrame:
    """The same as a table of one row: total, total_is_lower_bound."""
    n = df.limit(ceiling + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(ceiling)).cast("long").alias("total"), (F.col("n") > ceiling).alias("total_is_lower_bound"))


def pages(total: int, size: int, text: bool) -> tuple[int, int]:
    """(all pages, pages that can be reached)."""
    every = math.ceil(total / size)
    return every, min(every, RESULT_WINDOW // size) if text else every
