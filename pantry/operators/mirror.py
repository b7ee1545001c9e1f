"""A local copy of a table: queries over it, and its upkeep from a stream of changes.

Every state of the copy is a folder of its own, and the cursor is written last, so a run that dies leaves the state
before it. Changes are read from the cursor on; a batch that was taken in already changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pantry.operators import text
from pantry.plans.errors import CatalogError
from pantry.plans.schema import CatalogSpec

_COMPARE = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def filtered(df: DataFrame, filters: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that pass all (column, operator, value): eq ne gt gte lt lte in."""
    for column, op, value in filters:
        c = F.col(column)
        if op == "in":
            df = df.where(c.isin(*value))  # type: ignore[misc]
        elif op in _COMPARE:
            df = df.where(getattr(c, _COMPARE[op])(F.lit(value)))
        else:
            raise CatalogError("invalid_input", f"no operator {op}", operator=op)
    return df


def selected(df: DataFrame, spec: CatalogSpec, match: str | None = None, filters: list[tuple[str, str, object]] | None = None, sort: str | None = None, descending: bool = False, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of rows: full text, filters, order by a column or by relevance, the key last. Nulls of the column come last."""
    rows = text.bm25(df, match, spec) if match else df
    rows = filtered(rows, filters or [])
    order = [F.asc(spec.key)]
    if sort:
        order.insert(0, F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort))
    elif match:
        order.insert(0, F.desc(F.round("score", 6)))
    return rows.orderBy(*order).limit(offset + limit).offset(offset)


def upserted(current: DataFrame, changes: DataFrame, key: str, version: str, deleted: str) -> DataFrame:
    """A mirror after a batch of changes: the latest change of a key wins, tombstones remove it, others stay.

    changes has the columns of current and ``deleted``. Of equal versions a change beats what is there.
    """
    both = current.withColumn(deleted, F.lit(False)).withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"), F.desc(deleted)))
    return both.withColumn("_rank", newest).where((F.col("_rank") == 1) & ~F.coalesce(F.col(deleted), F.lit(False))).select(*current.columns)


def state(spark: SparkSession, folder: str) -> tuple[int, int | None]:
    """(number of the last whole state, cursor); 0 and none before the first."""
    try:
        last = spark.read.schema("generation long, cursor long").parquet(f"{folder}/cursor").orderBy(F.desc("generation")).first()
    except AnalysisException:
        return 0, None
    return (last["generation"], last["cursor"]) if last else (0, None)


def read(spark: SparkSession, folder: str) -> DataFrame:
    generation, _ = state(spark, folder)
    if not generation:
        raise CatalogError("not_found", "the mirror has not been filled yet", folder=folder)
    return spark.read.parquet(f"{folder}/g{generation}")


def sync(spark: SparkSession, folder: str, changes: Callable[[int | None], DataFrame], key: str, version: str, deleted: str) -> tuple[int, int | None]:
    """Takes in all changes after the cursor; the new state. changes: gives the changes with a greater version than the cursor (all without one)."""
    generation, cursor = state(spark, folder)
    batch = changes(cursor)
    latest = batch.agg(F.max(version)).first()[0]
    if latest is None:
        return generation, cursor
    current = read(spark, folder) if generation else batch.drop(deleted).limit(0)
    generation += 1
    upserted(current, batch, key, version, deleted).write.mode("overwrite").parquet(f"{folder}/g{generation}")
    spark.createDataFrame([(generation, int(latest))], "generation long, cursor long").coalesce(1).write.mode("append").parquet(f"{folder}/cursor")
    return generation, int(latest)
