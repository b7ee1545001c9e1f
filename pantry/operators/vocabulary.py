"""Resolution of words to canonical tag identifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pantry.functions import scalars as S
from pantry.plans.requests import VocabularyRequest
from pantry.plans.schema import CLOSED_FACETS, MAX_SUGGESTIONS


@dataclass
class VocabularyResult:
    facet: str
    tags: list[dict]
    matched_in_facet: int
    total_in_facet: int | None = None
    notice: str | None = None
    truncated: bool = False
    shown: int | None = None
    cap: int | None = None


def matching(entries: DataFrame, term: str | None) -> DataFrame:
    """Entries whose id or name holds the term, case apart; the term is literal."""
    if term is None:
        return entries
    t = F.lit(term.lower())
    return entries.where(F.contains(F.lower("id"), t) | F.contains(F.lower("name"), t))


def complete(entries: DataFrame) -> DataFrame:
    """Without entries that lack an id or a name."""
    return entries.where(S.absent_if_empty(F.col("id")).isNotNull() & S.absent_if_empty(F.col("name")).isNotNull())


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """All entries of the first in their order, then those of the second with an id not met before."""
    both = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("facet", "id").orderBy("src", "ord"))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def new_entries(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entries of the second that the first lacks."""
    return second.join(first.select("facet", "id"), ["facet", "id"], "left_anti")


def limited(entries: DataFrame, limit: int) -> DataFrame:
    return entries.orderBy(*(["src", "ord", "id"] if "src" in entries.columns else ["ord", "id"])).limit(limit)


def probed(entries: DataFrame, limit: int) -> tuple[list, bool]:
    """The first entries and whether there are others, from one row more than asked for; MAX_SUGGESTIONS at most."""
    limit = min(limit, MAX_SUGGESTIONS)
    rows = limited(entries, limit + 1).collect()
    return rows[:limit], len(rows) > limit


def with_counts(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """Entries with the number of products of each. counts: (facet, tag, products)."""
    own = counts.select("facet", F.col("tag").alias("id"), F.col("products").alias("_n"))
    return entries.join(own, ["facet", "id"], "left").withColumn("products", F.coalesce("_n", "products")).drop("_n")


def browse(seed: DataFrame, request: VocabularyRequest, full=None) -> VocabularyResult:
    """full: the full vocabulary (a table, or a function that reads it); when it cannot be read the seed answers and a notice says so."""
    own = seed.where(F.col("facet") == request.facet)
    term, notice, total, shown, more = request.term, None, None, None, False
    if request.facet in CLOSED_FACETS:
        found, total = matching(own, term), own.count()
    elif term is None:
        found, notice = own, "This is a sample of the vocabulary; give a search term to look through all of it."
    else:
        found = matching(own, term)
        try:
            table = full() if callable(full) else full
            if table is not None:
                found = merged(found, matching(complete(table.where(F.col("facet") == request.facet)), term))
            shown, more = probed(found, request.limit)
        except (AnalysisException, OSError, RuntimeError) as e:
            found, notice = matching(own, term), f"The full vocabulary could not be read ({str(e).splitlines()[0][:120]}); these entries come from the sample."
    if shown is None:
        shown, more = probed(found, request.limit)
    matched = found.count() if more else len(shown)
    rows = [{k: v for k, v in r.asDict().items() if v is not None and k in ("id", "name", "products")} for r in shown]
    if not matched and notice is None:
        notice = f"No entry of {request.facet} holds “{term}”."
    result = VocabularyResult(request.facet, rows, matched, total, notice)
    if len(rows) < matched:
        result.truncated, result.shown, result.cap = True, len(rows), request.limit
        result.notice = " ".join(x for x in (notice, f"{len(rows)} of {matched} matching entries are shown; raise the limit or use a narrower term.") if x)
    return result
