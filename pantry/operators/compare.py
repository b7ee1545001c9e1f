"""Side-by-side rows of a small batch of keys, in the order asked for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantry.functions import nutrients
from pantry.functions import scalars as S
from pantry.plans.requests import CompareRequest
from pantry.plans.schema import CatalogSpec


LEAST_COMPLETE = 0.5


@dataclass
class CompareResult:
    products: list[dict]
    succeeded: int
    not_found: list[str]
    failed: list[dict] | None = None
    low_completeness: list[str] = field(default_factory=list)


def batch(products: DataFrame, keys: list[str], column: str = "code") -> DataFrame:
    """(pos, barcode, found, *columns): a row for each key given, in order, repeats and misses kept.

    The keys reach the scan as a set, so at most that many rows leave it; the ordered list keeps its side of the join.
    """
    asked = products.sparkSession.createDataFrame(list(enumerate(keys)), "pos long, barcode string")
    own = products.where(F.col(column).isin(sorted(set(keys))))
    joined = asked.join(own, F.col("barcode") == F.col(column), "left")
    rest = [c for c in products.columns if c not in (column, "pos", "barcode", "found")]
    return joined.select("pos", "barcode", F.col(column).isNotNull().alias("found"), *rest).orderBy("pos")


def compare_rows(products: DataFrame, keys: list[str], spec: CatalogSpec = CatalogSpec()) -> DataFrame:
    own = products.select(F.col(spec.key), *nutrients.compared())
    return batch(own, keys, spec.key)


def outcomes(products: DataFrame, keys: list[str], quarantine: DataFrame, column: str = "code") -> DataFrame:
    """(pos, barcode, outcome, reason, error): of each key, in order, whether it was found, not found, or could not be read."""
    bad = quarantine.where(F.col(column).isin(sorted(set(keys)))).groupBy(column).agg(F.min(F.struct("reason", "error")).alias("bad"))
    rows = batch(products.select(column), keys, column).join(bad.withColumnRenamed(column, "barcode"), "barcode", "left")
    outcome = F.when(F.col("bad").isNotNull(), "failed").when(F.col("found"), "found").otherwise("not_found")
    return rows.select("pos", "barcode", outcome.alias("outcome"), "bad.reason", S.sentence(F.col("bad.error")).alias("error")).orderBy("pos")


def sparse(rows: DataFrame, least: float = LEAST_COMPLETE) -> DataFrame:
    """Products of whose fields too many are missing."""
    return rows.where(F.col("completeness") < least)


def compare(products: DataFrame, request: CompareRequest, quarantine: DataFrame | None = None, spec: CatalogSpec = CatalogSpec()) -> CompareResult:
    """A key in the quarantine failed: it gets no row and does not count as missing."""
    failed = []
    if quarantine is not None:
        bad = {r[0]: (r[1], r[2]) for r in quarantine.where(F.col(spec.key).isin(sorted(set(request.barcodes)))).select(spec.key, "reason", "error").collect()}
        failed = [{"barcode": k, "reason": bad[k][0] or "upstream_error", "error": bad[k][1]} for k in request.barcodes if k in bad]
        keys = [k for k in request.barcodes if k not in bad]
    else:
        keys = list(request.barcodes)
    rows = [r.asDict() for r in compare_rows(products, keys, spec).collect()] if keys else []
    out = [{k: v for k, v in r.items() if v is not None and k != "pos"} for r in rows]
    found = [r for r in out if r["found"]]
    low = [r.get("product_name", r["barcode"]) for r in found if r.get("completeness") is not None and r["completeness"] < LEAST_COMPLETE]
    return CompareResult(out, len(found), [r["barcode"] for r in out if not r["found"]], failed or None, low)
