"""Look-up of one product by its key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantry.functions import nutrients
from pantry.plans.errors import CatalogError
from pantry.plans.requests import LookupRequest
from pantry.plans.schema import CatalogSpec


@dataclass
class LookupResult:
    barcode: str
    product: dict
    requested_fields: tuple[str, ...] | None = None


def point(products: DataFrame, key: str, column: str = "code") -> DataFrame:
    """The row with this key: an equality that reaches the scan."""
    return products.where(F.col(column) == key)


def lookup(products: DataFrame, request: LookupRequest, spec: CatalogSpec = CatalogSpec()) -> DataFrame:
    """barcode and the asked-for fields of the product; no row without a record."""
    return point(products, request.barcode, spec.key).select(F.col(spec.key).alias("barcode"), *nutrients.product(request.projection)).limit(1)


def present(value):
    """Without absent members, at every depth."""
    if isinstance(value, dict):
        return {k: present(v) for k, v in value.items() if v is not None}
    return [present(v) for v in value] if isinstance(value, list) else value


def get_product(products: DataFrame, request: LookupRequest, spec: CatalogSpec = CatalogSpec()) -> LookupResult:
    rows = lookup(products, request, spec).collect()
    if not rows:
        raise CatalogError("not_found", f"no product has the barcode {request.barcode}", barcode=request.barcode)
    product = present(rows[0].asDict(recursive=True))
    product.pop("barcode")
    return LookupResult(request.barcode, product, request.requested)
