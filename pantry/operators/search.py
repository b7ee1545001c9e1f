"""Search by facets, by text, or both."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantry.functions import scalars as S
from pantry.operators import facets, paging, text
from pantry.plans.requests import SearchRequest
from pantry.plans.schema import COUNT_CEILING, CatalogSpec
from pantry.sources import products as P


@dataclass
class SearchResult:
    products: list[dict]
    total: int
    total_is_lower_bound: bool
    page: int
    page_count: int
    page_size: int
    notice: str | None = None
    truncated: bool = False
    shown: int | None = None
    cap: int | None = None
    filters: dict[str, str] = field(default_factory=dict)


def matches(products: DataFrame, request: SearchRequest, spec: CatalogSpec = CatalogSpec(), index: DataFrame | None = None) -> DataFrame:
    """All matching rows, lazily; with a score when the request has a text. index: a tag index to use in place of scans of tag lists."""
    request.check()
    if request.text:
        return text.bm25(products, request.text, spec, facets.condition(request, spec))
    if index is not None:
        products = P.by_tags(products, index, {facet: request.tag(f) for f, facet in facets.TAG_FIELDS.items() if request.tag(f)}, spec)
        return products.where(S.all_of(facets.predicates(request, spec, tags=False)))
    return products.where(facets.condition(request, spec))


def ordered(found: DataFrame, request: SearchRequest, spec: CatalogSpec = CatalogSpec()) -> DataFrame:
    """Relevance with a text (a sort key is ignored then), else the sort key."""
    if request.text:
        return found.orderBy(F.desc(F.round("score", 6)), F.asc(spec.key))
    return paging.sorted_rows(found, request.sort_by, spec.key)


def summary(rows: DataFrame, spec: CatalogSpec = CatalogSpec()) -> DataFrame:
    """The columns a search returns; the key as barcode, empty text absent, tag lists as they are."""
    have = [c for c in spec.summary if c in rows.columns]
    kinds = dict(rows.dtypes)
    plain = [S.absent_if_empty(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in have]
    return rows.select(F.coalesce(F.col(spec.key), F.lit("")).alias("barcode"), *plain)


def page_of(products: DataFrame, request: SearchRequest, spec: CatalogSpec = CatalogSpec(), index: DataFrame | None = None) -> DataFrame:
    """One page as a lazy table."""
    return summary(paging.page(ordered(matches(products, request, spec, index), request, spec), request.page, request.page_size), spec)


def search(products: DataFrame, request: SearchRequest, spec: CatalogSpec = CatalogSpec(), index: DataFrame | None = None, ceiling: int = COUNT_CEILING) -> SearchResult:
    found = matches(products, request, spec, index)
    total = paging.clipped_total(found, ceiling) if request.text else paging.exact_total(found)
    rows = [r.asDict(recursive=True) for r in summary(paging.page(ordered(found, request, spec), request.page, request.page_size), spec).collect()]
    rows = [{k: v for k, v in r.items() if v is not None} for r in rows]
    result = SearchResult(rows, total.count, total.is_lower_bound, request.page, len(rows), request.page_size, filters={word: getattr(request, name) for name, word in request.ECHO if getattr(request, name)})
    return _explained(result, bool(request.text))


def _explained(r: SearchResult, has_text: bool) -> SearchResult:
    """Says what was searched when nothing came back, and what is left when a page does not hold all."""
    if not r.products:
        r.notice = "Nothing found for " + ", ".join(f"{word}: {value}" for word, value in r.filters.items()) + "."
    elif r.total > r.page_count:
        every, reachable = paging.pages(r.total, r.page_size, has_text)
        if r.total_is_lower_bound:
            position = f"Page {r.page} of {reachable} that can be reached; more matches exist."
        elif reachable < every:
            position = f"Page {r.page} of {reachable} that can be reached ({every} in all)."
        else:
            position = f"Page {r.page} of {every}."
        if r.page >= reachable:
            step = "Add filters to see other matches." if has_text else "There are no further pages."
        else:
            step = "Ask for the next page." if has_text else "Ask for the next page, or narrow the filters."
        r.truncated, r.shown, r.cap, r.notice = True, r.page_count, r.page_size, f"{position} {step}"
    return r
