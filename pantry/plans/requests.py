"""Requests, and the checks made before any plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pantry.plans.errors import CatalogError
from pantry.plans.schema import FACETS, GRADES, NOVA_GROUPS, PRODUCT_FIELDS, RESULT_WINDOW, SORT_KEYS

_BARCODE = re.compile(r"[0-9]{8,14}")


def stripped(value: str | None) -> str | None:
    """Without surrounding white space; blank is absent."""
    return (value or "").strip() or None


def _one_of(name: str, value: str | None, allowed: tuple[str, ...]) -> None:
    if value is not None and value not in allowed:
        raise CatalogError("invalid_input", f"{name} must be one of {', '.join(allowed)}", field=name, value=value)


def _within(name: str, value: int, low: int, high: int | None) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        raise CatalogError("invalid_input", f"{name} must be a whole number of at least {low}" + (f" and at most {high}" if high else ""), field=name, value=value)


def barcode(value: str) -> str:
    if not isinstance(value, str) or not _BARCODE.fullmatch(value):
        raise CatalogError("invalid_input", "a barcode is 8 to 14 digits", field="barcode", value=value)
    return value


@dataclass(frozen=True)
class LookupRequest:
    barcode: str
    fields: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        barcode(self.barcode)
        for f in self.fields:
            _one_of("fields", f, PRODUCT_FIELDS)

    @property
    def projection(self) -> tuple[str, ...]:
        """No fields asked for means all."""
        return self.fields or PRODUCT_FIELDS

    @property
    def requested(self) -> tuple[str, ...] | None:
        return self.fields or None


@dataclass(frozen=True)
class SearchRequest:
    query: str | None = None
    categories_tag: str | None = None
    brands_tag: str | None = None
    labels_tag: str | None = None
    allergens_tag: str | None = None
    additives_tag: str | None = None
    nutrition_grade: str | None = None
    nova_group: str | None = None
    countries_tag: str | None = None
    sort_by: str | None = None
    page: int = 1
    page_size: int = 20

    #: (field, word for it in a notice) in the order notices name them
    ECHO = (("query", "query"), ("categories_tag", "category"), ("brands_tag", "brand"), ("labels_tag", "label"), ("allergens_tag", "allergen"), ("additives_tag", "additive"), ("nutrition_grade", "nutriscore"), ("nova_group", "nova"), ("countries_tag", "country"))

    def __post_init__(self) -> None:
        _one_of("nutrition_grade", self.nutrition_grade, GRADES)
        _one_of("nova_group", self.nova_group, NOVA_GROUPS)
        _one_of("sort_by", self.sort_by, SORT_KEYS)
        _within("page", self.page, 1, None)
        _within("page_size", self.page_size, 1, 50)

    @property
    def text(self) -> str | None:
        return stripped(self.query)

    def tag(self, name: str) -> str | None:
        return stripped(getattr(self, name))

    def check(self) -> None:
        """The conditions that reject a search before it is planned."""
        if not any(stripped(getattr(self, name)) for name, _ in self.ECHO):
            raise CatalogError("no_filters", "a search needs a text or a filter")
        if self.text and self.tag("additives_tag"):
            raise CatalogError("additives_filter_needs_tag_search", "an additive filter and a search text do not combine", additives_tag=self.tag("additives_tag"))
        if self.text and self.page * self.page_size > RESULT_WINDOW:
            top = RESULT_WINDOW // self.page_size
            raise CatalogError("page_out_of_range", f"text search reaches {RESULT_WINDOW} results; with {self.page_size} a page the last page is {top}", page=self.page, page_size=self.page_size, max_page=top, result_window=RESULT_WINDOW)


@dataclass(frozen=True)
class CompareRequest:
    barcodes: tuple[str, ...]

    def __post_init__(self) -> None:
        _within("barcodes", len(self.barcodes), 2, 10)
        for b in self.barcodes:
            barcode(b)


@dataclass(frozen=True)
class VocabularyRequest:
    facet: str
    search: str | None = None
    limit: int = 20

    def __post_init__(self) -> None:
        _one_of("facet", self.facet, FACETS)
        _within("limit", self.limit, 1, 100)

    @property
    def term(self) -> str | None:
        return stripped(self.search)


def given(request: object) -> dict:
    """The members of a request that differ from their defaults."""
    return {f.name: getattr(request, f.name) for f in fields(request) if getattr(request, f.name) != f.default}  # type: ignore[arg-type]


__all__ = ["CompareRequest", "LookupRequest", "SearchRequest", "VocabularyRequest", "barcode", "given", "stripped"]
