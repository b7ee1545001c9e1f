"""Facet predicates. Each is an equality or a membership; all that are given hold together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pantry.functions.scalars import all_of
from pantry.plans.requests import SearchRequest
from pantry.plans.schema import CatalogSpec

#: request field to facet
TAG_FIELDS = {"categories_tag": "category", "brands_tag": "brand", "labels_tag": "label", "allergens_tag": "allergen", "additives_tag": "additive", "countries_tag": "country"}


def has_tag(column: str, tag: str) -> Column:
    """Exact membership. A row whose list is absent does not match."""
    return F.array_contains(F.col(column), tag)


def has_grade(column: str, grade: str) -> Column:
    return F.col(column) == grade


def has_nova(column: str, group: str) -> Column:
    return F.col(column) == int(group)


def predicates(request: SearchRequest, spec: CatalogSpec = CatalogSpec(), tags: bool = True) -> list[Column]:
    """The predicates of a request; tags=False leaves out those that a tag index answers."""
    out = []
    if request.nutrition_grade:
        out.append(has_grade(spec.grade, request.nutrition_grade))
    if request.nova_group:
        out.append(has_nova(spec.nova, request.nova_group))
    if tags:
        out += [has_tag(spec.tags[facet], request.tag(f)) for f, facet in TAG_FIELDS.items() if request.tag(f)]
    return out


def condition(request: SearchRequest, spec: CatalogSpec = CatalogSpec()) -> Column:
    return all_of(predicates(request, spec))
