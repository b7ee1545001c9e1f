"""Search: guards, facets, text, totals, paging, what a result says about itself."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pantry.operators import facets, paging, search
from pantry.operators import text as X
from pantry.operators.search import SearchResult, _explained
from pantry.plans.engine import to_text
from pantry.plans.errors import CatalogError
from pantry.plans.requests import SearchRequest
from pantry.plans.schema import CatalogSpec
from pantry.sources import products as P

SPEC = CatalogSpec()
SCHEMA = "code string, product_name string, brands string, ingredients_text string, nutriscore_grade string, nova_group int, ecoscore_grade string, categories_tags array<string>, brands_tags array<string>, labels_tags array<string>, allergens_tags array<string>, additives_tags array<string>, countries_tags array<string>, unique_scans_n long"


@pytest.fixture(scope="module")
def products(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        rows.append((f"{i:08d}", "Dark chocolate" if i % 3 == 0 else "Milk drink" if i % 3 == 1 else "", f"Brand {i % 4}", "cocoa, sugar chocolate" if i % 6 == 0 else None, "abcde"[i % 5] if i % 7 else None, i % 4 + 1 if i % 5 else None, None, None if i % 11 == 0 else ["en:spreads", f"en:c{i % 3}"], [f"brand-{i % 4}"], ["en:organic"] if i % 2 else [], ["en:milk"] if i % 3 == 1 else None, ["en:e322"] if i % 4 == 1 else None, ["en:france"], r.randrange(5) if i % 9 else None))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("request_", [{}, {"query": "  ", "brands_tag": "\t"}, {"sort_by": "created_t", "page": 3}])
def test_no_filters(request_):
    with pytest.raises(CatalogError) as e:
        SearchRequest(**request_).check()
    assert e.value.reason == "no_filters"


def test_window():
    with pytest.raises(CatalogError) as e:
        SearchRequest(query="x", page=5001, page_size=2).check()
    assert e.value.data == {"page": 5001, "page_size": 2, "max_page": 5000, "result_window": 10_000}
    with pytest.raises(CatalogError) as e:
        SearchRequest(query="x", page=900, page_size=50).check()
    assert e.value.data["max_page"] == 200 and "200" in e.value.message
    SearchRequest(query="x", page=5000, page_size=2).check()
    SearchRequest(categories_tag="en:x", page=5001, page_size=2).check()


def test_additive_and_text():
    with pytest.raises(CatalogError) as e:
        SearchRequest(query="x", additives_tag=" en:e322 ").check()
    assert e.value.reason == "additives_filter_needs_tag_search" and e.value.retryable is False
    SearchRequest(query="x", additives_tag="  ").check()


@pytest.mark.parametrize("bad", [{"nutrition_grade": "f"}, {"nova_group": "5"}, {"page": 0}, {"page_size": 51}, {"page_size": True}, {"sort_by": "name"}])
def test_domains(bad):
    with pytest.raises(CatalogError) as e:
        SearchRequest(categories_tag="x", **bad)
    assert e.value.reason == "invalid_input"


def keys(rows):
    return {r["code"] for r in rows.collect()}


def test_facets_match_rows_and_index(products):
    index = P.tag_index(products)
    for request in ({"categories_tag": " en:spreads "}, {"allergens_tag": "en:milk", "additives_tag": "en:e322"}, {"labels_tag": "en:organic", "nova_group": "3"}, {"nutrition_grade": "b", "brands_tag": "brand-1", "countries_tag": "en:france"}, {"categories_tag": "en:none"}):
        asked = SearchRequest(**request)
        plain = keys(search.matches(products, asked))
        assert plain == keys(search.matches(products, asked, index=index))
        rows = [r for r in products.collect() if all(asked.tag(f) in (r[SPEC.tags[t]] or []) for f, t in facets.TAG_FIELDS.items() if asked.tag(f))]
        assert plain == {r["code"] for r in rows if (not asked.nutrition_grade or r["nutriscore_grade"] == asked.nutrition_grade) and (not asked.nova_group or r["nova_group"] == int(asked.nova_group))}


def test_text_ranks_and_facets_restrict(products):
    r = search.search(products, SearchRequest(query="chocolate DARK", page_size=50))
    assert r.total == 20 and all(p["product_name"] == "Dark chocolate" for p in r.products)
    first = [p["barcode"] for p in r.products]
    both = search.search(products, SearchRequest(query="dark chocolate", labels_tag="en:organic", countries_tag="en:france", sort_by="unique_scans_n", page_size=50))
    assert [p["barcode"] for p in both.products] == [b for b in first if int(b) % 2]
    assert search.search(products, SearchRequest(query="brands: brand")).total == 0  # literal text, and "brands" occurs nowhere
    assert search.search(products, SearchRequest(query="!!!")).total == 0
    assert X.terms("from, of! FROM a_b") == ["from", "of", "a", "b"]


def test_sparse_rows(products):
    r = search.search(products, SearchRequest(brands_tag="brand-0", page_size=50))
    assert {"barcode", "brands"} <= set(r.products[0]) and all(None not in p.values() for p in r.products)
    assert any("product_name" not in p for p in r.products)


@pytest.mark.parametrize("size", [7, 20])
def test_pages_cover_the_result_once(products, size):
    request = dict(countries_tag="en:france", sort_by="unique_scans_n", page_size=size)
    got, scans = [], {r["code"]: r["unique_scans_n"] for r in products.collect()}
    for page in range(1, 60 // size + 3):
        got += [p["barcode"] for p in search.search(products, SearchRequest(page=page, **request)).products]
    assert got == sorted(scans, key=lambda k: (scans[k] is None, -(scans[k] or 0), k))


def test_paging_plan(products):
    plan = paging.page(paging.sorted_rows(products, "unique_scans_n", "code"), 2, 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize(("n", "expected"), [(9, (9, False)), (10, (10, False)), (11, (10, True))])
def test_clipped_total(spark, n, expected):
    t = paging.clipped_total(spark.range(n), 10)
    assert (t.count, t.is_lower_bound) == expected
    assert tuple(paging.clipped_total_row(spark.range(n), 10).first()) == expected


def result(total, shown, page, size, lower=False):
    return SearchResult([{"barcode": "1"}] * shown, total, lower, page, shown, size, filters={"query": " x ", "brand": "b"})


def test_notices():
    r = _explained(result(5, 0, 9, 5), True)
    assert "query:  x , brand: b" in r.notice and not r.truncated and "No products found (total: 5)" in to_text(r)
    r = _explained(result(132_650, 20, 1, 20), True)
    assert r.truncated and "500" in r.notice and "6633 in all" in r.notice and "next page" in r.notice
    r = _explained(result(10_000, 20, 500, 20, True), True)
    assert "more matches exist" in r.notice and "next page" not in r.notice and "10000+" in to_text(r)
    r = _explained(result(25, 5, 5, 5), False)
    assert r.truncated and "no further pages" in r.notice and (r.shown, r.cap) == (5, 5)
    assert not _explained(result(3, 3, 1, 5), False).truncated


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 300_000), st.integers(1, 50), st.booleans())
def test_pages(total, size, text):
    every, reachable = paging.pages(total, size, text)
    assert (every - 1) * size < total <= every * size or total == every == 0
    assert reachable <= every and (not text or reachable * size <= 10_000)
