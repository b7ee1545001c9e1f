"""Look-up: sparse products, coercions, the open nutrient map, rendering."""

import json

import pytest

from pantry.operators import lookup, render
from pantry.operators.render import num
from pantry.plans.engine import Catalog, to_dict, to_text
from pantry.plans.errors import CatalogError
from pantry.plans.requests import LookupRequest
from pantry.plans.schema import PRODUCT_FIELDS
from pantry.sources.config import Settings

WIDE = Settings(product=1000, search=1000, vocabulary=1000, deadline_s=120)

PRODUCTS = [
    {"code": "3017620422003", "product_name": "Spread", "brands": "Ferrero", "quantity": "400g", "nutriscore_grade": "e", "nova_group": 4, "ecoscore_grade": "c", "completeness": 0.85, "data_quality_tags": ["en:checked"],
     "nutriments": {"energy-kcal_100g": 539, "fat_100g": 30.9, "sugars_100g": 56.3, "proteins_100g": 6.3, "salt_100g": 0.107}, "categories_tags": ["en:spreads", "en:sweet"], "allergens_tags": ["en:milk", "en:nuts"], "serving_quantity_unit": "g"},
    {"code": "9999999999999", "product_name": "Bare"},
    {"code": "1111111111111", "product_name": "No allergens", "nutriscore_grade": "c", "labels_tags": [], "ingredients": []},
    {"code": "2222222222222", "product_name": "No nutriments", "ecoscore_grade": "unknown", "nutriments": {}},
    {"code": "3333333333333", "nutriments": {"energy-kcal_100g": 250, "saturated-fat_100g": 5.5, "fat_100g": 12, "proteins_100g": 8, "energy-kcal_serving": 125}},
    {"code": "0028400157827", "product_name": "Chips", "serving_size": "28 g", "serving_quantity": 28, "serving_quantity_unit": "g",
     "nutriments": {"energy-kcal_100g": 571, "energy-kcal_serving": 160, "fat_serving": 10, "sugars_serving": 1, "calcium_100g": 0.071, "calcium_unit": "g", "iron_100g": 0.00129, "iron_unit": "g", "trans-fat_100g": 0, "trans-fat_unit": "g", "vitamin-a_100g": 0.0001071, "vitamin-a_unit": "g", "folates_100g": 0.000086, "folates_unit": "g", "energy_100g": 2389, "energy_unit": "kJ"}},
    {"code": "00284001", "serving_quantity": "28", "serving_quantity_unit": "g"},
    {"code": "4444444444444", "serving_quantity": "one scoop", "serving_quantity_unit": "g"},
    {"code": "5555555555555", "nutriments": {"saturated-fat_100g": 5.36, "saturated-fat_unit": "g", "fat_100g": 35.71, "calcium_100g": 0.071, "calcium_unit": "g"}},
    {"code": "6666666666666", "nutriments": {"nova-group": 4, "nova-group_100g": 4, "nova-group_serving": 4, "nova-group_unit": "", "calcium_100g": 0.1}},
    {"code": "7777777777777", "nutriments": {"saturated-fat_100g": 5.36, "saturated-fat_serving": 1.5, "saturated-fat_unit": "g", "sugars_serving": 1}},
    {"code": "8888888888888", "nutriments": {"fruits-vegetables-estimate-from-ingredients_100g": 13, "fat_100g": "35", "a-b_100g": 1, "a_b_100g": 2, "x_unit": 5, "x_100g": 3}},
    {"code": "5202336064700", "product_name": "Long", "ingredients": [{"id": f"en:i{i}", "text": f"item {i}", "percent_estimate": 56.85 if i else 9.375, "vegan": "maybe", "vegetarian": ""} for i in range(23)] + [{"percent_estimate": None}], "categories_tags": [f"en:c{i}" for i in range(6)], "completeness": 0.7875},
    {"code": "0049000042566", "serving_size": "1 can (12 fl oz)", "serving_quantity": 354.882, "serving_quantity_unit": "ml", "nutriments": {"energy-kcal_serving": 0}},
    {"code": "12345678", "brands": ["Ferrero", "Nutella"], "quantity": "", "nova_group": "4"},
]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("products") / "products.jsonl"
    lines = [json.dumps(p) for p in PRODUCTS] + ['{"code": "7000000000001", broken', "<!-- t --><!DOCTYPE html><html>", ""]
    path.write_text("\n".join(lines))
    return Catalog.open(spark, str(path), settings=WIDE)


def get(catalog, code, *fields):
    return catalog.get_product(code, fields).product


def test_full_and_sparse(catalog):
    p = get(catalog, "3017620422003")
    assert p["nutriments"] == {"energy_kcal_100g": 539.0, "fat_100g": 30.9, "sugars_100g": 56.3, "proteins_100g": 6.3, "salt_100g": 0.107}
    assert p["categories_tags"] == ["en:spreads", "en:sweet"] and p["nova_group"] == 4 and p["completeness"] == 0.85
    assert "serving_quantity_unit" not in p
    assert get(catalog, "9999999999999") == {"product_name": "Bare"}
    assert get(catalog, "1111111111111") == {"product_name": "No allergens", "nutriscore_grade": "c", "labels_tags": []}
    assert "nutriments" not in get(catalog, "2222222222222")
    assert get(catalog, "12345678") == {"brands": "Ferrero, Nutella"}


def test_missing_record(catalog):
    for fields in ((), ("product_name",)):
        with pytest.raises(CatalogError) as e:
            get(catalog, "0000000000000", *fields)
        assert e.value.reason == "not_found" and e.value.data == {"barcode": "0000000000000"} and "retryable" not in e.value.to_dict()


def test_nutrients(catalog):
    assert get(catalog, "3333333333333")["nutriments"] == {"energy_kcal_100g": 250, "fat_100g": 12, "saturated_fat_100g": 5.5, "proteins_100g": 8, "energy_kcal_serving": 125}
    n = get(catalog, "0028400157827")["nutriments"]
    assert n["additional_100g"] == {"calcium": {"value": 0.071, "unit": "g"}, "iron": {"value": 0.00129, "unit": "g"}, "trans_fat": {"value": 0, "unit": "g"}, "vitamin_a": {"value": 0.0001071, "unit": "g"}, "folates": {"value": 0.000086, "unit": "g"}, "energy": {"value": 2389, "unit": "kJ"}}
    assert (n["energy_kcal_serving"], n["fat_serving"], n["sugars_serving"]) == (160, 10, 1)
    n = get(catalog, "5555555555555")["nutriments"]
    assert n == {"fat_100g": 35.71, "saturated_fat_100g": 5.36, "additional_100g": {"calcium": {"value": 0.071, "unit": "g"}}}
    assert get(catalog, "6666666666666")["nutriments"] == {"additional_100g": {"calcium": {"value": 0.1}}}
    n = get(catalog, "7777777777777")["nutriments"]
    assert n["additional_serving"] == {"saturated_fat": {"value": 1.5, "unit": "g"}} and n["sugars_serving"] == 1
    n = get(catalog, "8888888888888")["nutriments"]
    assert n == {"additional_100g": {"fruits_vegetables_estimate_from_ingredients": {"value": 13}, "a_b": {"value": 2}, "x": {"value": 3}}}


@pytest.mark.parametrize(("code", "quantity", "unit"), [("0028400157827", 28, "g"), ("00284001", 28, "g"), ("4444444444444", None, None), ("0049000042566", 354.882, "ml")])
def test_serving_quantity(catalog, code, quantity, unit):
    p = get(catalog, code)
    assert (p.get("serving_quantity"), p.get("serving_quantity_unit")) == (quantity, unit)
    assert "serving_quantity_unit" not in get(catalog, code, "serving_quantity_unit", "serving_size")


def test_ingredients(catalog):
    p = get(catalog, "5202336064700")
    assert len(p["ingredients"]) == 24 and p["ingredients"][0] == {"id": "en:i0", "text": "item 0", "percent_estimate": 9.375, "vegan": "maybe"} and p["ingredients"][-1] == {"text": ""}


def test_field_subset(catalog):
    r = catalog.get_product("3017620422003", ("nutriscore_grade", "product_name"))
    assert r.requested_fields == ("nutriscore_grade", "product_name") and r.product == {"nutriscore_grade": "e", "product_name": "Spread"}
    text = to_text(r)
    assert all(f"| {name} | Not requested |" in text for name in ("nutriments", "ingredients_text", "allergens_tags")) and "Not available" not in text and "Not entered" not in text
    assert "Only these fields were requested: nutriscore_grade, product_name." in text and "| brands |" not in text
    assert "nutriments" not in to_dict(r)["product"]


def test_rendering(catalog):
    text = to_text(catalog.get_product("5202336064700"))
    assert text.count("\n| item") == 23 and "| 56.85 |" in text and "| 9.375 |" in text and "| completeness | 79% (0.7875, moderate) |" in text and "| item 0 | en:i0 | 9.375 | maybe | N/A |" in text
    assert all(f"en:c{i}" in text for i in range(6))
    text = to_text(catalog.get_product("0028400157827"))
    assert "| serving_size | 28 g |" in text and "| serving_quantity | 28 g |" in text and "| folates | 0.000086 g | N/A |" in text and "| energy_kcal | 571 kcal | 160 kcal |" in text
    text = to_text(catalog.get_product("7777777777777"))
    assert "No serving size is recorded" in text and "| saturated_fat | 5.36 g | 1.5 g |" in text
    text = to_text(catalog.get_product("9999999999999"))
    assert "| nutriments | Not available |" in text and "| ingredients_text | Not available |" in text and "| allergens_tags | Not entered" in text and "No serving size" not in text


def test_cells_keep_rows_whole():
    assert [render.cell(x) for x in (None, "", True, 1.0, ["a", "b|c"], [], "x\ny|z")] == ["N/A", "N/A", "true", "1", "a, b\\|c", "N/A", "x<br>y\\|z"]


@pytest.mark.parametrize(("x", "text"), [(539.0, "539"), (0.000086, "0.000086"), (0.1, "0.1"), (None, "N/A"), (4, "4"), (8.6e-5, "0.000086"), (1.5e-7, "0.00000015"), (30.9, "30.9")])
def test_numbers(x, text):
    assert num(x) == text


@pytest.mark.parametrize("bad", ["1234567", "123456789012345", "12345678\n", "1234567a", "", "١٢٣٤٥٦٧٨", None])
def test_barcode_shape(bad):
    with pytest.raises(CatalogError):
        LookupRequest(bad)


def test_unknown_field_and_all_fields():
    with pytest.raises(CatalogError):
        LookupRequest("12345678", ("price",))
    assert LookupRequest("12345678").projection == PRODUCT_FIELDS and len(PRODUCT_FIELDS) == 21


def test_quarantine(catalog):
    rows = {r["code"]: r["error"] for r in catalog.quarantine.collect()}
    assert set(rows) == {"7000000000001", None} and "page" in rows[None]


def test_pushdown(spark, small, tmp_path):
    from pantry.sources import harness

    harness.products(spark, small).write.parquet(str(tmp_path / "p"))
    plan = lookup.lookup(spark.read.parquet(str(tmp_path / "p")), LookupRequest("00000042", ("product_name",)), harness.SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(barcode,00000042)" in plan and "ReadSchema: struct<barcode:string,product_name:string>" in plan
    assert render.percent(0.785) == "79%"


def test_catalog_from_parquet_and_settings(spark, catalog, tmp_path, monkeypatch):
    from pantry.sources import config
    from pantry.sources import products as P

    P.write_parquet(catalog.products, str(tmp_path / "catalog"))
    monkeypatch.setattr(config, "_settings", Settings.from_env({"PANTRY_CATALOG": str(tmp_path / "catalog"), "PANTRY_RATE_LIMIT_PRODUCT": "2"}))
    own = Catalog.open(spark)
    assert own.get_product("3017620422003").product == get(catalog, "3017620422003")
    own.get_product("9999999999999", ("product_name",))
    with pytest.raises(CatalogError) as e:
        own.get_product("9999999999999")
    assert e.value.reason == "rate_limited"
    plan = lookup.lookup(own.products, LookupRequest("00000042", ("product_name",)))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(code,00000042)" in plan and "ReadSchema: struct<code:string,product_name:string>" in plan
    monkeypatch.setattr(config, "_settings", Settings())
    with pytest.raises(CatalogError):
        Catalog.open(spark)


def test_engine_tries_again_and_gives_up(catalog, monkeypatch):
    waits, calls = [], []
    own = Catalog(catalog.products, settings=WIDE, sleep=waits.append)

    def broken(*_):
        calls.append(1)
        raise OSError("no route")

    monkeypatch.setattr("pantry.operators.lookup.get_product", broken)
    with pytest.raises(CatalogError) as e:
        own.get_product("3017620422003")
    assert e.value.reason == "upstream_error" and len(calls) == 4 and waits == [0.5, 1.0, 2.0]
    monkeypatch.setattr("pantry.operators.compare.compare", broken)
    r = own.compare_products(["3017620422003", "9999999999999"])
    assert [f["reason"] for f in r.failed] == ["upstream_error"] * 2 and r.products == [] and len(calls) == 8

    def refused(*_):
        calls.append(1)
        raise CatalogError("not_found", "none")

    monkeypatch.setattr("pantry.operators.lookup.get_product", refused)
    with pytest.raises(CatalogError):
        own.get_product("3017620422003")
    assert len(calls) == 9
