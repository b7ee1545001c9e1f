"""The product schema, closed vocabularies of the interface, and projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

INGREDIENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("percent_estimate", T.DoubleType()),
    T.StructField("vegan", T.StringType()),
    T.StructField("vegetarian", T.StringType()),
])

_STRING, _TAGS = T.StringType(), T.ArrayType(T.StringType())

# The fields a lookup may ask for, in the order they are returned.
PRODUCT_FIELDS = (
    "product_name", "brands", "quantity", "ingredients_text", "ingredients", "allergens_tags", "additives_tags",
    "nutriscore_grade", "nova_group", "ecoscore_grade", "nutriments", "serving_size", "serving_quantity",
    "serving_quantity_unit", "categories_tags", "labels_tags", "packaging_tags", "origins_tags", "image_url",
    "completeness", "data_quality_tags",
)
SUMMARY_FIELDS = ("product_name", "brands", "nutriscore_grade", "nova_group", "ecoscore_grade", "categories_tags")
COMPARE_FIELDS = ("product_name", "brands", "nutriscore_grade", "nova_group", "ecoscore_grade", "nutriments", "completeness")
SORT_KEYS = ("last_modified_t", "unique_scans_n", "created_t", "popularity_key")
GRADES = ("a", "b", "c", "d", "e")
NOVA_GROUPS = ("1", "2", "3", "4")
FACETS = ("categories", "labels", "allergens", "additives", "countries", "nova_groups", "nutrition_grades")
CLOSED_FACETS = ("nova_groups", "nutrition_grades")
# The name of the full vocabulary of each open facet.
VOCABULARY_NAMES = {"categories": "category", "labels": "label", "allergens": "allergen", "additives": "additive", "countries": "country"}

RESULT_WINDOW = 10_000  # results that text search can page through
COUNT_CEILING = 10_000  # matches that text search counts
MAX_SUGGESTIONS = 200

_TYPES: dict[str, T.DataType] = {
    "ingredients": T.ArrayType(INGREDIENT),
    "nova_group": T.IntegerType(),
    "nutriments": T.MapType(_STRING, T.VariantType()),
    "completeness": T.DoubleType(),
}


def _type(name: str) -> T.DataType:
    return _TYPES.get(name, _TAGS if name.endswith("_tags") else _STRING)


#: Raw products, one JSON object a line. Columns after data_quality_tags are for filters and sorting only.
RAW_PRODUCT = T.StructType(
    [T.StructField("code", _STRING), *[T.StructField(n, _type(n)) for n in PRODUCT_FIELDS]]
    + [T.StructField("brands_tags", _TAGS), T.StructField("countries_tags", _TAGS)]
    + [T.StructField(n, T.LongType()) for n in SORT_KEYS]
)

VOCABULARY = T.StructType([
    T.StructField("facet", _STRING),
    T.StructField("ord", T.LongType()),
    T.StructField("id", _STRING),
    T.StructField("name", _STRING),
    T.StructField("products", T.LongType()),
])


@dataclass(frozen=True)
class CatalogSpec:
    """Which columns of a catalog play which part, so that any wide table can be searched."""

    key: str = "code"
    text: tuple[str, ...] = ("product_name", "brands", "ingredients_text")
    category: str = "categories_tags"
    brand: str = "brands_tags"
    label: str = "labels_tags"
    allergen: str = "allergens_tags"
    additive: str = "additives_tags"
    country: str = "countries_tags"
    grade: str = "nutriscore_grade"
    nova: str = "nova_group"
    summary: tuple[str, ...] = SUMMARY_FIELDS

    @property
    def tags(self) -> dict[str, str]:
        """Facet to tag column."""
        return {"category": self.category, "brand": self.brand, "label": self.label, "allergen": self.allergen, "additive": self.additive, "country": self.country}
