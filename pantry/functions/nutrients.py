"""Typed columns from the open nutrient map, and the sparse product built around them.

Absence is data: nothing is ever filled with zero or false. Empty text is absent; tag lists are kept even
when empty; a number is kept only if it is a number in the source.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pantry.functions import scalars as S
from pantry.plans.schema import PRODUCT_FIELDS

# Raw keys of the named nutrients, in order.
NAMED = (
    "energy-kcal_100g", "fat_100g", "saturated-fat_100g", "carbohydrates_100g", "sugars_100g", "fiber_100g",
    "proteins_100g", "salt_100g", "sodium_100g", "energy-kcal_serving", "fat_serving", "sugars_serving",
)
COMPARED = ("energy-kcal_100g", "fat_100g", "saturated-fat_100g", "sugars_100g", "salt_100g", "proteins_100g", "fiber_100g")
NOT_NUTRIENTS = ("nova-group",)
SUFFIXES = ("_100g", "_serving")

_NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def is_number(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(_NUMERIC), F.lit(False))


def value_of(m: Column, key: str) -> Column:
    v = m[key]
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def named(m: Column) -> dict[str, Column]:
    """Column name to expression of each named nutrient."""
    return {k.replace("-", "_"): value_of(m, k) for k in NAMED}


def unit_of(m: Column, base: Column) -> Column:
    u = m[F.concat(base, F.lit("_unit"))]
    return F.when(F.schema_of_variant(u) == "STRING", S.absent_if_empty(F.try_variant_get(u, "$", "string")))


def open_entries(m: Column, suffix: str) -> Column:
    """Array of (key, struct(value, unit)) of all other nutrients with this suffix, in document order."""
    excluded = [*NAMED, *[f"{k}{suffix}" for k in NOT_NUTRIENTS]]
    wanted = F.filter(F.map_entries(m), lambda e: e["key"].endswith(suffix) & is_number(e["value"]) & ~e["key"].isin(excluded))

    def entry(e: Column) -> Column:
        base = S.base_key(e["key"], suffix)
        return F.struct(S.normal_key(base).alias("key"), F.struct(F.try_variant_get(e["value"], "$", "double").alias("value"), unit_of(m, base).alias("unit")).alias("value"))

    return F.transform(wanted, entry)


def open_map(m: Column, suffix: str) -> Column:
    """The entries as a map; of two raw keys that become one name the last wins. Absent when empty."""
    entries = open_entries(m, suffix)
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.when(F.size(last) > 0, F.map_from_entries(last))


def nutriments(m: Column) -> Column:
    """The struct of named nutrients and both open maps; absent when nothing survives."""
    parts = {**named(m), "additional_100g": open_map(m, "_100g"), "additional_serving": open_map(m, "_serving")}
    some = F.array_contains(F.array(*[c.isNotNull() for c in parts.values()]), True)
    return F.when(some, F.struct(*[c.alias(n) for n, c in parts.items()]))


def ingredients(x: Column) -> Column:
    """Missing text is empty, other empty members are absent, an empty list is absent."""
    made = F.transform(
        x,
        lambda i: F.struct(
            S.absent_if_empty(i["id"]).alias("id"), F.coalesce(i["text"], F.lit("")).alias("text"), i["percent_estimate"].alias("percent_estimate"), S.absent_if_empty(i["vegan"]).alias("vegan"), S.absent_if_empty(i["vegetarian"]).alias("vegetarian")
        ),
    )
    return F.when(F.size(made) > 0, made)


_AS_IS = {"nova_group", "completeness"}


def product(fields: tuple[str, ...] = PRODUCT_FIELDS) -> list[Column]:
    """Expressions of the asked-for fields over raw products."""
    out = []
    for f in fields:
        c = F.col(f)
        if f == "nutriments":
            e = nutriments(c)
        elif f == "ingredients":
            e = ingredients(c)
        elif f == "serving_quantity":
            e = S.number(c)
        elif f == "serving_quantity_unit":  # a unit without a quantity says nothing
            e = F.when(S.number(F.col("serving_quantity")).isNotNull(), S.absent_if_empty(c)) if "serving_quantity" in fields else F.lit(None).cast("string")
        elif f in _AS_IS or f.endswith("_tags"):
            e = c
        else:
            e = S.absent_if_empty(c)
        out.append(e.alias(f))
    return out


def compared() -> list[Column]:
    """The row of a comparison: scalars and seven nutrients per 100 g."""
    m = F.col("nutriments")
    plain = [S.absent_if_empty(F.col(c)).alias(c) for c in ("product_name", "brands", "nutriscore_grade")]
    return [*plain, F.col("nova_group"), S.absent_if_empty(F.col("ecoscore_grade")).alias("ecoscore_grade"), F.col("completeness"), *[value_of(m, k).alias(k.replace("-", "_")) for k in COMPARED]]
