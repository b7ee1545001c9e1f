"""A catalog view over the driver's tables, so that every operator can be held against SQL.

It is a projection made for tests: parts stand in for products, and nothing in it is about food.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantry.plans.schema import RAW_PRODUCT, CatalogSpec

SPEC = CatalogSpec(key="barcode", text=("product_name", "brands"), brand="brands_tags")
DOCUMENTS = CatalogSpec(key="doc_id", text=("text",), summary=("lang", "source"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def barcode(column: str) -> Column:
    return F.lpad(F.col(column).cast("string"), 13, "0")


def products(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """only: a barcode; the part's own key then reaches the scan as an equality."""
    size, name = F.col("p_size"), F.split("p_name", " ")
    part = table(spark, sf_dir, "part")
    return (part if only is None else part.where(F.col("p_partkey") == int(only))).select(
        barcode("p_partkey").alias("barcode"),
        "p_partkey",
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brands"),
        F.array(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("brands_tags"),
        F.array(F.concat(F.lit("en:"), F.lower("p_type")), F.concat(F.lit("en:"), F.coalesce(F.try_element_at(name, F.lit(2)), F.lit("")))).alias("categories_tags"),
        F.array(F.concat(F.lit("en:"), name[0])).alias("labels_tags"),
        F.array(F.concat(F.lit("en:allergen-"), (size % 7).cast("string"))).alias("allergens_tags"),
        F.array(F.concat(F.lit("en:e"), (100 + size).cast("string"))).alias("additives_tags"),
        F.nullif(F.substring(F.lit("abcde"), 1 + size % 6, F.lit(1)), F.lit("")).alias("nutriscore_grade"),
        F.nullif(F.col("p_partkey") % 5, F.lit(0)).cast("int").alias("nova_group"),
        F.col("p_retailprice").alias("price"),
        size.alias("size"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the shape of raw products, with members missing, empty, of the wrong kind, and nested."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    nutrients = F.concat(
        F.lit('{"energy-kcal_100g":'), price.cast("string"), F.lit(',"fat_100g":"'), size.cast("string"), F.lit('","saturated-fat_100g":'), (price / 4).cast("string"),
        F.when(size % 2 == 0, F.concat(F.lit(',"sugars_100g":'), size.cast("string"))).otherwise(""), F.lit(',"salt_100g":'), size.cast("string"), F.lit("}"),
    )

    def ingredient(i: Column) -> Column:
        first = i == 0
        return F.struct(
            F.when(first, F.concat(F.lit("en:"), F.lower("p_type"))).otherwise("").alias("id"), F.when(first, F.col("p_type")).alias("text"), (size.cast("double") / 2).alias("percent_estimate"), F.when(first, "yes").otherwise("").alias("vegan"), F.lit(None).cast("string").alias("vegetarian")
        )

    own = {
        "code": barcode("p_partkey"), "product_name": F.col("p_name"), "brands": F.col("p_brand"), "quantity": F.concat(size.cast("string"), F.lit(" pieces")), "ingredients_text": F.when(size % 4 > 0, F.col("p_type")).otherwise(""),
        "ingredients": F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < size % 3), ingredient), "allergens_tags": F.array(F.lit("en:a"), F.lit("en:b")),
        "additives_tags": F.when(size % 2 == 0, F.array(F.lit("en:e100"))).when(size % 5 > 0, F.array().cast("array<string>")), "nutriscore_grade": F.substring(F.lit("abcde"), 1 + size % 6, F.lit(1)), "nova_group": F.nullif(F.col("p_partkey") % 5, F.lit(0)).cast("int"),
        "ecoscore_grade": F.lit(""), "nutriments": F.from_json(nutrients, "map<string,variant>"), "serving_size": F.when(size % 2 == 0, "30 g"), "serving_quantity": F.when(size % 3 == 0, " 30.5 ").otherwise("a scoop"), "serving_quantity_unit": F.lit("g"),
        "categories_tags": F.array(F.lower("p_type")), "packaging_tags": F.array().cast("array<string>"), "origins_tags": F.array(F.lit("x")), "completeness": size.cast("double") / 100, "data_quality_tags": F.array(F.lit("en:checked")),
    }
    return table(spark, sf_dir, "part").select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) if f.name not in ("nutriments", "ingredients") else own[f.name].alias(f.name) for f in RAW_PRODUCT.fields])


def with_sort_keys(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Sort keys from order lines: one aggregate, partial before the shuffle."""
    keys = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("unique_scans_n"), F.max("l_shipdate").cast("date").alias("last_modified_t"), F.min("l_shipdate").cast("date").alias("created_t"), F.sum("l_quantity").cast("long").alias("popularity_key"))
    return rows.join(keys, F.col("p_partkey") == F.col("l_partkey"), "left").drop("l_partkey")


def country_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(facet, tag, key): the nations that supply each part."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("en:"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("tag"))
    return pairs.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select(F.lit("country").alias("facet"), "tag", barcode("l_partkey").alias("key")).distinct()
