"""Product tables: JSON lines or Parquet in, tag index and postings out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantry.functions import scalars as S
from pantry.plans.schema import RAW_PRODUCT, VOCABULARY, VOCABULARY_NAMES, CatalogSpec


def read_json(spark: SparkSession, path: str, spec: CatalogSpec = CatalogSpec()) -> tuple[DataFrame, DataFrame]:
    """Products and quarantine of a JSON-lines file.

    A line that is not a JSON object goes to the quarantine (code where it can be read, reason, error, body) and
    is neither found nor missing. A number where text belongs becomes text; text where a number belongs is
    absent. brands may be a string or a list.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "body")
    raw = lines.withColumn("doc", F.try_parse_json("body"))
    ok = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    body = T.StructType([f for f in RAW_PRODUCT.fields if f.name not in ("brands", "serving_quantity")])
    wide = raw.where(ok).withColumn("p", F.from_json("body", body))
    products = wide.select("p.*", S.joined_variant(F.try_variant_get("doc", "$.brands", "variant")).alias("brands"), F.try_variant_get("doc", "$.serving_quantity", "string").alias("serving_quantity"))
    reason = F.when(S.is_html(F.col("body")), "the source served a rendered page").otherwise("the record is not a JSON object")
    bad = raw.where(~ok & (F.trim("body") != "")).select(F.regexp_extract("body", '"code"\\s*:\\s*"([0-9]{8,14})"', 1).alias(spec.key), F.lit("upstream_error").alias("reason"), reason.alias("error"), F.substring("body", 1, 200).alias("body"))
    return products.select(*[f.name for f in RAW_PRODUCT.fields]), bad.withColumn(spec.key, S.absent_if_empty(F.col(spec.key)))


def read_vocabulary(spark: SparkSession, folder: str, facet: str) -> DataFrame | None:
    """The full vocabulary of a facet, from the Parquet folder that bears its name; none for closed facets."""
    name = VOCABULARY_NAMES.get(facet)
    return spark.read.schema(VOCABULARY).parquet(f"{folder}/{name}") if name else None


def is_json(path: str) -> bool:
    return path.endswith((".json", ".jsonl", ".ndjson", ".json.gz", ".jsonl.gz"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(products: DataFrame, path: str, key: str = "code") -> None:
    """Ranges of the key in each file, sorted, so that a look-up by key skips nearly all row groups."""
    products.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_json(products: DataFrame, path: str) -> None:
    """JSON lines; absent members are left out."""
    products.write.mode("overwrite").json(path)


def tag_index(products: DataFrame, spec: CatalogSpec = CatalogSpec()) -> DataFrame:
    """(facet, tag, key): a row a tag of a product. Write it by ``write_tag_index`` to look tags up without a scan of products."""
    parts = [F.struct(F.lit(facet).alias("facet"), F.col(column).alias("tags")) for facet, column in spec.tags.items() if column in products.columns]
    facets = products.select(F.col(spec.key).alias("key"), F.explode(F.array(*parts)).alias("f"))
    return facets.select(F.col("f.facet").alias("facet"), F.explode(F.array_distinct("f.tags")).alias("tag"), "key").where(F.col("tag").isNotNull())


def write_tag_index(index: DataFrame, path: str) -> None:
    """Partitioned by facet and sorted by tag in ranges: a facet filter reads one folder and the row groups of its tag. A very frequent tag spreads over several files."""
    index.repartitionByRange("facet", "tag", "key").sortWithinPartitions("facet", "tag", "key").write.mode("overwrite").partitionBy("facet").parquet(path)


def by_tags(products: DataFrame, index: DataFrame, tags: dict[str, str], spec: CatalogSpec = CatalogSpec()) -> DataFrame:
    """Products that have all tags, by semi-joins with the index."""
    for facet, tag in tags.items():
        keys = index.where((F.col("facet") == facet) & (F.col("tag") == tag)).select(F.col("key").alias(spec.key))
        products = products.join(keys, spec.key, "left_semi")
    return products


def tag_counts(index: DataFrame) -> DataFrame:
    """(facet, tag, products)."""
    return index.groupBy("facet", "tag").agg(F.count(F.lit(1)).alias("products"))
