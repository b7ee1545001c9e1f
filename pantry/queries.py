"""Queries of the catalog operators over the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pantry.functions import nutrients
from pantry.functions import scalars as S
from pantry.operators import admission, compare, lookup, paging, search, text, vocabulary
from pantry.plans.requests import LookupRequest, SearchRequest
from pantry.sources import harness as H
from pantry.sources import products as P
from pantry.sources.seed import seed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The catalog view in SQL.
PART = """
with p as (select lpad(cast(p_partkey as varchar), 13, '0') as barcode, p_partkey, p_name as product_name, p_brand as brands,
  [lower(replace(p_brand, '#', '-'))] as brands_tags, ['en:' || lower(p_type), 'en:' || split_part(p_name, ' ', 2)] as categories_tags,
  ['en:' || split_part(p_name, ' ', 1)] as labels_tags, ['en:allergen-' || cast(p_size % 7 as varchar)] as allergens_tags, ['en:e' || cast(100 + p_size as varchar)] as additives_tags,
  nullif(substr('abcde', 1 + p_size % 6, 1), '') as nutriscore_grade, cast(nullif(p_partkey % 5, 0) as int) as nova_group,
  p_retailprice as price, p_size as size from part)"""
SUMMARY = "barcode, product_name, brands, nutriscore_grade, cast(nova_group as double) as nova_group, array_to_string(categories_tags, ', ') as categories"
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def summary(rows: DataFrame) -> DataFrame:
    return listed(search.summary(rows, H.SPEC))


def listed(rows: DataFrame) -> DataFrame:
    """Tag lists as text; the group as a double, in which both engines hold missing numbers alike."""
    return rows.withColumn("categories", S.joined(F.col("categories_tags"))).drop("categories_tags").withColumn("nova_group", F.col("nova_group").cast("double"))


def key(n: int) -> str:
    return f"{n:013d}"


# Look-ups ------------------------------------------------------------------------------------------------


@query(PART + f" select {SUMMARY}, price from p where barcode = '{key(42)}'")
def lookup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.point(H.products(spark, sf_dir, only=LookupRequest(key(42)).barcode), key(42), "barcode")
    return listed(rows.select("barcode", "product_name", "brands", "nutriscore_grade", "nova_group", "categories_tags", "price"))


@query(PART + f" select barcode, product_name, nutriscore_grade from p where barcode = '{key(7)}'")
def lookup_field_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = LookupRequest(key(7), ("product_name", "nutriscore_grade"))
    return lookup.lookup(H.products(spark, sf_dir, only=request.barcode), request, H.SPEC)


@query(PART + " select barcode, product_name from p where barcode = '9999999999999'")
def lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup(H.products(spark, sf_dir), LookupRequest("9999999999999", ("product_name",)), H.SPEC)


@query(r"select barcode, regexp_full_match(barcode, '[0-9]{8,14}') as valid from (select lpad(cast(p_partkey as varchar), 4 + p_size % 14, '0') as barcode from part)")
def barcode_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.lpad(F.col("p_partkey").cast("string"), 4 + F.col("p_size") % 14, F.lit("0"))
    return H.table(spark, sf_dir, "part").select(made.alias("barcode"), S.is_barcode(made).alias("valid"))


# Facets --------------------------------------------------------------------------------------------------


def facet_rows(spark: SparkSession, sf_dir: str, **request) -> DataFrame:
    return summary(search.matches(H.products(spark, sf_dir), SearchRequest(**request), H.SPEC))


@query(PART + f" select {SUMMARY} from p where list_contains(categories_tags, 'en:ring')")
def facet_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_rows(spark, sf_dir, categories_tag=" en:ring ")


@query(PART + f" select {SUMMARY} from p where list_contains(brands_tags, 'brand-13')")
def facet_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_rows(spark, sf_dir, brands_tag="brand-13")


@query(PART + f" select {SUMMARY} from p where list_contains(labels_tags, 'en:small')")
def facet_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_rows(spark, sf_dir, labels_tag="en:small")


@query(PART + f" select {SUMMARY} from p where list_contains(allergens_tags, 'en:allergen-3') and list_contains(labels_tags, 'en:small')")
def facet_allergen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_rows(spark, sf_dir, allergens_tag="en:allergen-3", labels_tag="en:small")


@query(PART + f" select {SUMMARY} from p where list_contains(additives_tags, 'en:e107')")
def facet_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_rows(spark, sf_dir, additives_tag="en:e107")


@query(PART + f""" select {SUMMARY} from p where p_partkey in (select l_partkey from lineitem join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey where lower(replace(n_name, ' ', '-')) = (select lower(replace(n_name, ' ', '-')) from nation where n_nationkey = 7))""")
def facet_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the tag index: a semi-join with the keys of one tag."""
    tag = H.table(spark, sf_dir, "nation").where("n_nationkey = 7").select(F.concat(F.lit("en:"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("tag"))
    keys = H.country_index(spark, sf_dir).join(F.broadcast(tag), "tag", "left_semi").select(F.col("key").alias("barcode"))  # tag is one row
    return summary(H.products(spark, sf_dir).join(keys, "barcode", "left_semi"))


@query(PART + f" select {SUMMARY} from p where nutriscore_grade = 'b'")
def facet_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_rows(spark, sf_dir, nutrition_grade="b")


@query(PART + f" select {SUMMARY} from p where nova_group = 3")
def facet_nova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_rows(spark, sf_dir, nova_group="3")


@query(PART + f" select {SUMMARY} from p where list_contains(categories_tags, 'en:ring') and list_contains(labels_tags, 'en:small') and nova_group = 2")
def facet_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_rows(spark, sf_dir, categories_tag="en:ring", labels_tag="en:small", nova_group="2")


@query(PART + f" select {SUMMARY} from p where list_contains(categories_tags, 'en:ring') and list_contains(labels_tags, 'en:small') and nutriscore_grade = 'c'")
def facet_index_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.products(spark, sf_dir)
    request = SearchRequest(categories_tag="en:ring", labels_tag="en:small", nutrition_grade="c")
    return summary(search.matches(rows, request, H.SPEC, P.tag_index(rows, H.SPEC)))


# Sorting, paging, counting -------------------------------------------------------------------------------


@query(PART + f""", k as (select l_partkey, count(*) as unique_scans_n from lineitem group by 1)
  select {SUMMARY} from p left join k on p_partkey = l_partkey where list_contains(labels_tags, 'en:small') order by unique_scans_n desc nulls last, barcode limit 20 offset 20""")
def sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.with_sort_keys(spark, sf_dir, H.products(spark, sf_dir))
    request = SearchRequest(labels_tag="en:small", sort_by="unique_scans_n", page=2)
    return listed(search.page_of(rows, request, H.SPEC))


@query(PART + """ select count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as pages from p where list_contains(labels_tags, 'en:small')""")
def exact_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.matches(H.products(spark, sf_dir), SearchRequest(labels_tag="en:small"), H.SPEC)
    return found.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / 20))


@query("select least(count(*), 10000) as total, count(*) > 10000 as total_is_lower_bound from (select 1 from lineitem limit 10001)")
def clipped_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.clipped_total_row(H.table(spark, sf_dir, "lineitem"))


# Text ----------------------------------------------------------------------------------------------------


@query(f"with d as (select doc_id, {TOKENS} as w from documents) select doc_id from d where list_contains(w, 'the') and list_contains(w, 'that') and list_contains(w, 'with')")
def text_match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = H.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.bm25(docs, "that WITH the the", H.DOCUMENTS).select("doc_id")


def bm25_sql(words: list[str], condition: str = "true", joined: str = "") -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(words))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(words)))
    found = " and ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"""with d as (select *, {TOKENS} as w from documents), t as (select *, len(w) as l, {tf} from d), s as (select count(*) as n, avg(l) as a, {df} from t)
  select t.doc_id, round({score}, 6) as score from t, s {joined} where {found} and {condition} order by 2 desc, 1 limit 20"""


@query(bm25_sql(["of", "from"]))
def text_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = H.table(spark, sf_dir, "documents").select("doc_id", "text")
    request = SearchRequest(query="from, of!")
    found = search.ordered(text.bm25(docs, request.query, H.DOCUMENTS), request, H.DOCUMENTS)
    return paging.page(found, 1, 20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""with d as (select doc_id, {TOKENS} as w from documents), e as (select doc_id, len(w) as l, unnest(w) as t from d), f as (select t, doc_id, l, count(*) as tf from e where t in ('de', 'que') group by all),
  s as (select count(*) as n, avg(len(w)) as a from d), g as (select t, count(*) as df from f group by 1)
  select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) as score from f join g using (t), s group by doc_id having count(*) = 2""")
def text_bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = H.table(spark, sf_dir, "documents").select("doc_id", "text")
    n, avg = docs.select(F.size(S.tokens(F.col("text"))).alias("n")).agg(F.count(F.lit(1)), F.avg("n")).first()
    return text.bm25_from_index(text.postings(docs, H.DOCUMENTS), "que de", n, avg).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(bm25_sql(["of", "was"], "lang = 'en' and quality = 1", "join labels on labels.doc_id = t.doc_id"))
def text_plus_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = H.table(spark, sf_dir, "labels")
    docs = H.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(labels, "doc_id", "left")
    found = text.bm25(docs, "was of", H.DOCUMENTS, (F.col("lang") == "en") & (F.col("quality") == 1))
    return paging.page(found.orderBy(F.desc(F.round("score", 6)), "doc_id"), 1, 20).select("doc_id", F.round("score", 6).alias("score"))


# Batches -------------------------------------------------------------------------------------------------

KEYS = [key(11), "9999999999999", key(3), key(11), key(5)]
_ASKED = "a(pos, barcode) as (values " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYS)) + ")"


@query(PART + f", {_ASKED} select cast(pos as bigint) as pos, a.barcode, p.barcode is not null as found, product_name, brands, nutriscore_grade, cast(nova_group as double) as nova_group, price from a left join p using (barcode)")
def compare_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.products(spark, sf_dir).select("barcode", "product_name", "brands", "nutriscore_grade", "nova_group", "price")
    return compare.batch(rows.withColumnRenamed("barcode", "code"), KEYS).withColumn("nova_group", F.col("nova_group").cast("double"))


@query(PART + f", {_ASKED} select barcode from a where barcode not in (select barcode from p)")
def compare_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_batch(spark, sf_dir).where(~F.col("found")).select("barcode")


@query(PART + f", {_ASKED} select cast(pos as bigint) as pos, barcode, count(*) over () as succeeded from a where barcode in (select barcode from p)")
def compare_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_batch(spark, sf_dir).where("found").select("pos", "barcode")
    return found.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("succeeded"))))


#: A key in the quarantine is neither found nor missing.
_BAD = "bad(barcode, reason, error) as (values ('0000000000003', 'upstream_timeout', 'late'), ('0000000000011', 'upstream_error', 'It broke.'))"


@query(PART + f", {_ASKED}, {_BAD} select cast(pos as bigint) as pos, a.barcode, case when bad.barcode is not null then 'failed' when p.barcode is not null then 'found' else 'not_found' end as outcome, reason, case when regexp_matches(error, '[.!?]$') then error else error || '.' end as error from a left join p using (barcode) left join bad on bad.barcode = a.barcode")
def compare_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = spark.createDataFrame([("0000000000003", "upstream_timeout", "late"), ("0000000000011", "upstream_error", "It broke.")], "code string, reason string, error string")
    rows = H.products(spark, sf_dir).select(F.col("barcode").alias("code"), "product_name")
    return compare.outcomes(rows, KEYS, bad).select("pos", "barcode", "outcome", "reason", "error")


@query(f"""with {_ASKED}, r as (select lpad(cast(p_partkey as varchar), 13, '0') as barcode, p_name, p_brand, p_retailprice as q, p_size as s from part)
  select cast(pos as bigint) as pos, a.barcode, r.barcode is not null as found, p_name as product_name, p_brand as brands, q as energy_kcal_100g, cast(null as double) as fat_100g, q / 4 as saturated_fat_100g, cast(case when s % 2 = 0 then s end as double) as sugars_100g, cast(s as double) as salt_100g from a left join r using (barcode)""")
def compare_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a comparison: nutrients that are numbers, absent when they are text or not there."""
    rows = compare.compare_rows(H.raw_products(spark, sf_dir), KEYS)
    return rows.select("pos", "barcode", "found", "product_name", "brands", "energy_kcal_100g", "fat_100g", "saturated_fat_100g", "sugars_100g", "salt_100g")


_SHARE = "(case when nutriscore_grade is null then 0 else 1 end + case when nova_group is null then 0 else 1 end + case when size % 4 = 0 then 0 else 1 end + case when size % 3 = 0 then 0 else 1 end) / 4.0"


def completeness(rows: DataFrame) -> DataFrame:
    some = [F.col("nutriscore_grade").isNotNull(), F.col("nova_group").isNotNull(), F.col("size") % 4 != 0, F.col("size") % 3 != 0]
    return rows.withColumn("completeness", reduce(lambda a, b: a + b, [c.cast("int") for c in some]) / 4.0)


@query(PART + f", q as (select *, {_SHARE} as completeness from p) select barcode, cast(completeness as double) as completeness, case when completeness >= 0.8 then 'high' when completeness >= 0.5 then 'moderate' else 'low' end as level from q where completeness < 0.8")
def low_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = completeness(H.products(spark, sf_dir)).where("completeness < 0.8")
    return rows.select("barcode", F.col("completeness").cast("double").alias("completeness"), S.completeness_level(F.col("completeness")).alias("level"))


@query(PART + f", q as (select *, {_SHARE} * price / 2000 as x from p) select barcode, cast(floor(x * 100 + 0.5) as bigint) as percent from q")
def percent_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = completeness(H.products(spark, sf_dir))
    return rows.select("barcode", S.percent(F.col("completeness") * F.col("price") / 2000).alias("percent"))


@query(PART + f", q as (select *, {_SHARE} as completeness from p) select product_name, barcode, cast(completeness as double) as completeness from q where completeness < 0.5")
def compare_low_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that a comparison warns of."""
    return compare.sparse(completeness(H.products(spark, sf_dir)).withColumn("completeness", F.col("completeness").cast("double"))).select("product_name", "barcode", "completeness")


@query("""with r as (select lpad(cast(p_partkey as varchar), 13, '0') as barcode, p_name, p_brand, p_type, p_retailprice as q, p_size as s, p_partkey as k from part)
  select barcode, p_name as product_name, p_brand as brands, cast(s as varchar) || ' pieces' as quantity, case when s % 4 > 0 then p_type end as ingredients_text, case when s % 3 > 0 then s % 3 end as n_ingredients,
    'en:a, en:b' as allergens, case when s % 2 = 0 then 'en:e100' when s % 5 > 0 then '' end as additives, case when s % 6 < 5 then substr('abcde', 1 + s % 6, 1) end as nutriscore_grade, cast(nullif(k % 5, 0) as double) as nova_group, cast(null as varchar) as ecoscore_grade,
    q as energy_kcal_100g, q / 4 as saturated_fat_100g, case when s % 2 = 0 then '30 g' end as serving_size, case when s % 3 = 0 then cast(30.5 as double) end as serving_quantity, case when s % 3 = 0 then 'g' end as serving_quantity_unit,
    lower(p_type) as categories, cast(null as varchar) as labels, '' as packaging, 'x' as origins, cast(null as varchar) as image_url, cast(s as double) / 100 as completeness, 'en:checked' as data_quality from r""")
def default_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 21 fields of every product, lists and nested members in short."""
    rows = H.raw_products(spark, sf_dir).select(F.col("code").alias("barcode"), *nutrients.product())
    lists = {"allergens": "allergens_tags", "additives": "additives_tags", "categories": "categories_tags", "labels": "labels_tags", "packaging": "packaging_tags", "origins": "origins_tags", "data_quality": "data_quality_tags"}
    plain = ("product_name", "brands", "quantity", "ingredients_text", "nutriscore_grade", "ecoscore_grade", "serving_size", "serving_quantity", "serving_quantity_unit", "image_url", "completeness")
    return rows.select("barcode", *plain, F.col("nova_group").cast("double").alias("nova_group"), F.size("ingredients").cast("double").alias("n_ingredients"), F.col("nutriments.energy_kcal_100g"), F.col("nutriments.saturated_fat_100g"), *[S.joined(F.col(c)).alias(n) for n, c in lists.items()])


@query("""with r as (select lpad(cast(p_partkey as varchar), 13, '0') as barcode, p_type, p_size as s, unnest(range(p_size % 3)) as i from part)
  select barcode, cast(i as bigint) as pos, case when i = 0 then 'en:' || lower(p_type) end as id, case when i = 0 then p_type else '' end as text, cast(s as double) / 2 as percent_estimate, case when i = 0 then 'yes' end as vegan from r""")
def ingredient_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing text is empty, other empty members are absent, an empty list has no rows."""
    made = H.raw_products(spark, sf_dir).select(F.col("code").alias("barcode"), F.posexplode(nutrients.ingredients(F.col("ingredients"))).alias("pos", "i"))
    return made.select("barcode", F.col("pos").cast("long").alias("pos"), "i.id", "i.text", "i.percent_estimate", "i.vegan")


@query(r"""select lpad(cast(p_partkey as varchar), 13, '0') as barcode, format('{:,}', cast(floor(p_retailprice) as bigint) * 1000) as price, url_encode(p_name) as component, case when p_size % 2 = 0 then p_name || '!' else p_name || '.' end as said from part""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    said = S.sentence(F.when(F.col("p_size") % 2 == 0, F.concat(name, F.lit("!"))).otherwise(name))
    return H.table(spark, sf_dir, "part").select(H.barcode("p_partkey").alias("barcode"), S.thousands(F.floor("p_retailprice").cast("long") * 1000).alias("price"), S.url_component(name).alias("component"), said.alias("said"))


# Nutrients, JSON -----------------------------------------------------------------------------------------


def nutrient_doc() -> Column:
    """A document for each part, with numbers, text and units, as JSON."""
    q, s = F.col("p_retailprice"), F.col("p_size")
    return F.concat(F.lit('{"energy-kcal_100g":'), q.cast("string"), F.lit(',"fat_100g":"'), s.cast("string"), F.lit('","salt_100g":'), s.cast("string"), F.lit(',"trans-fat_100g":'), s.cast("string"), F.lit(',"trans-fat_unit":"'), F.when(s % 2 == 0, F.lit("g")).otherwise(""), F.lit('","nova-group_100g":4,"calcium_serving":'), q.cast("string"), F.lit(',"calcium_unit":"mg"}'))


def nutrient_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.table(spark, sf_dir, "part").select(H.barcode("p_partkey").alias("barcode"), F.from_json(nutrient_doc(), "map<string,variant>").alias("m"))


@query("select lpad(cast(p_partkey as varchar), 13, '0') as barcode, p_retailprice as energy_kcal_100g, cast(null as double) as fat_100g, cast(p_size as double) as salt_100g from part")
def nutrient_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = nutrient_maps(spark, sf_dir), nutrients.named(F.col("m"))
    return rows.select("barcode", *[own[k].alias(k) for k in ("energy_kcal_100g", "fat_100g", "salt_100g")])


@query("""select lpad(cast(p_partkey as varchar), 13, '0') as barcode, '100g' as per, 'trans_fat' as name, cast(p_size as double) as value, case when p_size % 2 = 0 then 'g' end as unit from part
  union all select lpad(cast(p_partkey as varchar), 13, '0'), 'serving', 'calcium', p_retailprice, 'mg' from part""")
def nutrient_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nutrient_maps(spark, sf_dir)
    parts = [rows.select("barcode", F.lit(s.strip("_")).alias("per"), F.explode(nutrients.open_map(F.col("m"), s)).alias("name", "v")) for s in nutrients.SUFFIXES]
    return parts[0].unionByName(parts[1]).select("barcode", "per", "name", "v.value", "v.unit")


_QUANTITY = "case p_size % 6 when 0 then cast(p_size as varchar) when 1 then ' ' || cast(p_size as varchar) || '.5 ' when 2 then cast(p_size as varchar) || 'd' when 3 then 'one scoop' when 4 then '1e2' else 'Infinity' end"


@query(rf"""with q as (select p_partkey, {_QUANTITY} as raw from part), v as (select p_partkey, case when regexp_matches(trim(raw), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(trim(raw) as double) end as quantity from q)
  select lpad(cast(p_partkey as varchar), 13, '0') as barcode, quantity, case when quantity is not null then 'g' end as unit from v""")
def quantity_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.table(spark, sf_dir, "part").select(H.barcode("p_partkey").alias("barcode"), F.expr(_QUANTITY.replace("varchar", "string")).alias("serving_quantity"), F.lit("g").alias("serving_quantity_unit"))
    return rows.select("barcode", *nutrients.product(("serving_quantity", "serving_quantity_unit"))).withColumnsRenamed({"serving_quantity": "quantity", "serving_quantity_unit": "unit"})


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_typed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(r"select 'page' as kind, page_id as id, regexp_matches(html, '(?i)<(!doctype\s+html|html[\s>])') as is_html from pages union all select 'document', doc_id, regexp_matches(text, '(?i)<(!doctype\s+html|html[\s>])') from documents")
def html_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = H.table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), S.is_html(F.col("html")).alias("is_html"))
    return pages.unionByName(H.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), S.is_html(F.col("text")).alias("is_html")))


@query("select p_type, string_agg(distinct p_brand, ', ' order by p_brand) as brands from part group by 1")
def brand_join_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.table(spark, sf_dir, "part").groupBy("p_type").agg(S.joined(F.sort_array(F.collect_set("p_brand"))).alias("brands"))


@query(r"""select doc_id, sha256(regexp_replace(text, '([+\-=&|><!(){}\[\]^"~*?:\\/])', '\\\1', 'g')) as escaped_sha256, cast(length(regexp_replace(text, '([+\-=&|><!(){}\[\]^"~*?:\\/])', '\\\1', 'g')) as bigint) as escaped_chars, regexp_matches(text, '[.!?]$') as ends from documents""")
def query_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts are escaped; their digests and lengths are returned."""
    escaped = S.escape_query(F.col("text"))
    return H.table(spark, sf_dir, "documents").select("doc_id", F.sha2(escaped, 256).alias("escaped_sha256"), F.length(escaped).cast("long").alias("escaped_chars"), F.col("text").rlike("[.!?]$").alias("ends"))


# Vocabulary ----------------------------------------------------------------------------------------------

_LIVE = "live as (select 'additives' as facet, row_number() over (order by size) - 1 as ord, 'en:e' || cast(100 + size as varchar) as id, 'Additive ' || cast(100 + size as varchar) as name, n as products from (select p_size as size, count(*) as n from part group by 1))"
_SAMPLE = "sample as (select 'additives' as facet, i as ord, 'en:e' || cast(110 + 5 * i as varchar) as id, 'Known ' || cast(110 + 5 * i as varchar) as name, cast(null as bigint) as products from range(4) t(i))"


def live_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = H.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("products"))
    number = (100 + F.col("size")).cast("string")
    ranked = sizes.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit("additives")).orderBy("size")) - 1)  # a row a size
    return ranked.select(F.lit("additives").alias("facet"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("en:e"), number).alias("id"), F.concat(F.lit("Additive "), number).alias("name"), "products")


def sample_vocabulary(spark: SparkSession) -> DataFrame:
    number = (110 + 5 * F.col("id")).cast("string")
    return spark.range(4).select(F.lit("additives").alias("facet"), F.col("id").alias("ord"), F.concat(F.lit("en:e"), number).alias("id"), F.concat(F.lit("Known "), number).alias("name"), F.lit(None).cast("long").alias("products"))


@query(f"with {_LIVE} select id, name, products from live order by ord limit 20")
def vocab_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.limited(live_vocabulary(spark, sf_dir), 20).select("id", "name", "products")


@query("select concat('en:', lower(replace(n_name, ' ', '-'))) as id, n_name as name from nation where contains(lower(n_name), '_1') or contains(lower(n_name), 'an') or contains(lower(n_name), '1')")
def vocab_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term is literal: no wildcards. Three terms, so that the query finds something in any naming of nations."""
    nations = H.table(spark, sf_dir, "nation").select(F.concat(F.lit("en:"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("id"), F.col("n_name").alias("name"))
    plain = nations.withColumn("id", F.lit(""))  # names alone are searched here
    found = reduce(DataFrame.unionByName, [vocabulary.matching(plain, t).select("name") for t in ("_1", "AN", "1")]).distinct()
    return nations.join(found, "name", "left_semi").select("id", "name")


@query(f"with {_LIVE}, {_SAMPLE}, u as (select 0 as src, * from sample union all select 1, * from live), r as (select *, row_number() over (partition by id order by src, ord) as k from u where contains(lower(id), 'e11') or contains(lower(name), 'e11')) select cast(src as int) as src, id, name from r where k = 1 order by src, ord limit 8")
def vocab_merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = vocabulary.merged(vocabulary.matching(sample_vocabulary(spark), "E11"), vocabulary.matching(vocabulary.complete(live_vocabulary(spark, sf_dir)), "E11"))
    return vocabulary.limited(both, 8).select("src", "id", "name")


@query(f"with {_LIVE}, {_SAMPLE} select id, name from live where id not in (select id from sample)")
def vocab_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.new_entries(sample_vocabulary(spark), live_vocabulary(spark, sf_dir)).select("id", "name")


@query(PART + ", t as (select 'category' as facet, unnest(list_distinct(categories_tags)) as tag from p union all select 'label', unnest(labels_tags) from p union all select 'brand', unnest(brands_tags) from p union all select 'allergen', unnest(allergens_tags) from p union all select 'additive', unnest(additives_tags) from p), c as (select facet, tag, count(*) as products from t group by all) select *, cast(sum(products) over (partition by facet) as bigint) as total_in_facet from c")
def vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = P.tag_counts(P.tag_index(H.products(spark, sf_dir), H.SPEC))
    return counts.join(counts.groupBy("facet").agg(F.sum("products").alias("total_in_facet")), "facet")


@query("select * from (values ('categories', 79), ('labels', 30), ('allergens', 27), ('additives', 44), ('countries', 30), ('nova_groups', 4), ('nutrition_grades', 5)) t(facet, total_in_facet)")
def vocab_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries a facet of the built-in vocabulary."""
    return seed(spark).groupBy("facet").agg(F.count(F.lit(1)).cast("int").alias("total_in_facet"))


# State ---------------------------------------------------------------------------------------------------


@query("""with recursive e as (select user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
  r as (select user_id, rn, [t] as live, cast(1 as bigint) as admitted from e where rn = 1
    union all select user_id, rn, case when len(f) < 2 then list_append(f, t) else f end, admitted + case when len(f) < 2 then 1 else 0 end
    from (select r.user_id, e.rn, e.t, r.admitted, list_filter(r.live, lambda x: x >= e.t - 3600000000) as f from r join e on e.user_id = r.user_id and e.rn = r.rn + 1))
  select user_id, max(rn) as events, max(admitted) as admitted from r group by 1""")
def rate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = H.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    judged = admission.verdicts(events, "user_id", "ts", "event_id", 2, 3600)
    return judged.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if("admitted").alias("admitted"))


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
  r as (select user_id, event_id, rn, [t] as live, cast(null as bigint) as wait from e where rn = 1
    union all select user_id, event_id, rn, case when len(f) < 2 then list_append(f, t) else f end, case when len(f) < 2 then null else greatest(1, cast(ceil((f[1] + 3600000000 - t) / 1000000.0) as bigint)) end
    from (select r.user_id, e.event_id, e.rn, e.t, list_filter(r.live, lambda x: x >= e.t - 3600000000) as f from r join e on e.user_id = r.user_id and e.rn = r.rn + 1))
  select event_id, cast(wait as double) as retry_after_s from r""")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every request the seconds until one would be admitted; none for those admitted."""
    events = H.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return admission.verdicts(events, "user_id", "ts", "event_id", 2, 3600).select("event_id", F.col("retry_after_s").cast("double").alias("retry_after_s"))


# Mirror --------------------------------------------------------------------------------------------------


@query("""with c as (select p_partkey as id, p_name as name, cast(1 as bigint) as version from part where p_partkey % 3 <> 0), n as (select p_partkey as id, upper(p_name) as name, cast(p_partkey % 3 as bigint) as version, p_partkey % 7 = 0 as gone from part where p_partkey % 2 = 0),
  u as (select *, false as gone, 0 as src from c union all select *, 1 from n), r as (select *, row_number() over (partition by id order by version desc, src desc) as k from u) select id, name, version from r where k = 1 and not gone""")
def mirror_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pantry.operators.mirror import upserted

    part = H.table(spark, sf_dir, "part")
    current = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(1).cast("long").alias("version"))
    changes = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), (F.col("p_partkey") % 3).alias("version"), (F.col("p_partkey") % 7 == 0).alias("gone"))
    return upserted(current, changes, "id", "version", "gone")


