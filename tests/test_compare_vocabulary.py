"""Comparison, vocabulary, admission, errors, settings, workspace, streaming."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pantry.operators import admission, compare, vocabulary, workspace
from pantry.operators.admission import Limiter
from pantry.operators.resilience import with_retries, within
from pantry.plans.engine import Catalog, to_text
from pantry.plans.errors import CatalogError, detail_of, failure, reason_of
from pantry.plans.requests import CompareRequest, VocabularyRequest
from pantry.plans.schema import RAW_PRODUCT, VOCABULARY
from pantry.sources import seed as seeds
from pantry.sources.config import Settings
from pantry.streaming import admission as streaming


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        {"code": "10000001", "product_name": "A", "brands": "X", "nutriscore_grade": "e", "nova_group": 4, "completeness": 0.85, "n": {"energy-kcal_100g": 539, "fat_100g": 30.9, "sugars_100g": 56.3}},
        {"code": "10000002", "product_name": "B", "nutriscore_grade": "c", "nova_group": 3, "completeness": 0.4, "n": {"energy-kcal_100g": 580, "fat_100g": 50, "sugars_100g": 8}},
        {"code": "10000003", "product_name": "", "n": None},
    ]
    import json

    frame = spark.createDataFrame([(r["code"], r.get("product_name"), r.get("brands"), r.get("nutriscore_grade"), r.get("nova_group"), r.get("completeness"), json.dumps(r["n"]) if r["n"] else None) for r in rows], "code string, product_name string, brands string, nutriscore_grade string, nova_group int, completeness double, n string")
    own = frame.withColumn("nutriments", F.from_json("n", "map<string,variant>")).drop("n")
    return own.select(*[F.col(f.name) if f.name in own.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_PRODUCT.fields])


def test_compare_keeps_order_repeats_and_misses(products):
    asked = ("10000002", "99999999", "10000001", "10000002")
    r = compare.compare(products, CompareRequest(asked))
    assert [p["barcode"] for p in r.products] == list(asked) and [p["found"] for p in r.products] == [True, False, True, True]
    assert r.succeeded == 3 and r.not_found == ["99999999"] and r.failed is None and r.low_completeness == ["B", "B"]
    assert r.products[1] == {"barcode": "99999999", "found": False}
    assert r.products[2] == {"barcode": "10000001", "found": True, "product_name": "A", "brands": "X", "nutriscore_grade": "e", "nova_group": 4, "completeness": 0.85, "energy_kcal_100g": 539, "fat_100g": 30.9, "sugars_100g": 56.3}
    text = to_text(r)
    assert "3 of 4 products found" in text and "Under 50% complete, so many fields may be missing: B" in text and "| 10000001 | 539 | 30.9 | N/A | 56.3 |" in text and "| 99999999 | false | N/A |" in text


def test_compare_failed_is_neither_found_nor_missing(spark, products):
    bad = spark.createDataFrame([("10000009", None, "broken"), ("10000001", "upstream_timeout", "late")], "code string, reason string, error string")
    r = compare.compare(products, CompareRequest(("10000009", "10000003", "10000001", "99999999")), bad)
    assert r.failed == [{"barcode": "10000009", "reason": "upstream_error", "error": "broken"}, {"barcode": "10000001", "reason": "upstream_timeout", "error": "late"}]
    assert [p["barcode"] for p in r.products] == ["10000003", "99999999"] and r.not_found == ["99999999"] and r.succeeded == 1
    assert r.products[0] == {"barcode": "10000003", "found": True} and "1 of 4 products found" in to_text(r) and "| 10000001 | upstream_timeout | late |" in to_text(r)


@pytest.mark.parametrize("n", [1, 11])
def test_batch_size(n):
    with pytest.raises(CatalogError):
        CompareRequest(tuple(f"{i:08d}" for i in range(n)))


def live(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], VOCABULARY)


def test_seed_vocabulary():
    v = seeds.vocabulary()
    assert {k: len(x) for k, x in v.items()} == {"categories": 79, "labels": 30, "allergens": 27, "additives": 44, "countries": 30, "nova_groups": 4, "nutrition_grades": 5}
    assert ("en:plant-based-milks", "Plant-based milks") in v["categories"] and ("en:e322", "E322 Lecithins") in v["additives"] and v["labels"][1] == ("en:fair-trade", "Fair trade")
    assert all(len({i for i, _ in x}) == len(x) for x in v.values())


def test_vocabulary(spark):
    seed = seeds.seed(spark)

    def ask(facet, search=None, limit=20, full=None):
        return vocabulary.browse(seed, VocabularyRequest(facet, search, limit), full)

    r = ask("allergens", "MILK")
    assert r.tags == [{"id": "en:milk", "name": "Milk"}] and r.notice is None and r.total_in_facet is None
    assert [t["id"] for t in ask("nova_groups").tags] == list("1234") and ask("nova_groups").total_in_facet == 4
    assert ask("nutrition_grades", "highest").matched_in_facet == 1 and ask("nutrition_grades", "x%").total_in_facet == 5
    table = live(spark, [("labels", 0, "en:organic", "Again"), ("labels", 1, "en:organic-beers", "Organic beers"), ("labels", 2, "en:organic-beers", "Twice"), ("labels", 3, "", "organic"), ("labels", 4, "en:organic-x", None), ("categories", 5, "en:hummus", "Houmous"), ("additives", 6, "en:e330", "Acid"), ("additives", 7, "en:e331z", "E33 noise")])
    r = ask("labels", "organic", full=table)
    assert [t["id"] for t in r.tags] == ["en:organic", "en:eu-organic", "en:usda-organic", "en:organic-beers"] and r.tags[0]["name"] == "Organic"
    assert [t["id"] for t in ask("categories", "  hummus ", full=lambda: table).tags] == ["en:hummus"]
    assert [t["id"] for t in ask("additives", "e330", full=table).tags] == ["en:e330"]
    r = ask("labels", " ", 3)
    assert len(r.tags) == 3 and r.truncated and (r.shown, r.cap, r.matched_in_facet) == (3, 3, 30) and "sample" in r.notice and "3 of 30" in r.notice
    assert ask("labels", "zzz").notice and not ask("labels", "zzz").truncated and ask("labels", "zzz").tags == []
    assert not ask("labels", "gluten", 5).truncated and ask("labels", "no", 3).truncated
    assert ask("additives", "_").tags == [] and {"en:e322"} <= {t["id"] for t in ask("additives", "Lecithin").tags} & {t["id"] for t in ask("additives", "e322").tags}

    def down():
        raise OSError("no such host")

    r = ask("labels", "organic", full=down)
    assert len(r.tags) == 3 and "no such host" in r.notice
    r = ask("labels", "nothing", full=lambda: spark.read.parquet("/nowhere/at/all"))
    assert r.tags == [] and "could not be read" in r.notice
    assert "| en:milk | Milk |" in to_text(ask("allergens", "milk")) and "of 4" in to_text(ask("nova_groups"))
    for bad in (("colours", None, 5), ("labels", None, 0), ("labels", None, 101)):
        with pytest.raises(CatalogError):
            VocabularyRequest(*bad)
    counted = vocabulary.with_counts(table, spark.createDataFrame([("labels", "en:organic", 7)], "facet string, tag string, products long"))
    assert {r["id"]: r["products"] for r in counted.where("facet = 'labels'").collect()}["en:organic"] == 7


def reference_verdicts(times, most, window):
    stamps, out = [], []
    for t in times:
        stamps = [s for s in stamps if s >= t - window]
        out.append(len(stamps) < most)
        if out[-1]:
            stamps.append(t)
    return out


def events(spark, n=600):
    r = random.Random(4)
    rows = [(i, r.randrange(3), r.randrange(4000)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, user long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_admission(spark):
    rows, frame = events(spark)
    got = {r["event_id"]: (r["admitted"], r["retry_after_s"]) for r in admission.verdicts(frame, "user", "ts", "event_id", 3, 60).collect()}
    for u in range(3):
        own = sorted(((s, i) for i, user, s in rows if user == u))
        assert [got[i][0] for _, i in own] == reference_verdicts([s for s, _ in own], 3, 60)
    assert all((w is None) == a and (w is None or 1 <= w <= 60) for a, w in got.values())
    assert admission.verdicts(frame.limit(0), "user", "ts", "event_id", 3, 60).count() == 0
    assert admission.retry_after(0, 60_000, 60_000) == 1 and admission.retry_after(1000, 2500, 60_000) == 59


def test_streaming_admission_is_the_batch_one(spark, tmp_path):
    _, frame = events(spark, 200)
    ordered = frame.orderBy("ts", "event_id")
    for k, part in enumerate(([r for r in ordered.collect()][:100], [r for r in ordered.collect()][100:])):
        spark.createDataFrame(part, frame.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = streaming.verdicts(stream, "user", "ts", "event_id", 3, 60).writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in admission.verdicts(frame, "user", "ts", "event_id", 3, 60).collect()}
    assert {tuple(r) for r in spark.table("judged").collect()} == batch


def test_limiter_and_engine(spark, products):
    now = [0.0]
    limiter = Limiter({"product": 2, "search": 1, "vocabulary": 1}, lambda: now[0])
    c = Catalog(products, full=live(spark, [("labels", 0, "en:organic-x", "Organic x")]), limiter=limiter)
    c.get_product("10000001")
    r = c.compare_products(["10000002", "10000001"])
    assert [p["barcode"] for p in r.products] == ["10000002"] and r.failed[0]["reason"] == "rate_limited"
    with pytest.raises(CatalogError) as e:
        c.get_product("10000001")
    assert e.value.reason == "rate_limited" and e.value.data["retryAfter"] == 60 and e.value.retryable
    with pytest.raises(CatalogError):
        c.search_products()  # refused before it takes a slot
    c.search_products(query="a")
    assert c.browse_vocabulary("labels", "organic").matched_in_facet == 4
    r = c.browse_vocabulary("labels", "organic")
    assert r.matched_in_facet == 3 and "budget" in r.notice
    now[0] = 60.001
    c.get_product("10000001")


def test_settings():
    assert Settings.from_env({}) == Settings(15, 10, 10, None)
    assert Settings.from_env({"PANTRY_RATE_LIMIT_PRODUCT": "5"}).product == 5
    for bad in ("0", "x", "1.5"):
        with pytest.raises(CatalogError):
            Settings.from_env({"PANTRY_RATE_LIMIT_PRODUCT": bad})


def test_errors():
    assert [reason_of(s) for s in (400, 404, 429, 500, 503, None, 504)] == ["upstream_rejected", "upstream_rejected", "rate_limited", "upstream_error", "upstream_error", "upstream_error", "upstream_timeout"]
    assert detail_of('{"detail": "too deep"}') == "too deep" and detail_of("<!-- x --><HTML >") and detail_of("x" * 300) == "x" * 200 and detail_of(" ") is None
    assert failure("1", ValueError("odd")) == {"barcode": "1", "reason": "upstream_error", "error": "odd"}
    assert failure("1", CatalogError("upstream_timeout", "late"))["error"].startswith("late. ")


def test_retries():
    waits, calls = [], []

    def fail(reason):
        calls.append(reason)
        raise CatalogError(reason, "no")

    with pytest.raises(CatalogError):
        with_retries(lambda: fail("upstream_error"), 0.5, sleep=waits.append)
    assert len(calls) == 4 and waits == [0.5, 1.0, 2.0]
    with pytest.raises(CatalogError):
        with_retries(lambda: fail("upstream_rejected"), sleep=waits.append)
    assert len(calls) == 5


def test_deadline(spark):
    assert within(spark, lambda: spark.range(5).count(), 60) == 5
    with pytest.raises(CatalogError) as e:
        within(spark, lambda: time.sleep(3), 0.2)
    assert e.value.reason == "upstream_timeout"


def test_workspace(spark, tmp_path):
    now = [0.0]
    ws = workspace.Workspace(spark, "t", 100, lambda: now[0])
    ws.register("a", [{"x": 1, "y": "p"}, {"x": 2}, {"x": 3, "y": "q"}])
    r = ws.query("select x, y from a order by x", cap=2)
    assert r.rows == [{"x": 1, "y": "p"}, {"x": 2, "y": None}] and r.truncated
    assert not ws.query("with b as (select x from a) select sum(x) as s from b", register_as="s").truncated
    assert ws.query("select s from s").rows == [{"s": 6}]
    for bad in ("drop table a", "insert into a values (1, 'x')", "select * from parquet.`/root`", "select * from other", "create view v as select 1", "select 1; select 2", "set x=1", "show tables", "describe a", "select reflect('java.lang.System', 'getenv') from a"):
        with pytest.raises(CatalogError):
            ws.query(bad)
    ws.view("v", "select x + 1 as z from a")
    other = workspace.Workspace(spark, "u", 100, lambda: now[0])
    other.take_from(ws, "v")
    assert other.query("select max(z) as m from v").rows == [{"m": 4}]
    assert set(ws.describe()) == {"a", "s", "v"}
    for kind in ("csv", "json", "parquet"):
        path = ws.export("a", f"out_{kind}", kind, str(tmp_path))
        assert getattr(spark.read.option("header", True), kind)(path).count() == 3
    with pytest.raises(CatalogError):
        ws.export("a", "../x", "csv", str(tmp_path))
    now[0] = 150
    assert ws.describe() == {}
    with pytest.raises(CatalogError):
        ws.query("select * from a")
    frame = spark.createDataFrame([(1,)] * 5, "a int")
    assert ws.spill("everything", frame, 17) == ([{"a": 1}] * 2, "everything")
    assert ws.query("select count(*) as n from everything").rows == [{"n": 5}] and ws.spill("little", frame, 100) == ([{"a": 1}] * 5, None)


def test_workspace_gate_reads_the_tree(spark):
    ws = workspace.Workspace(spark, "gate")
    ws.register("a", [{"x": i} for i in range(150)] + [{"x": 1, "late": "here"}])
    assert ws.query("select late from a where late is not null").rows == [{"late": "here"}]  # a column that first comes late
    spark.range(3).createOrReplaceTempView("secret")
    for bad in (
        "select * from secret", "select * from secret /* secret as ( */", "select 'secret as (' from secret", "select x from a where exists (with secret as (select 1) select * from secret) and x in (select id from secret)",
        "with b as (select * from secret) select * from b", "select (select max(id) from secret) from a", "select * from a join lateral (select * from secret)", "select try_reflect('java.lang.System', 'getenv', 'x') from a",
        "select * from read_files('/root')", "from secret select id", "with b as (select * from c), c as (select 1) select * from b",
    ):
        with pytest.raises(CatalogError):
            ws.query(bad)
    for good in ("with b as (select x from a), c as (select x from b) select count(*) from c", "select x, sum(x) over (order by x) from a union all select 1, 2", "select * from range(3)", "select A.x from A where x in (select x from a)", "select x from a lateral view explode(array(1, 2)) t as y", "with secret as (select 1 as id) select * from secret", "select x, count(*) from a group by x having count(*) > 1 order by 2 desc limit 3"):
        assert ws.query(good).rows
    spark.range(7).createOrReplaceTempView("a")  # a view of the caller's with a table's name stays theirs
    assert len(ws.query("select * from a").rows) == 151 and spark.table("a").count() == 7
    spark.catalog.dropTempView("a")


def test_mirror(spark, tmp_path):
    from pantry.operators import mirror
    from pantry.plans.schema import CatalogSpec

    assert [r[0] for r in mirror.filtered(spark.range(10), [("id", "gte", 3), ("id", "in", [1, 4, 5]), ("id", "ne", 5)]).collect()] == [4]
    log = [(1, "red apple", 1, False), (2, "green apple", 2, False), (3, "pear", 3, False), (1, "red apples", 4, False), (3, None, 5, True), (4, "apple apple", 6, False)]
    folder, upto = str(tmp_path / "mirror"), 3

    def changes(cursor):
        return spark.createDataFrame([r for r in log if (cursor or 0) < r[2] <= upto], "code long, name string, version long, gone boolean")

    assert mirror.sync(spark, folder, changes, "code", "version", "gone") == (1, 3) and mirror.read(spark, folder).count() == 3
    assert mirror.sync(spark, folder, changes, "code", "version", "gone") == (1, 3)  # nothing new, nothing written
    upto = 6
    assert mirror.sync(spark, folder, changes, "code", "version", "gone") == (2, 6)
    spec = CatalogSpec(key="code", text=("name",))
    rows = mirror.read(spark, folder)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "red apples", 4), (2, "green apple", 2), (4, "apple apple", 6)]
    assert [r["code"] for r in mirror.selected(rows, spec, match="Apple").collect()] == [4, 2]
    assert [r["code"] for r in mirror.selected(rows, spec, filters=[("version", "gt", 2)], sort="version", descending=True, limit=1, offset=1).collect()] == [1]
    with pytest.raises(CatalogError):
        mirror.read(spark, str(tmp_path / "none"))


def test_full_vocabulary_by_name(spark, products, tmp_path):
    live(spark, [("labels", 0, "en:organic-y", "Organic y")]).write.parquet(str(tmp_path / "label"))
    c = Catalog(products, settings=Settings(vocabularies=str(tmp_path), deadline_s=120), sleep=lambda s: None)
    assert "en:organic-y" in {t["id"] for t in c.browse_vocabulary("labels", "organic").tags}
    assert "could not be read" in c.browse_vocabulary("categories", "organic").notice
    assert c.browse_vocabulary("nova_groups", "1").notice is None


def test_index_and_files(spark, products, tmp_path):
    from pantry.sources import products as P

    spread = spark.createDataFrame([(f"{i:08d}", ["en:a", "en:a"] if i % 2 else ["en:b"], ["en:x"]) for i in range(40)], "code string, categories_tags array<string>, labels_tags array<string>")
    P.write_tag_index(P.tag_index(spread), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    found = P.by_tags(spread, index, {"category": "en:a", "label": "en:x"})
    assert found.count() == 20 and {tuple(r) for r in P.tag_counts(index).collect()} == {("category", "en:a", 20), ("category", "en:b", 20), ("label", "en:x", 40)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(facet" in plan and "EqualTo(tag,en:a)" in plan
    P.write_parquet(spread, str(tmp_path / "p"))
    assert P.read_parquet(spark, str(tmp_path / "p")).count() == 40
    P.write_json(spread, str(tmp_path / "j"))
    again, bad = P.read_json(spark, str(tmp_path / "j"))
    assert again.count() == 40 and bad.count() == 0
