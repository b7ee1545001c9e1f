"""Language, toxicity, quality and fertility: held-out accuracy, odd rows, brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pantry.llm import fertility, language, quality, queries, toxicity
from tests.llm.cases import empty, odd, prose, words

SF = "/root/testdata/sf0.01"


def held(rows, name):
    return [r for r in rows if r["held_out"] and r[name] is not None]


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_language(spark, SF).collect()
    own = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in own) >= 0.98 * len(own)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = odd(spark)
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identified(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 6))
    assert got[7]["lang_pred"] == "en" and got[5]["lang_pred"] == "xx"
    assert got[7]["lang"] == "en" and got[7]["_key"] == 7
    assert language.train(empty(spark)) is None
    assert {r["lang_pred"] for r in language.identified(docs, None).collect()} == {"und"}
    assert language.identified(empty(spark), model).count() == 0


def test_language_learns_from_small_languages_too(spark):
    rows = [(i, " ".join(f"{a}{b}{c}{d}" for a in "abcdefghijklmnopqrst"[i : i + 1] for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst" for d in "abcdefghijklmnopqrst") + " ", "en") for i in range(20)]
    rows = [(i, text * 2, x) for i, text, x in rows] + [(100, "天地玄黃宇宙洪荒", "zh"), (101, "寒來暑往秋收冬藏", "zh")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = spark.createDataFrame([(1, "天地玄黃宇宙洪荒"), (2, "bcde fghi"), (3, "秋收")], "doc_id long, text string")
    zh = model.languages.index("zh")
    assert len(model.words.hashes) == 160_000 and all((model.grams[k].owner == zh).any() for k in (1,))
    assert {r["doc_id"]: r["lang_pred"] for r in language.identified(new, model).collect()} == {1: "zh", 2: "en", 3: "zh"}


def test_language_backs_off():
    model = language.fit([("a", "kolorado", 5), ("b", "zypresse", 5)], {"a": 1, "b": 1})
    import pyarrow as pa

    from pantry.llm import text as T

    assert language.predict(model, *T.view(pa.array(["kolora", "zypr", "zz", "oo"])))[0] == ["a", "b", "b", "a"]


def test_toxicity_held_out(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, SF).collect()
    own = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 1000 and sum(a == b for a, b in own) >= 0.93 * len(own)
    assert sum(a for a, b in own if not b) <= 0.02 * len(own)


def labelled_texts(n=120):
    r = random.Random(5)
    out = []
    for i in range(n):
        bad = i % 4 == 0
        w = prose(i, 60, 300).split()
        if bad:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(("idiot", "scum"))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_learns_words_and_ignores_labels_at_scoring(spark):
    rows = labelled_texts()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (9999, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, learn=F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    wrong = [i for i, _, y in rows if i % 3 == 0 and (got[i] >= 0.5) != bool(y)]
    assert len(wrong) <= 1
    out = toxicity.scored(odd(spark), model)
    assert out.count() == odd(spark).count() and {r["score"] for r in out.where("doc_id in (1, 2, 3)").collect()} == {out.where("doc_id = 1").first()["score"]}
    assert toxicity.scored(empty(spark), model).count() == 0
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.scored(docs, None).collect()} == {0.0}


def test_toxicity_learns_the_same_however_rows_are_dealt(spark):
    rows = labelled_texts(60) + [(500, "", 0), (501, None, 1), (502, "word " * 100_000, 0)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    models = [toxicity.train(spark.createDataFrame(rows[::step], "doc_id long, text string, y int").repartition(n), labels) for step, n in ((1, 1), (-1, 7))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias
    whole = sorted(rows, key=lambda x: x[0])
    import pyarrow as pa

    from pantry.llm import text as T

    plain = toxicity.fit([toxicity.features(*T.view(pa.array([t for _, t, _ in whole])))], np.array([y for _, _, y in whole]))
    assert np.allclose(models[0].weights, plain.weights, atol=1e-4) and abs(models[0].bias - plain.bias) < 1e-6


def test_quality_held_out(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op8_quality(spark, SF).collect()
    own = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 1000 and sum(a == b for a, b in own) >= 0.97 * len(own)


def test_quality_odd_rows(spark):
    rows = [(100 + i, prose(i, 60), 1) for i in range(30)] + [(200 + i, "### $$$ " * (20 + i), 0) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 0), (101, None)], "doc_id long, quality int")
    model, share = quality.train(quality.statistics(docs), labels)
    got = {r["key"]: r["score"] for r in quality.scored(quality.statistics(docs), model, share).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows) and share == pytest.approx(0.6)
    out = quality.scored(quality.statistics(odd(spark)), model, share).collect()
    assert len(out) == odd(spark).count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["key"] in (1, 2, 3)}) == 1
    none, share = quality.train(quality.statistics(docs), labels.limit(0))
    assert none is None and {r["score"] for r in quality.scored(quality.statistics(docs), none, share).collect()} == {0.0}
    assert quality.scored(quality.statistics(empty(spark)), model, share).count() == 0


def test_fertility_rejects_what_is_no_prose(spark):
    r = random.Random(2)
    common = "the of and to in is that for it was on are with as be this have from or had by but not what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more".split()
    docs = [(i, " ".join(r.choice(common) for _ in range(r.randrange(70, 200))), "en") for i in range(80)]
    docs += [(100 + i, " ".join("".join(r.choice("QWXZJK0123456789+/") for _ in range(30)) for _ in range(60)), "en") for i in range(3)]
    docs += [(200 + i, " ".join(chr(0x10A0 + r.randrange(30)) * 5 for _ in range(60)), "en") for i in range(2)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {x["key"]: x for x in fertility.judged(fertility.measured(table, queries.vocabulary("piece_bpe_32k.model"))).collect()}
    assert all(got[i]["kept"] for i in range(80))
    assert all(not got[100 + i]["kept"] and not got[100 + i]["base_failed"] and got[100 + i]["reasons"] for i in range(3))
    assert all(got[200 + i]["byte_share"] > 0.5 for i in range(2))


def test_fertility_odd_rows(spark):
    docs = odd(spark)
    got = fertility.judged(fertility.measured(docs, queries.vocabulary("piece_bpe_32k.model"))).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] is not None and not (r["base_failed"] and r["kept"])
    texts = {(r["doc_id"], len(words(r["text"]))) for r in docs.collect()}
    assert {(r["key"], r["n_words"]) for r in got} == texts
    assert fertility.judged(fertility.measured(empty(spark), queries.vocabulary("piece_bpe_32k.model"))).count() == 0


def test_language_learns_three_hundred_languages(spark):
    def word(x, i):
        return f"{chr(0x4E00 + 3 * x)}{chr(0x4E00 + 3 * x + i % 3)}{'abc'[i % 3]}"

    rows = [(j, " ".join(word(x, i) for i in range(12)), f"l{x:03d}") for j, x in enumerate([x for x in range(299) for _ in range(3)] + [299])]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300
    got = language.identified(spark.createDataFrame([(1, word(299, 1)), (2, chr(0x4E00 + 897) + "q"), (3, word(0, 2))], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "l299", 2: "l299", 3: "l000"}


def test_fertility_bands_are_brute_force(spark):
    from collections import Counter, defaultdict
    from fractions import Fraction

    r = random.Random(8)
    rows = [(i, x, s, n, 0, 0, 0, 0, round(r.gauss(4 if x == "a" else 5, 0.3), 4), 0.0, round(r.gauss(0.6, 0.05), 4)) for i, (x, s, n) in enumerate([("a", "latin", 60)] * 200 + [("b", "latin", 60)] * 40 + [("c", "latin", 120)] * 3 + [("d", "greek", 120)] * 2 + [("a", "latin", 20)] * 4)]
    rows.append((999, "a", "latin", 60, 0, 0, 0, 0, 9.0, 0.5, 0.6))
    table = spark.createDataFrame(rows, f"key long, language string, script string, {', '.join(f'{x} long' for x in fertility.BASE)}, {', '.join(f'{x} double' for x in fertility.MEASURES)}")
    got = {x["key"]: set(x["reasons"]) for x in fertility.judged(table).collect()}

    def size(n):
        return sum(n >= s for s in fertility.SIZES)

    counts = defaultdict(Counter)
    for row in rows:
        if row[3] >= 50:
            for m, value in zip(fertility.MEASURES, row[8:]):
                for group in ((row[2], row[1], size(row[3])), (row[2], size(row[3])), (size(row[3]),)):
                    counts[group, m][min(int(value / fertility.BINS[m]), fertility.LAST_BIN)] += 1
    expected = {}
    for row in rows:
        out = {"base"} if row[3] < 50 else set()
        if (group := (row[2], row[1], size(row[3]))) and (group, fertility.MEASURES[0]) in counts:
            for m, value in zip(fertility.MEASURES, row[8:]):
                own, wide, widest = counts[group, m], counts[(row[2], size(row[3])), m], counts[(size(row[3]),), m]
                n1, n2 = sum(wide.values()), sum(widest.values())
                weight = {b: own[b] + Fraction(30 * wide[b], n1 + 30) + Fraction(30 * widest[b], n2) * Fraction(30, n1 + 30) for b in widest}
                total, up, q = sum(weight.values()), 0, []
                for b in sorted(weight):
                    up += weight[b]
                    q += [b] * (int(4 * up / total + Fraction(1, 10**6)) - len(q)) if len(q) < 3 else []
                half = max(3.0 / 1.349 * fertility.BINS[m] * (q[2] - q[0]), fertility.SLACK[m])
                middle = (q[1] + 0.5) * fertility.BINS[m]
                out |= {m} if not middle - half <= value <= middle + half else set()
        expected[row[0]] = out
    assert got == expected and got[999] == {"chars_per_token", "byte_share"} and sum(map(len, got.values())) < 20


def test_fertility_rejects_low_quality_and_keeps_the_rest(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.op9_fertility(spark, SF).collect() if not r["base_failed"] and labels.get(r["doc_id"]) is not None]
    low, good = ([r["kept"] for r in rows if labels[r["doc_id"]] == y] for y in (0, 1))
    assert sum(good) >= 0.97 * len(good) and sum(low) <= 0.5 * len(low)


def test_lines_that_hash_alike_are_no_duplicates():
    from pantry.llm import stats
    from pantry.llm import text as T
    from tests.llm.cases import alike

    import pyarrow as pa

    x, y = alike()
    assert stats.base(*T.view(pa.array([x + "\n" + y, x + "\n" + x])))["n_dup_lines"].tolist() == [0, 1]


def test_toxicity_score_is_the_sum_of_weighted_ngrams():
    import pyarrow as pa

    from pantry.llm import text as T

    docs = [prose(i, 12, 40) + (" idiot" if i % 3 == 0 else "") for i in range(60)]
    model = toxicity.fit([toxicity.features(*T.view(pa.array(docs)))], np.array([int(i % 3 == 0) for i in range(60)]))
    got = toxicity.score(model, *T.view(pa.array([*docs, "", None])))
    by_features = []
    for d in [*docs, "", ""]:
        text, column, count, n_words = toxicity.features(*T.view(pa.array([d])))
        z = float((model.weights[column] * count).sum()) / max(int(n_words[0]), 1) ** model.power + model.bias
        by_features.append(1 / (1 + np.exp(-z)))
    assert np.allclose(got, by_features, atol=1e-6) and all((s >= 0.5) == (i % 3 == 0) for i, s in enumerate(got[:60]))


def test_quality_score_is_the_ratio_of_densities():
    r = np.random.default_rng(3)
    rows = {y: r.normal(y, 1 + y, (200, 4)) for y in (0, 1)}
    model = quality.solve({y: (float(len(x)), x.sum(0), x.T @ x) for y, x in rows.items()}, pooled_share=0.2, ridge=0.002)
    pooled = sum(len(x) * np.cov(x.T, bias=True) for x in rows.values()) / 400
    x = r.normal(0.5, 2, (50, 4))
    log = []
    for y in (0, 1):
        c = 0.798 * np.cov(rows[y].T, bias=True) + 0.2 * pooled + (0.002 * np.trace(pooled) / 4 + 1e-9) * np.eye(4)
        d = x - rows[y].mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(quality.score(model, x), 1 / (1 + np.exp(-(log[1] - log[0]))), atol=1e-9)
