"""n-gram join, components, substring dedup, decontamination against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pantry.llm import decontamination, ngram_join, substring
from pantry.llm.components import components
from tests.llm.cases import alike, empty, lowered, odd, plain, prose, words


def classes(keys, links):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {k: root(k) for k in keys}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)] + [(5, 5)]
    expected = classes({x for p in links for x in p}, links)
    got = {r[0]: r[1] for r in components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in expected.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, k):
    w = words(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, rule):
    sets = [(key, shingle_set(t, rule.k)) for key, t in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i][1] and sets[j][1] and rule.of * len(sets[i][1] & sets[j][1]) >= rule.share * len(sets[i][1] | sets[j][1])]
    own = classes(range(len(sets)), links)
    out = {}
    for i, (key, s) in enumerate(sets):
        keys = [sets[j][0] for j in own if own[j] == own[i] and sets[j][0] is not None]
        out[i] = (key, len(s), min(keys) if keys else None)
    return sorted(out.values(), key=str)


def near_copies(seed=1):
    r = random.Random(seed)
    texts = []
    passage = prose("shared", 30)
    for g in range(12):
        base = prose(f"g{g}", r.choice((3, 4, 5, 40, 120))).split()
        for _ in range(r.choice((1, 4, 12))):
            copy = list(base)
            for _ in range(r.randrange(5)):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(9)}"
            texts.append(" ".join(copy) + (" " + passage if r.random() < 0.3 else ""))
    return texts


@pytest.mark.parametrize(("rule", "hot"), [(ngram_join.Rule(4, 85, 100), 4), (ngram_join.Rule(5, 80, 100), 64), (ngram_join.Rule(4, 85, 100), 2)])
def test_ngram_join_is_brute_force(spark, rule, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)  # larger groups are families, in blocks of five
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = list(enumerate(near_copies()))
    got = sorted((tuple(r) for r in ngram_join.linked(plain(spark, [t for _, t in rows]), rule).collect()), key=str)
    assert got == brute(rows, rule)


def test_ngram_join_odd_rows(spark):
    docs = odd(spark)
    got = sorted((tuple(r) for r in ngram_join.linked(docs).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], ngram_join.Rule())
    assert ngram_join.linked(empty(spark)).count() == 0


def test_ngram_join_tells_words_apart_that_hash_alike(spark):
    x, y = alike()
    assert [r["component"] for r in ngram_join.linked(plain(spark, [x, y])).orderBy("key").collect()] == [0, 1]


def test_ngram_join_filters_of_all_orders_come_before_the_sets():
    import pyarrow as pa

    r, rule, classes = random.Random(9), ngram_join.Rule(4, 85, 100), np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8)
    base, texts = prose("orders", 60).split(), []
    for i in range(60):
        copy = list(base)
        for _ in range(3 * (i % 6)):
            copy[r.randrange(60)] = f"edit{i}"
        texts.append(" ".join(copy))
    values, ranges = ngram_join.sets(rule, pa.array(texts))
    own = [values[a:b] for a, b in zip(ranges, ranges[1:])]
    heads = []
    for v in own:
        length = len(v) - rule.least_overlap(len(v)) + 1
        heads.append(np.concatenate([(v[np.argsort(ngram_join.order_keys(v, classes, o))[:length]] >> np.uint64(32)).astype(np.uint32) for o in range(3)]))
    pairs = [(i, j) for i in range(60) for j in range(i)]
    linked = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(own[i], own[j])) >= 85 * len(np.union1d(own[i], own[j]))}
    left = [{p for p in pairs if all(ngram_join.meet(heads[p[0]], heads[p[1]])[:n])} for n in range(4)]
    assert linked <= left[3] and len(left[3]) < len(left[2]) < len(left[1]) < len(left[0])  # each order removes candidates and no link


def test_cells_bound_the_overlap():
    r = np.random.default_rng(1)
    for n, m in ((5, 6), (100, 115), (900, 1020), (63, 64)):
        pool = r.integers(0, 2**63, n + m).astype(np.uint64) * np.uint64(2)
        x, y = np.sort(pool[:n]), np.sort(np.concatenate((pool[: n // 2], pool[n : n + m - n // 2])))
        cx, rx = ngram_join.cells(x, np.array([0, len(x)]))
        cy, ry = ngram_join.cells(y, np.array([0, len(y)]))
        assert len(np.intersect1d(x, y)) <= ngram_join.most_overlap(cx, cy) <= min(n, m)
        assert ngram_join.most_overlap(cx, cx) == n


def test_substring_finds_planted_passages_and_no_others(spark):
    a, b = prose("a", 60), prose("b", 110).split()
    edited = list(b)
    edited[55] = "changed"
    texts = [
        prose(0, 50) + " " + a + " " + prose(1, 40),
        prose(2, 200),
        prose(3, 30) + " " + a.upper().replace("W", "w") + " " + prose(4, 30),
        prose(5, 80) + " " + " ".join(b),
        " ".join(edited) + " " + prose(6, 90),
        prose(7, 100) + " " + " ".join(prose("a", 60).split()[:30]),  # 30 words are too few
        a,
    ]
    got = {(r["key"], r["partner"]): (r["start"], r["stop"], r["similarity"]) for r in substring.repeated(plain(spark, texts)).collect()}
    assert set(got) == {(2, 0), (4, 3), (6, 0)}
    assert got[2, 0] == (30, 90, 1.0) and got[6, 0] == (0, 60, 1.0)
    assert got[4, 3][:2] == (0, 110) and 0.8 <= got[4, 3][2] < 1


def test_substring_group_of_copies_and_removal(spark):
    a = prose("hot", 70)
    texts = [prose(i, 40) + " \n" + a + "\n " + prose(100 + i, 40) for i in range(60)]
    docs = plain(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    passages = substring.repeated(docs)
    assert sorted((r["key"], r["start"], r["stop"]) for r in passages.collect()) == [(i, 40, 110) for i in range(1, 60)]
    cut = {r["doc_id"]: r for r in substring.removed(docs, passages, size="n_chars").collect()}
    assert cut[0]["text"] == texts[0]
    assert all(cut[i]["text"] == prose(i, 40) + " \n" + prose(100 + i, 40) and cut[i]["n_chars"] == len(cut[i]["text"]) for i in range(1, 60))


def test_substring_looks_beyond_first_and_last_partner(spark):
    a = prose("base", 60).split()
    places = [12, 17, 22, None, 27, 32, 37, 42, 47]  # where a word is changed; two variants are under 0.8 alike, each is 0.84 to the unchanged one
    texts = [prose(200 + d, 40) + " " + " ".join("other" if i == place else w for i, w in enumerate(a)) + " " + prose(300 + d, 40) for d, place in enumerate(places)]
    got = {r["key"]: (r["partner"], r["start"], r["stop"]) for r in substring.repeated(plain(spark, texts)).collect()}
    assert got == {3: (0, 40, 100), **{d: (3, 40, 100) for d in range(4, 9)}}
    line = prose("line", 20)  # a line that all have, and a passage that only the sixth and the last have
    texts = [prose(400 + d, 60) + " " + line + " " + (prose("tail", 40) if d in (5, 11) else prose(500 + d, 40)) for d in range(12)]
    got = {r["key"]: (r["partner"], r["start"], r["stop"]) for r in substring.repeated(plain(spark, texts)).collect()}
    assert got == {11: (5, 60, 120)}


def test_substring_periodic_passages(spark):
    for period, times in ((1, 60), (6, 10), (6, 100), (11, 6), (12, 5), (13, 5)):
        line = " ".join(prose(f"period{period}", period).split() * times)
        texts = [prose(600 + d, 40 + d) + " " + line + " " + prose(700 + d, 40) for d in range(4)]
        got = {r["key"]: (r["start"], r["stop"]) for r in substring.repeated(plain(spark, texts)).collect()}
        assert got == {d: (40 + d, 40 + d + period * times) for d in (1, 2, 3)}, period


def test_substring_repeated_keys_with_different_texts(spark):
    a = prose("twice", 60)
    rows = [(1, a), (2, prose(800, 90) + " " + a), (2, prose(801, 120)), (2, prose(801, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    passages = substring.repeated(docs)
    assert [(r["key"], r["start"], r["stop"]) for r in passages.collect()] == [(2, 90, 150)]
    assert sorted(r["text"] for r in substring.removed(docs, passages).collect()) == sorted([a, prose(800, 90) + " ", prose(801, 120), prose(801, 120)])


def test_substring_is_brute_force(spark):
    """What windows of 50 words share with windows of earlier texts that are 0.8 alike is covered, and hardly anything else."""
    r = random.Random(11)
    texts, passages = [], [prose(f"passage{i}", r.choice((50, 55, 70, 120))) for i in range(5)]
    for d in range(36):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts.append(prose(r.random(), r.randrange(0, 60)))
            piece = r.choice(passages).split()
            for _ in range(r.choice((0, 0, 1, 1, 2, 5))):
                at = r.randrange(len(piece))
                piece[at : at + 1] = r.choice(([f"edit{d}"], [], [piece[at], f"more{d}"]))
            parts.append(" ".join(piece[r.choice((0, 0, 12)) :]))
        texts.append(" ".join(parts))
    texts += [prose("p", 30) + " la di da" * 40, prose("q", 30) + " la di da" * 50, texts[3]]
    own = [words(t) for t in texts]
    shingled = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in own]
    number = {s: i for i, s in enumerate({s for x in shingled for s in x})}

    def windows(x):
        out = np.zeros((max(len(x) - 45, 0), len(number)), np.float32)
        for i in range(len(out)):
            out[i, [number[s] for s in x[i : i + 46]]] = 1
        return out

    sets = [windows(x) for x in shingled]
    wanted = []
    for d in range(len(own)):
        cover = np.zeros(len(own[d]), bool)
        for e in range(d):
            if len(sets[d]) and len(sets[e]):
                both = sets[d] @ sets[e].T
                like = both >= 0.8 * (sets[d].sum(1)[:, None] + sets[e].sum(1)[None, :] - both)
                for i, j in zip(*np.nonzero(like)):  # from the first common shingle to the last one's end
                    common = [t for t in range(i, i + 46) if sets[e][j, number[shingled[d][t]]]]
                    cover[common[0] : common[-1] + 5] = True
        wanted.append(cover)
    got = [np.zeros(len(w), bool) for w in own]
    for p in substring.repeated(plain(spark, texts)).collect():
        got[p["key"]][p["start"] : p["stop"]] = True
        a, b = (set(shingled[k][i : j - 4]) for k, i, j in ((p["key"], p["start"], p["start"] + 50), (p["partner"], p["there"], p["there_stop"])))
        assert p["partner"] < p["key"] and p["similarity"] >= 0.8 and p["stop"] - p["start"] >= 50 and a & b
    hit, all_wanted = sum(int((g & w).sum()) for g, w in zip(got, wanted)), sum(int(w.sum()) for w in wanted)
    extra = sum(int((g & ~w).sum()) for g, w in zip(got, wanted))
    assert all_wanted > 1500 and hit >= 0.97 * all_wanted and extra <= 0.03 * all_wanted, (hit, extra, all_wanted)


def test_substring_finds_one_good_partner_among_many(spark):
    a = prose("many", 80).split()
    texts = [" ".join(w if i % 9 else f"x{d}y{i}" for i, w in enumerate(a, d % 9)) for d in range(90)]  # an edit in nine words: no two are alike
    texts.insert(70, " ".join(a))
    texts.append(" ".join(w if i != 40 else "other" for i, w in enumerate(a)))
    got = [(r["key"], r["partner"], r["start"], r["stop"]) for r in substring.repeated(plain(spark, texts)).collect()]
    assert got == [(91, 70, 0, 80)]


def test_agreement_counts_words_over_one_edit():
    r = np.random.default_rng(2)
    row = r.integers(1, 256, 2 * substring.CONTEXT + substring.K).astype(np.uint8)
    end = len(row) - substring.CONTEXT  # the seed's end
    changed, shorter, far = row.copy(), np.append(np.delete(row, end + 20), 7).astype(np.uint8), np.where(np.arange(len(row)) % 9 == 0, 0, row).astype(np.uint8)
    changed[end + 20] ^= 255
    got = substring.agreement(np.stack([row] * 4), np.stack([row, changed, shorter, far]))
    assert got[0] == len(row) and got[1] == len(row) - 1 and got[2] in (len(row) - 1, len(row) - 2) and got[3] == 0


def test_substring_hands_python_only_the_words_around_a_chain(spark, tmp_path, monkeypatch):
    parts = [prose(f"part{i}", 70, 50_000) for i in range(60)]
    long = " ".join(prose(f"between{i}", 500, 50_000) + " " + p for i, p in enumerate(parts))  # 34,200 words: 137 kB of hashes
    docs = plain(spark, [long if i in (0, 61) else f"{prose(f'before{i}', 40, 50_000)} {parts[i - 1]}" for i in range(62)]).where("doc_id > 0").union(plain(spark, [long]))
    log, plainly = str(tmp_path / "log"), type(docs).mapInArrow

    def logged(self, run, schema, *more):
        def noted(batches):
            def seen():
                for batch in batches:
                    if "anchors" in batch.schema.names:
                        with open(log, "a") as f:
                            f.write(f"{batch.num_rows} {batch.nbytes}\n")
                    yield batch

            yield from run(seen())

        return plainly(self, noted, schema, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", logged)
    got = {(r["key"], r["partner"], r["start"], r["stop"]) for r in substring.repeated(docs).collect()}
    assert got == {(61, 0, 0, 34_200)} | {(i, 0, 40, 110) for i in range(1, 61)}
    rows, size = (sum(x) for x in zip(*(map(int, line.split()) for line in open(log))))
    assert rows >= 61 and size < 1_000_000  # 60 times the long text alone would be 8 MB


def test_substring_odd_rows(spark):
    rows = substring.repeated(odd(spark)).collect()
    assert {(r["key"], r["partner"], r["start"], r["stop"]) for r in rows} == {(8, 7, 0, 80)}
    assert substring.repeated(empty(spark)).count() == 0
    assert substring.removed(empty(spark), substring.repeated(empty(spark))).count() == 0
    assert substring.removed(odd(spark), substring.repeated(odd(spark))).count() == odd(spark).count()


def test_chain_takes_the_best_order():
    at, there = [0, 10, 20, 30, 5], [0, 12, 500, 31, 900]
    assert substring.chain(at, there)[0] == [0, 1, 3]
    assert substring.chain([1], [1]) == []


def leaks(docs, items):
    def weights(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    from collections import Counter

    out = {}
    for d, t in docs:
        w = words(lowered(t))
        for i, x in items:
            y = words(lowered(x))
            if y:
                k = min(5, len(y))
                want, best = Counter(weights(y, k)), 0.0
                for s in range(max(len(w) - len(y) + 1, 1)):
                    have = Counter(weights(w[s : s + len(y)], k))
                    best = max(best, sum((want & have).values()) / sum((want | have).values()))
                if best >= 0.8:
                    out[d, i] = round(best, 9)
    return out


def test_decontamination_is_brute_force(spark):
    items = [(i, prose(f"item{i}", n)) for i, n in enumerate((1, 3, 5, 9, 30, 30, 60, 61))] + [(8, ""), (9, None), (10, "again again again again again again again")]
    docs = []
    for i in range(40):
        r = random.Random(i)
        text = prose(i, 30).split()
        for j in r.sample(range(8), r.randrange(4)):
            piece = items[j][1].split()
            if r.random() < 0.5:
                piece[r.randrange(len(piece))] = "other"
            text += [x.upper() for x in piece] + prose(i + j, 5).split()
        docs.append((i, " ".join(text)))
    docs.append((40, "x again again again again again again again y"))
    table = spark.createDataFrame(items, "item_id long, text string")
    docs += [(41, " ".join(items[6][1].split()[:57])), (42, " ".join(items[6][1].split()[:30])), (43, " ".join(items[4][1].split()[1:]))]  # shorter than the item
    for block in (5000, 3):
        got = decontamination.contaminated(plain(spark, [t for _, t in docs]), table, block_items=block).collect()
        assert {(r["key"], r["item"]): round(r["similarity"], 9) for r in got} == leaks(docs, items)
    assert decontamination.contaminated(odd(spark), table).where("n_words > 3").count() == 0  # a single word may stand anywhere
    assert decontamination.contaminated(empty(spark), table).count() == 0
    assert decontamination.contaminated(odd(spark), table.limit(0)).count() == 0


def test_decontamination_blocks_find_all_within_the_radius_and_leave_most_out():
    items = [(i, prose(f"many{i}", 30)) for i in range(300)]
    (group,) = decontamination.build(items).lengths
    r = np.random.default_rng(4)
    far = r.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << r.choice(64, n, replace=False).astype(np.uint64)) for n in r.integers(0, decontamination.RADIUS + 1, 300)])
    prints = np.concatenate((far, group.prints ^ flips))
    window, item = decontamination.near_items(group, prints)
    got = set(zip(window.tolist(), item.tolist()))
    close = np.bitwise_count(prints[:, None] ^ group.prints[None, :]) <= decontamination.RADIUS
    assert set(zip(*(x.tolist() for x in np.nonzero(close)))) <= got and close.sum() >= 300
    assert len([w for w, _ in got if w < 500]) < 0.2 * 500 * 300


def test_matches_in_order_chain_alike_by_the_short_way_and_by_the_tree():
    rng = random.Random(5)
    for wide in (12, 60, 120):
        for _ in range(200):
            at = list(itertools.accumulate(rng.randint(1, wide) for _ in range(rng.randint(1, 30))))
            there = [x + 1000 + 3 * i for i, x in enumerate(at)]
            apart = substring.chain([*at, at[-1] + 1000], [*there, 1], least=1)  # a match out of order needs the tree, and stands alone
            assert [len(at)] in apart
            assert sorted(c for c in apart if c != [len(at)]) == sorted(substring.chain(at, there, least=1))
