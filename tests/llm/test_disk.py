"""What the operators leave and move on disk."""

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from pantry.llm import bitmap, ngram_join, shared, substring
from pantry.llm.shared import gone, kept
from tests.llm.cases import plain, prose
from tests.llm.test_joins import near_copies


def test_filter_grows_with_its_keys(spark):
    sent = bitmap.of(spark.range(4_000_000).select(F.col("id").alias("key")))
    own, other = (np.array([r[0] for r in spark.range(a, a + 20_000).select(bitmap.place("id")).collect()]) for a in (0, 5_000_000))
    assert bitmap.has(sent, own).all() and bitmap.has(sent, other).mean() < 0.03  # 2 ** 24 bits and one a key let 21 % pass


def shuffled(spark):
    """Bytes of shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_kept_leaves_no_shuffle_files_and_gone_takes_the_table(spark):
    before = shuffled(spark)
    rows = kept(spark.range(500_000).select(F.xxhash64("id").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")), "rows")
    assert shuffled(spark) < before + 1_000_000 and rows.count() == 500_000
    folder = vars(rows)["_kept"].rpartition("/")[0].removeprefix("file:")
    gone(rows, spark.range(1))
    assert not os.path.exists(folder)


def test_joins_leave_only_tables_that_their_rows_are_read_from(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: str(tmp_path / uuid.uuid4().hex))
    texts = near_copies() + [prose(f"a{i}", 60) + " " + prose("passage", 70) + " " + prose(f"b{i}", 60) for i in range(9)]
    docs = plain(spark, texts)
    found = ngram_join.linked(docs)
    assert sorted(x for d in os.listdir(tmp_path) for x in os.listdir(tmp_path / d)) == ["components", "texts"] and found.count() == len(texts)
    one = set(os.listdir(tmp_path))
    passages = substring.repeated(docs.unionByName(plain(spark, texts[:2])))
    assert {x for d in set(os.listdir(tmp_path)) - one for x in os.listdir(tmp_path / d)} == {"passages"} and passages.count() >= 8


def test_heads_move_only_for_pairs_whose_cells_fit(spark, tmp_path, monkeypatch):
    texts = [prose(f"own{i}", 200, 50_000) + " " + prose(f"common{i // 7}", 30) for i in range(50)]  # in so few texts a passage counts as no frequent one
    near = texts[7].split()
    near[100] = "changed"
    docs, log = plain(spark, [*texts, " ".join(near)]), str(tmp_path / "log")
    plainly = type(docs).mapInArrow

    def logged(self, run, schema, *more):
        pair = {"a", "b"} <= set(self.columns)
        kind = "heads" if pair and any(c.startswith("h") for c in self.columns) else "cells" if pair and any(c.startswith("c") for c in self.columns) else None

        def noted(batches):
            def seen():
                for batch in batches:
                    if kind:
                        with open(log, "a") as f:
                            f.write(f"{kind} {batch.num_rows}\n")
                    yield batch

            yield from run(seen())

        return plainly(self, noted, schema, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", logged)
    got = {r["key"]: r["component"] for r in ngram_join.linked(docs).collect()}
    assert got == {i: 7 if i == 50 else i for i in range(51)}
    rows = {k: sum(int(line.split()[1]) for line in open(log) if line.startswith(k)) for k in ("cells", "heads")}
    assert rows["cells"] > 20 * rows["heads"] > 0, rows
