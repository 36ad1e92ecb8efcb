import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenweave.operators.splits import file_split, modulo_split, offset_split, random_split


@pytest.mark.parametrize("n,fraction", [(1, 0.0005), (100, 0.05), (101, 0.05), (1000, 0.0005), (7, 0.5)])
def test_random_split_size(spark, n, fraction):
    docs = spark.range(n).withColumnRenamed("id", "doc_key")
    got = Counter(r.split for r in random_split(docs, fraction=fraction).collect())
    assert got["val"] == math.ceil(fraction * n) and got["val"] + got["train"] == n


@pytest.mark.parametrize("make", ["range", "rows", "shuffled"])
def test_random_split_size_with_repeated_keys(spark, make):
    docs = spark.range(1000).selectExpr("id % 10 as doc_key", "cast(id as string) as text")
    if make == "rows":
        docs = spark.createDataFrame([(i % 10,) for i in range(1000)], "doc_key long")
    if make == "shuffled":
        docs = docs.repartition(7)
    got = random_split(docs, fraction=0.05)
    assert Counter(r.split for r in got.collect()) == {"val": 50, "train": 950}
    assert set(got.columns) == {*docs.columns, "order_key", "split"}


def test_random_split_ignores_partitioning_and_order(spark):
    docs = spark.range(500).withColumnRenamed("id", "doc_key")
    sets = [
        frozenset(r.doc_key for r in random_split(df, fraction=0.1, buckets=b).where("split = 'val'").collect())
        for df, b in [(docs.coalesce(1), 1), (docs.repartition(3), 8), (docs.orderBy(F.desc("doc_key")), 4000)]
    ]
    assert len(set(sets)) == 1 and len(sets[0]) == 50
    other = random_split(docs, fraction=0.1, seed=1).where("split = 'val'").collect()
    assert {r.doc_key for r in other} != sets[0]


def test_modulo_split(spark):
    # One year holds most documents.
    rows = [(1999, f"p{i:04d}", "t") for i in range(100)] + [(2000, f"q{i:04d}", "t") for i in range(23)]
    df = spark.createDataFrame(rows, "year int, doc_key string, text string").repartition(7)
    got = {r.doc_key: (r.i, r.split) for r in modulo_split(df).collect()}
    for year in (1999, 2000):
        for i, (_, key, _) in enumerate(sorted(r for r in rows if r[0] == year)):
            want = "train" if i % 10 < 7 else "val" if i % 10 < 9 else "test"
            assert got[key] == (i, want)


@pytest.mark.parametrize(
    "texts", [["abc", "", "defgé😀", "hi", "j"], ["a"], [""], ["ab", "cd"], ["x" * 1000, "y"], ["0123456789"]]
)
def test_offset_split(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = offset_split(df, ["id"]).orderBy("id", "split").collect()
    whole = "".join(texts)
    cut = int(0.8 * len(whole))
    assert "".join(r.text for r in got if r.split == "train") == whole[:cut]
    assert "".join(r.text for r in got if r.split == "val") == whole[cut:]


def test_file_split(spark):
    df = spark.createDataFrame([("d/wiki.train.raw",), ("d/wiki.valid.raw",), ("d/notes",)], "file string")
    got = file_split(df, F.col("file"), {"wiki.train.raw": "train", "wiki.valid.raw": "val"}).collect()
    assert {(r.file, r.split) for r in got} == {("d/wiki.train.raw", "train"), ("d/wiki.valid.raw", "val")}
