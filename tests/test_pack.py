import random

import pytest
from pyspark.sql import functions as F

from tokenweave.operators.order import token_offsets
from tokenweave.operators.pack import pack_sequences
from tokenweave.session import stage


def run(spark, docs, length, partitions=3, buckets=None, ids="ids"):
    rows = [(s, i, ids_) for i, (s, ids_) in enumerate(docs)]
    df = spark.createDataFrame(rows, "split string, doc int, ids array<int>").withColumn(
        "n", F.size("ids").cast("long")
    )
    out = pack_sequences(token_offsets(df.repartition(partitions), ["doc"], buckets=buckets), length, ids=ids)
    return {(r.split, r.seq_id): (list(r.x), list(r.y)) for r in out.collect()}, out.count()


def model(docs, length):
    out = {}
    for split in {s for s, _ in docs}:
        stream = [i for s, ids in docs if s == split for i in ids]
        for c in range(max(0, (len(stream) - 1) // length)):
            a = c * length
            out[split, c] = (stream[a : a + length], stream[a + 1 : a + 1 + length])
    return out


CASES = {
    "short documents": ([("train", [i] * (i % 4)) for i in range(60)], 5),
    "shorter than a sequence": ([("train", [1, 2]), ("val", [3])], 5),
    "exactly k*L": ([("train", list(range(20)))], 5),
    "exactly k*L+1": ([("train", list(range(21)))], 5),
    "one long document": ([("train", list(range(10_000)))], 16),
    "long among short": ([("train", [1]), ("train", list(range(500))), ("train", [2] * 7)], 8),
    "empty documents": ([("train", []), ("train", list(range(9))), ("train", []), ("val", [])], 4),
    "length one": ([("train", [1, 2, 3]), ("train", [4, 5])], 1),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("buckets", [1, 4, 1000])
def test_pack_equals_slicing(spark, case, buckets):
    docs, length = CASES[case]
    got, rows = run(spark, docs, length, buckets=buckets)
    assert got == model(docs, length) and rows == len(got)


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_random_documents(spark, partitions):
    r = random.Random(1)
    docs = [
        (r.choice(["train", "train", "val"]), [r.randrange(100) for _ in range(r.choice([0, 1, 3, 40, 200]))])
        for _ in range(300)
    ]
    got, rows = run(spark, docs, 16, partitions)
    assert got == model(docs, 16) and rows == len(got)


@pytest.mark.parametrize("staged", [False, True])
def test_whole_sequences_are_not_shuffled_again(spark, staged):
    df = spark.createDataFrame([("train", i, [1] * 50) for i in range(100)], "split string, doc int, ids array<int>")
    df = df.withColumn("n", F.lit(50).cast("long"))
    df = stage(df, "nullable-split") if staged else df
    offsets = token_offsets(df, ["doc"], buckets=2)
    plan = pack_sequences(offsets, 8)._jdf.queryExecution().executedPlan().toString()
    # The first branch of the union aggregates on the offsets' own partitioning.
    inner = plan[plan.index("Union") :].split("ObjectHashAggregate")
    assert "Exchange" not in inner[1] and "Exchange" not in inner[2].split("Window")[0]


def test_null_splits_are_packed(spark):
    docs = [(None if i % 3 else "train", [i] * (i % 9)) for i in range(90)]
    got, rows = run(spark, docs, 7, buckets=6)
    assert got == model(docs, 7) and rows == len(got)
