import bisect
import random

import pytest
from pyspark.sql import functions as F

from tokenweave.operators.order import (
    contiguous_shard,
    cut_point,
    document_index,
    global_rank,
    hash_bucket,
    hash_order,
    ordered_sums,
    prefix_sum,
    range_bounds,
    token_offsets,
    with_range_bucket,
)


def make(spark, rows, partitions):
    return spark.createDataFrame(rows, "split string, doc_key string, n long").repartition(partitions)


def model(rows, key):
    """Starts by a plain loop."""
    out, at = {}, {}
    for split, doc, n in sorted(rows, key=key):
        out[doc] = at.get(split, 0)
        at[split] = out[doc] + n
    return out, at


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    # One split holds most rows, some documents are empty, keys are unevenly spread.
    names = [f"{r.choice(['a', 'zz', 'é'])}/{i}" for i in range(400)]
    return [("train" if r.random() < 0.8 else "val", d, r.choice([0, 1, 5, 100])) for d in names]


@pytest.mark.parametrize("partitions", [1, 3, 17])
@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_natural_offsets(spark, rows, partitions, buckets):
    got = token_offsets(make(spark, rows, partitions), ["doc_key"], buckets=buckets).collect()
    want, totals = model(rows, lambda r: (r[0], r[1]))
    assert {r.doc_key: r.start for r in got} == want
    assert all(r.start_total == totals[r.split] for r in got)
    assert all(r.start_lo <= r.start <= r.start + r.n <= r.start_hi for r in got)


@pytest.mark.parametrize("partitions", [1, 17])
@pytest.mark.parametrize("buckets", [1, 64, 100_000])
def test_hashed_offsets(spark, rows, partitions, buckets):
    df = make(spark, rows, partitions).withColumn("k", hash_order(5, "doc_key"))
    keys = {r.doc_key: r.k for r in df.collect()}
    got = token_offsets(df, ["k", "doc_key"], hashed=True, buckets=buckets).collect()
    want, _ = model(rows, lambda r: (r[0], keys[r[1]], r[1]))
    assert {r.doc_key: r.start for r in got} == want


def test_bucket_table_is_never_broadcast_by_force(spark, rows):
    df = make(spark, rows, 3).withColumn("k", hash_order(5, "doc_key"))
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = ordered_sums(df, {"start": "n"}, order=["k", "doc_key"], groups=("split",), hashed=True, buckets=64)
        plan = placed._jdf.queryExecution().toString()
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
        # The join and the window share one shuffle and one sort of the rows.
        above = plan[plan.index("== Physical Plan ==") :].split("ShuffledHashJoin")[0]
        assert "Exchange" not in above and above.count("Sort ") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


@pytest.mark.parametrize("hashed", [True, False])
def test_null_groups_keep_their_rows(spark, hashed):
    rows = [(None if i % 2 else "" if i % 3 else "a", f"d{i:03d}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "source string, doc_key string, n long").withColumn("k", hash_order(5, "doc_key"))
    order = ["k", "doc_key"] if hashed else ["doc_key"]
    got = token_offsets(df, order, ("source",), hashed=hashed).collect()
    keys = {r.doc_key: r.k for r in df.collect()}
    want, _ = model(rows, lambda r: (str(r[0]), keys[r[1]] if hashed else 0, r[1]))
    assert {r.doc_key: r.start for r in got} == want and len(got) == 100
    assert set(got[0].asDict()) == {*df.columns, "bucket", "start", "start_lo", "start_hi", "start_total"}


def test_no_single_task_window_over_rows(spark, rows):
    plan = token_offsets(make(spark, rows, 3), ["doc_key"], ())._jdf.queryExecution().toString()
    # Only the bucket totals may meet in one task: that exchange sits above an aggregate.
    physical = plan[plan.index("== Physical Plan ==") :].splitlines()
    single = [i for i, line in enumerate(physical) if "SinglePartition" in line]
    assert single and all("HashAggregate" in physical[i + 1] for i in single)


def test_hash_bucket_is_monotone(spark):
    df = spark.range(2000).withColumn("k", hash_order(1, "id")).withColumn("b", hash_bucket("k", 37))
    got = [r.b for r in df.orderBy("k").collect()]
    assert got == sorted(got) and min(got) == 0 and max(got) == 36


def test_range_bucket_is_monotone_and_balanced(spark):
    # A third of the rows have one group value.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), "id"
    )
    got = with_range_bucket(df, ["g", "id"], 32, "b").orderBy("g", "id").collect()
    buckets = [r.b for r in got]
    assert buckets == sorted(buckets)
    sizes = [buckets.count(b) for b in set(buckets)]
    assert len(sizes) == 32 and max(sizes) < 3 * 3000 / 32
    assert len({r.b for r in got if r.g == "hot"}) > 5


@pytest.mark.parametrize("buckets", [1, 2, 16, 17, 300, 5000])
def test_range_bucket_counts_the_bounds_below(spark, buckets):
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    bounds = [b["k"] for b in range_bounds(df, ["k"], buckets).first().bounds]
    assert len(bounds) == buckets - 1 and bounds == sorted(bounds)
    # The bounds follow from the keys, not from where they are.
    assert bounds == [b["k"] for b in range_bounds(df.repartition(7), ["k"], buckets).first().bounds]
    got = with_range_bucket(df, ["k"], buckets).collect()
    assert all(r.bucket == bisect.bisect_left(bounds, r.k) for r in got)


KEYS = {
    "date": "date_add(date'1999-12-31', cast(id * 7 % 900 as int))",
    "timestamp": "timestamp_seconds(id * 7919 % 100000)",
    "decimal(20,3)": "cast(id * 37 % 1000 as decimal(20,3)) / 8",
    "binary": "cast(md5(cast(id as string)) as binary)",
    "boolean": "id % 3 = 0",
    "double": "(id * 7919 % 1000) / 7d",
    "struct<a:int,b:string>": "named_struct('a', cast(id % 5 as int), 'b', md5(cast(id as string)))",
}


@pytest.mark.parametrize("kind", KEYS)
def test_any_key_with_an_order(spark, kind):
    df = spark.range(600).selectExpr("id", f"if(id % 11 = 0, null, {KEYS[kind]}) as k", "id % 4 as n").repartition(5)
    got = {r.id: r.start for r in token_offsets(df, ["k", "id"], (), buckets=37).collect()}
    at = 0
    for r in df.orderBy("k", "id").collect():
        assert got[r.id] == at
        at += r.n


def test_nothing_runs_before_the_plan_does(spark, rows):
    context = spark.sparkContext
    df = make(spark, rows, 3)
    context.setJobGroup("planning", "")
    try:
        placed = token_offsets(df, ["doc_key"], buckets=100_000)
        assert not context.statusTracker().getJobIdsForGroup("planning")
        assert placed.count() == len(rows) and context.statusTracker().getJobIdsForGroup("planning")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_global_rank_and_index(spark, rows):
    df = make(spark, rows, 5)
    ranked = {r.doc_key: r.pos for r in global_rank(df, ["doc_key"]).collect()}
    assert ranked == {d: i for i, d in enumerate(sorted(r[1] for r in rows))}
    indexed = document_index(df, "split", ["doc_key"]).collect()
    for split in ("train", "val"):
        names = sorted(r[1] for r in rows if r[0] == split)
        assert {r.doc_key: r.i for r in indexed if r.split == split} == {d: i for i, d in enumerate(names)}


@pytest.mark.parametrize("n,k", [(10, 3), (3, 8), (1, 1), (16, 4), (1000, 7), (5, 5)])
def test_contiguous_shard(spark, n, k):
    got = [
        r.s
        for r in spark.range(n)
        .select("id", contiguous_shard(F.col("id"), F.lit(n).cast("long"), k).alias("s"))
        .orderBy("id")
        .collect()
    ]
    shards = min(k, n)
    q, r = divmod(n, shards)
    assert got == [s for s in range(shards) for _ in range(q + (s < r))]


@pytest.mark.parametrize("target", [1, 2, 57, 300])
def test_cut_point(spark, target):
    weights = [3, 0, 7, 50, 1, 239]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "id int, w0 long")
    got = cut_point(with_range_bucket(df, ["id"], 3), ["id"], F.col("w0"), F.lit(target)).collect()
    at = 0
    for i, w in enumerate(weights):
        if at < target <= at + w:
            assert [(r.key.id, r.within) for r in got] == [(i, target - at)]
        at += w


def test_empty_input(spark):
    df = spark.createDataFrame([], "split string, doc_key string, n long")
    assert token_offsets(df, ["doc_key"]).collect() == []
    assert prefix_sum(df.withColumn("bucket", F.lit(0)), {"s": "n"}, ["doc_key"], ("split",)).collect() == []
