import collections
import itertools
import math

import pytest
from pyspark.sql import functions as F

from tokenweave.operators.sampling import (
    batch_assign,
    epoch_order,
    eval_window,
    fetch_batches,
    rank_batch_plan,
    rank_shard,
    resume_from,
    sequence_at,
    step_schedule,
)
from tokenweave.plans.prepare import evaluation_schedule, training_schedule


def seqs(spark, n, partitions=3):
    return spark.range(n).withColumnRenamed("id", "seq_id").repartition(partitions)


def permutations(spark, n, epochs):
    rows = epoch_order(seqs(spark, n), epochs).orderBy("epoch", "pos").collect()
    return [[r.seq_id for r in rows if r.epoch == e] for e in range(epochs)]


def permutation(spark, n):
    return permutations(spark, n, 1)[0]


def dealt(order, world):
    """Wrap-around padding and dealing out, with lists."""
    size = math.ceil(len(order) / world) * world
    padded = (order * (size // len(order) + 1))[:size] if order else []
    return [padded[r::world] for r in range(world)]


def test_permutations(spark):
    first, second = permutations(spark, 200, 2)
    assert sorted(first) == sorted(second) == list(range(200))
    assert first != second and first != sorted(first)
    again = epoch_order(seqs(spark, 200, 17), 1).orderBy("pos").collect()
    assert [r.seq_id for r in again] == first
    other = epoch_order(seqs(spark, 200), 1, seed=5).orderBy("pos").collect()
    assert [r.seq_id for r in other] != first


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 99, 4097])
def test_places_and_back(spark, n):
    order = epoch_order(seqs(spark, n), 2, first=5)
    rows = order.collect()
    for epoch in (5, 6):
        assert sorted(r.pos for r in rows if r.epoch == epoch) == list(range(n))
    back = sequence_at(spark.range(n).withColumnRenamed("id", "pos"), n, 2, first=5).collect()
    assert {(r.epoch, r.pos, r.seq_id) for r in back} == {(r.epoch, r.pos, r.seq_id) for r in rows}


def test_places_are_spread(spark):
    """Every tenth of the ids meets every tenth of the places about as often, and neighbours part."""
    n, epochs = 20_000, 3
    rows = epoch_order(seqs(spark, n), epochs).collect()
    cells = collections.Counter((r.epoch, 10 * r.seq_id // n, 10 * r.pos // n) for r in rows)
    square = sum((cells[e, i, j] - n / 100) ** 2 / (n / 100) for e in range(epochs) for i in range(10) for j in range(10))
    assert square < 81 * epochs * 1.6
    place = {(r.epoch, r.seq_id): r.pos for r in rows}
    for e in range(epochs):
        near = sum(abs(place[e, i] - place[e, i + 1]) < n / 100 for i in range(n - 1))
        assert near < 0.03 * n
    alike = sum(place[0, i] == place[1, i] for i in range(n))
    assert alike < 10


def test_permutation_is_arithmetic_alone(spark):
    plan = epoch_order(spark.range(1 << 40).withColumnRenamed("id", "seq_id").where("seq_id < 100"), 2).select("epoch", "pos")
    text = plan._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("Subquery")] if "Subquery" in text else text
    assert "Window" not in text and "Exchange" not in above.split("+- Scan")[0].split("subquery#")[0]
    ids = spark.createDataFrame([(0,), (7,)], "seq_id long")
    with pytest.raises(Exception, match="no place below n"):
        epoch_order(ids).collect()


@pytest.mark.parametrize("n,world", [(10, 4), (12, 4), (3, 8), (1, 3), (1003, 4)])
def test_rank_shard(spark, n, world):
    got = rank_shard(epoch_order(seqs(spark, n)), world).orderBy("rank", "i").collect()
    want = dealt(permutation(spark, n), world)
    assert [[r.seq_id for r in got if r.rank == k] for k in range(world)] == want


@pytest.mark.parametrize("n,world,batch,iterations,acc", [(1003, 4, 8, 150, 1), (50, 1, 7, 30, 4), (9, 2, 3, 5, 2)])
def test_schedule_equals_loop(spark, n, world, batch, iterations, acc):
    epochs = math.ceil(iterations * acc / math.ceil(math.ceil(n / world) / batch))
    schedule = step_schedule(batch_assign(rank_shard(epoch_order(seqs(spark, n), epochs), world), batch), iterations, acc)
    got = {}
    for r in schedule.orderBy("slot").collect():
        got.setdefault((r.rank, r.itr, r.micro), []).append(r.seq_id)
    want, orders = {}, [dealt(p, world) for p in permutations(spark, n, epochs)]
    for rank in range(world):
        endless = (order[rank][a : a + batch] for order in orders for a in range(0, len(order[rank]), batch))
        for itr, micro in itertools.product(range(iterations), range(acc)):
            want[rank, itr, micro] = next(endless)
    assert got == want
    resumed = resume_from(schedule, iterations // 2, acc).collect()
    assert {(r.rank, r.itr, r.micro) for r in resumed} == {k for k in want if k[1] >= iterations // 2}


def test_each_sequence_once_per_epoch(spark):
    rows = batch_assign(rank_shard(epoch_order(seqs(spark, 64), 3), 4), 4).groupBy("epoch", "seq_id").count().collect()
    assert len(rows) == 3 * 64 and {r["count"] for r in rows} == {1}


@pytest.mark.parametrize("n,batch,iterations,freq,budget", [(50, 8, 450, 100, 5), (50, 8, 400, 100, 24), (5, 8, 10, 200, 24)])
def test_eval_window_equals_cycle(spark, n, batch, iterations, freq, budget):
    val = batch_assign(rank_shard(epoch_order(seqs(spark, n))), batch)
    got = {}
    for r in eval_window(val, iterations, freq, budget).orderBy("slot").collect():
        got.setdefault((r.eval_id, r.eval_itr, r.t), []).append(r.seq_id)
    order = permutation(spark, n)
    batches = [order[a : a + batch] for a in range(0, n, batch)]
    endless, want, j = itertools.cycle(batches), {}, 0
    for itr in range(1, iterations + 1):
        if itr % freq == 0 or itr == iterations:
            for t in range(budget if itr < iterations else len(batches)):
                want[j, itr, t] = next(endless)
            j += 1
    assert got == want


def test_eval_after_resume(spark):
    val = batch_assign(rank_shard(epoch_order(seqs(spark, 20))), 2)
    got = {(r.eval_id, r.eval_itr) for r in eval_window(val, 1000, 200, 3, resumed_at=500).collect()}
    assert got == {(0, 600), (1, 800), (2, 1000)}
    first = eval_window(val, 1000, 200, 3, resumed_at=500).where("eval_id = 0").select("batch_id").distinct().collect()
    assert {r[0] for r in first} == {0, 1, 2}
    assert eval_window(val, 1000, 200, 3, resumed_at=1000).count() == 0


def test_rank_batch_plan():
    assert rank_batch_plan(32, 4, 4) == (32, 1)
    assert rank_batch_plan(32, 8, 2) == (32, 4)
    assert rank_batch_plan(32, 4, 1) == (32, 4)
    for bad in [(32, 4, 3), (32, 2, 4), (0, 4, 4), (32, 4, 0)]:
        with pytest.raises(ValueError):
            rank_batch_plan(*bad)


def test_fetch_batches(spark):
    sequences = spark.range(20).select(F.col("id").alias("seq_id"), F.array("id").alias("x"), F.array(F.col("id") + 1).alias("y"))
    schedule = step_schedule(batch_assign(rank_shard(epoch_order(sequences, 2)), 3), 8, 1)
    rows = fetch_batches(schedule, sequences).collect()
    assert len(rows) == schedule.count() and all(r.x == [r.seq_id] for r in rows)


def test_training_schedule_resumes_as_a_suffix(spark):
    # As packing numbers them: from zero in each split.
    split = F.when(F.col("id") < 90, "train").otherwise("val")
    sequences = spark.range(100).select((F.col("id") % 90).alias("seq_id"), split.alias("split"))
    columns = ["itr", "micro", "rank", "slot", "epoch", "seq_id"]

    def rows(**kw):
        got = training_schedule(sequences, 40, batch_size=4, acc_steps=4, world=2, **kw).select(*columns).collect()
        return {tuple(r) for r in got}

    whole = rows()
    assert {r[0] for r in whole} == set(range(40)) and len(whole) > 90
    assert rows(resume_at=25) == {r for r in whole if r[0] >= 25}
    evals = evaluation_schedule(sequences, 40, batch_size=4, eval_freq=10, eval_batches=2)
    assert {r.eval_itr for r in evals.collect()} == {10, 20, 30, 40}
