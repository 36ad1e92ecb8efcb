"""Epoch permutations, rank shards, batches and the step schedule.

Everything is a function of ``(seed, epoch, seq_id)``, so a run can be resumed by
a filter and nothing is shuffled; the sequences join last, or are read by their place in token files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.functions.numbers import ceil_div, div
from tokenweave.operators.permute import permuted, round_keys
from tokenweave.operators.report import batches_per_epoch

# The defaults of a training run.
ORDER_SEED = 1337
BATCH_SIZE = 32
ACC_STEPS = 4
EVAL_FREQ = 200
EVAL_BATCHES = 24


def _epochs(first: int, epochs: int, seed: int) -> Column:
    """The epochs with the keys of their permutations, as an array to explode."""
    return F.array(*[F.struct(F.lit(e).cast("long").alias("epoch"), F.lit(round_keys(seed, e)).cast("array<array<bigint>>").alias("keys")) for e in range(first, first + epochs)])


def epoch_order(sequences: DataFrame, epochs: int = 1, seed: int = ORDER_SEED, first: int = 0) -> DataFrame:
    """A permutation of ``seq_id`` without replacement, a new one every epoch.

    Rows ``(epoch, seq_id, pos, n)`` with ``n`` the number of sequences, whose ids are 0 to ``n - 1``.  A place
    follows from the id by arithmetic, so nothing is ranked or shuffled.
    """
    n = sequences.agg(F.count("*")).scalar()
    runs = sequences.select("seq_id", n.alias("n"), F.explode(_epochs(first, epochs, seed)).alias("run"))
    return runs.select("run.epoch", "seq_id", permuted(F.col("seq_id"), F.col("n"), F.col("run.keys")).alias("pos"), "n")


def sequence_at(places: DataFrame, n: int, epochs: int = 1, seed: int = ORDER_SEED, first: int = 0) -> DataFrame:
    """The inverse of :func:`epoch_order`: rows ``(epoch, pos, seq_id, n)`` for places ``pos`` of an epoch of ``n`` sequences."""
    runs = places.select("pos", F.lit(n).cast("long").alias("n"), F.explode(_epochs(first, epochs, seed)).alias("run"))
    return runs.select(
        "run.epoch", "pos", permuted(F.col("pos"), F.col("n"), F.col("run.keys"), back=True).alias("seq_id"), "n"
    )


def rank_shard(order: DataFrame, world: int = 1) -> DataFrame:
    """Deal a permutation out to ``world`` ranks; adds ``rank``, ``i`` and ``per_rank``.

    The permutation is repeated from its start until its length is a multiple of
    ``world``, so some samples are there twice; rank r gets slots r, r + world, ...
    """
    padded = order.withColumn("per_rank", ceil_div(F.col("n"), world))
    slots = F.sequence(F.col("pos"), F.col("per_rank") * world - 1, F.col("n"))
    return (
        padded.select("*", F.explode(slots).alias("at"))
        .withColumn("rank", (F.col("at") % world).cast("int"))
        .withColumn("i", div(F.col("at"), world))
        .drop("at")
    )


def batch_assign(samples: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Group the samples of a rank into batches; adds ``batch_id``, ``slot``, ``batches``."""
    return samples.withColumns(
        {
            "batch_id": div(F.col("i"), batch_size),
            "slot": (F.col("i") % batch_size).cast("int"),
            "batches": batches_per_epoch(F.col("per_rank"), batch_size),
        }
    )


def rank_batch_plan(batch_size: int, acc_steps: int, world: int) -> tuple[int, int]:
    """Batch size and accumulation steps of one rank, for the same batch over all ranks."""
    if world < 1 or acc_steps < 1 or batch_size < 1:
        raise ValueError("batch size, accumulation steps and world size must be positive")
    if acc_steps % world:
        raise ValueError(f"{acc_steps} accumulation steps are not divisible by the world size {world}")
    common = math.gcd(acc_steps, world)
    return batch_size // (world // common), acc_steps // common


def step_schedule(batched: DataFrame, iterations: int, acc_steps: int = ACC_STEPS) -> DataFrame:
    """When each sample of :func:`batch_assign` is consumed in a run.

    Adds ``substep`` (batches consumed before), ``itr`` and ``micro``; samples
    beyond the last iteration are left out.  The position follows from the
    sample's own keys, so no schedule table has to be joined.
    """
    substep = F.col("epoch") * F.col("batches") + F.col("batch_id")
    return (
        batched.withColumn("substep", substep)
        .where(F.col("substep") < iterations * acc_steps)
        .withColumn("itr", div(F.col("substep"), acc_steps))
        .withColumn("micro", (F.col("substep") % acc_steps).cast("int"))
    )


def resume_from(schedule: DataFrame, itr: int, acc_steps: int = ACC_STEPS) -> DataFrame:
    """The part of a schedule that is left after ``itr`` iterations."""
    return schedule.where(F.col("substep") >= itr * acc_steps)


def eval_window(
    batched: DataFrame,
    iterations: int,
    eval_freq: int = EVAL_FREQ,
    eval_batches: int = EVAL_BATCHES,
    resumed_at: int = 0,
) -> DataFrame:
    """Which evaluation reads each validation sample.

    Every ``eval_freq`` iterations an evaluation reads the next ``eval_batches``
    batches, the one after the last iteration a full pass.  The order is shuffled
    once and cycled, so batch b is read at positions b, b + batches, ... of one
    endless sequence.  Adds ``eval_id``, ``eval_itr`` and ``t``, the batch's place
    in its evaluation.  ``batched`` is one epoch of one rank.  After a resume the
    cycle starts anew, so ``eval_id`` counts evaluations since ``resumed_at``.
    """
    done = resumed_at // eval_freq
    evals = math.ceil(iterations / eval_freq) - done if resumed_at < iterations else 0
    if evals < 1:
        nothing = batched.where(F.lit(False))
        return nothing.select("*", *[F.lit(0).cast("long").alias(c) for c in ("eval_id", "t", "eval_itr")])
    before_last = F.lit(eval_batches * (evals - 1)).cast("long")
    last = before_last + F.col("batches") - 1
    reads = F.when(F.col("batch_id") <= last, F.sequence(F.col("batch_id"), last, F.col("batches")))
    return (
        batched.select("*", F.explode(reads).alias("read"))
        .withColumn("eval_id", F.least(div(F.col("read"), eval_batches), F.lit(evals - 1).cast("long")))
        .withColumn("t", F.col("read") - F.col("eval_id") * eval_batches)
        .withColumn("eval_itr", F.least((F.col("eval_id") + done + 1) * eval_freq, F.lit(iterations).cast("long")))
        .drop("read")
    )


def fetch_batches(schedule: DataFrame, sequences: DataFrame, on: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """The sequences for each scheduled sample; Spark broadcasts a small schedule.

    ``sequences`` may have the windows of ``pack_windows``, to be shifted behind the join, which then moves half as much.
    """
    return schedule.join(sequences, list(on))
