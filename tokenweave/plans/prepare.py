"""The job from a corpus name to training batches, staged where work is shared."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.functions.bpe import BytePairCoder
from tokenweave.operators.order import token_offsets
from tokenweave.operators.pack import SEQUENCE_LENGTH, pack_sequences
from tokenweave.operators.sampling import (
    ACC_STEPS,
    BATCH_SIZE,
    ORDER_SEED,
    batch_assign,
    epoch_order,
    eval_window,
    rank_batch_plan,
    rank_shard,
    resume_from,
    step_schedule,
)
from tokenweave.plans.corpora import ORDER, corpus
from tokenweave.sinks.materialize import materialize_once
from tokenweave.sinks.token_shards import MAX_SHARDS, write_token_shards


def tokenize_corpus(
    spark: SparkSession, name: str, source: str | Sequence[str], out: str, coder: BytePairCoder | None = None, **options
) -> DataFrame:
    """The tokenized corpus at ``out``, encoded first when it is not finished."""
    recipe = corpus(name)
    return materialize_once(spark, out, lambda: recipe(spark, source, coder, **options))


def build_sequences(
    tokens: DataFrame,
    out: str,
    length: int = SEQUENCE_LENGTH,
    order: Sequence[str] = ORDER,
    hashed: bool = False,
) -> DataFrame:
    """The packed sequences at ``out``, cut from a tokenized corpus first when not finished.

    Pass ``**stream_order(name)`` for the order of the corpus.
    """
    spark = tokens.sparkSession
    return materialize_once(spark, out, lambda: pack_sequences(token_offsets(tokens, order, hashed=hashed), length))


def export_shards(
    tokens: DataFrame,
    out: str,
    shards: int = MAX_SHARDS,
    overwrite: bool = False,
    order: Sequence[str] = ORDER,
    hashed: bool = False,
) -> None:
    """Flat token files of a tokenized corpus."""
    write_token_shards(tokens, out, order, shards, overwrite, hashed=hashed)


def training_schedule(
    sequences: DataFrame,
    iterations: int,
    batch_size: int = BATCH_SIZE,
    acc_steps: int = ACC_STEPS,
    world: int = 1,
    seed: int = ORDER_SEED,
    resume_at: int = 0,
) -> DataFrame:
    """Which training sequence each rank reads at each micro-step of a run.

    Only the epochs that are left after ``resume_at`` are permuted.
    """
    rank_batch, rank_acc = rank_batch_plan(batch_size, acc_steps, world)
    train = sequences.where(F.col("split") == "train").select("seq_id")
    count = train.count()
    per_epoch = max(1, math.ceil(math.ceil(count / world) / rank_batch))
    first = resume_at * rank_acc // per_epoch
    epochs = math.ceil(iterations * rank_acc / per_epoch) - first
    order = epoch_order(train, max(1, epochs), seed, first)
    schedule = step_schedule(batch_assign(rank_shard(order, world), rank_batch), iterations, rank_acc)
    return resume_from(schedule, resume_at, rank_acc)


def evaluation_schedule(
    sequences: DataFrame,
    iterations: int,
    batch_size: int = BATCH_SIZE,
    seed: int = ORDER_SEED,
    **options,
) -> DataFrame:
    """Which validation sequence each evaluation of a run reads; never dealt to ranks."""
    val = sequences.where(F.col("split") == "val").select("seq_id")
    return eval_window(batch_assign(rank_shard(epoch_order(val, 1, seed)), batch_size), iterations, **options)
