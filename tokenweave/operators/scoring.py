"""Next-token counts, cross-entropy of a count model, and batch-averaged metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenweave.functions.ids import WORD_LIMIT

# The target that carries no loss, and the base of perplexity.
IGNORED_TARGET = -1
PERPLEXITY_BASE = 2.71828


def token_pairs(sequences: DataFrame, *keep: str) -> DataFrame:
    """One row per (input, target) position, with the columns ``keep``."""
    return sequences.select(*keep, F.inline(F.arrays_zip("x", "y")))


def bigram_counts(pairs: DataFrame) -> DataFrame:
    """How often target ``y`` follows input ``x``; counted before the shuffle."""
    return pairs.groupBy("x", "y").agg(F.count("*").alias("c"))


def batch_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of each batch with their multiplicity ``m``, so that joins move distinct pairs."""
    return pairs.groupBy("batch_id", F.col("x"), F.col("y").alias("target")).agg(F.count("*").alias("m"))


def score_pairs(pairs: DataFrame, counts: DataFrame, vocab_size: int) -> DataFrame:
    """Loss and prediction of each pair ``(batch_id, x, target, m)`` under add-one counts.

    ``nll = -ln((c + 1) / (c_x + vocab_size))``; the prediction is the most
    frequent successor, the smallest id among equals.  Rows are
    ``(batch_id, target, pred, nll, m)``.
    """
    best = F.min(F.struct((-F.col("c")).alias("c"), "y"))["y"]
    by_input = counts.groupBy("x").agg(F.sum("c").alias("c_x"), best.alias("pred"))
    if vocab_size <= WORD_LIMIT:
        by_input = F.broadcast(by_input)  # a row per vocabulary id at most
    seen = counts.withColumnRenamed("y", "target")
    total = F.coalesce(F.col("c_x"), F.lit(0)) + vocab_size
    return (
        pairs.join(seen, ["x", "target"], "left")
        .join(by_input, "x", "left")
        .select(
            "batch_id",
            "target",
            # With no count for an input all scores are equal: the smallest id wins.
            F.coalesce("pred", F.lit(0)).alias("pred"),
            (-F.ln((F.coalesce("c", F.lit(0)) + 1) / total)).alias("nll"),
            "m",
        )
    )


def match_targets(predictions: DataFrame) -> DataFrame:
    """Adds ``hit``: whether prediction and target agree."""
    return predictions.withColumn("hit", (F.col("pred") == F.col("target")).cast("double"))


def batch_metrics(predictions: DataFrame) -> DataFrame:
    """Mean loss and accuracy of each batch of ``(batch_id, target, pred, nll[, m])``.

    An ignored target has no part in the loss but counts as a miss in the accuracy.
    """
    weight = F.col("m") if "m" in predictions.columns else F.lit(1)
    counted = F.when(F.col("target") != IGNORED_TARGET, weight)
    return (
        match_targets(predictions)
        .groupBy("batch_id")
        .agg(
            (F.sum(counted * F.col("nll")) / F.sum(counted)).alias("loss"),
            (F.sum(F.col("hit") * weight) / F.sum(weight)).alias("acc"),
        )
    )


def eval_metrics(predictions: DataFrame) -> DataFrame:
    """One row: unweighted means over batches, and perplexity."""
    return (
        batch_metrics(predictions)
        .agg(F.count("*").alias("n_batches"), F.avg("loss").alias("loss"), F.avg("acc").alias("acc"))
        .withColumn("perplexity", F.pow(F.lit(PERPLEXITY_BASE), F.col("loss")))
    )


def next_token_candidates(counts: DataFrame, temperature: float = 1.0, top_k: int | None = None) -> DataFrame:
    """Successors of each input with their sampling probability.

    Log counts are divided by ``temperature``; with ``top_k`` only scores not
    below the k-th largest stay, ties included; the rest is a softmax.  A group
    holds at most one row per vocabulary id.
    """
    by_input = Window.partitionBy("x")
    scored = counts.withColumn("score", F.ln("c") / F.lit(float(temperature)))
    if top_k is not None:
        scored = scored.withColumn("place", F.rank().over(by_input.orderBy(F.desc("score"))))
        scored = scored.where(F.col("place") <= top_k).drop("place")
    weight = F.exp(F.col("score") - F.max("score").over(by_input))
    return (
        scored.withColumn("w", weight)
        .withColumn("prob", F.col("w") / F.sum("w").over(by_input))
        .drop("w")
    )
