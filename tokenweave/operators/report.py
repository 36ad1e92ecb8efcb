"""Counts over tokenized corpora: one partial aggregate and a small final one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.functions.ids import MODEL_VOCAB_SIZE, ids_in_range
from tokenweave.functions.numbers import ceil_div
from tokenweave.operators.pack import sequence_count


def stream_length(df: DataFrame, groups: Sequence[str] = ("split",)) -> DataFrame:
    """Ids per split: the size of the stream."""
    return df.groupBy(*groups).agg(F.sum("n").cast("long").alias("tokens"))


def corpus_report(df: DataFrame, groups: Sequence[str] = ("source", "split")) -> DataFrame:
    """Documents, ids, longest and mean document per group."""
    return df.groupBy(*groups).agg(
        F.count("*").alias("docs"),
        F.sum("n").cast("long").alias("tokens"),
        F.max("n").alias("longest"),
        F.avg("n").alias("mean_len"),
    )


def sequence_counts(df: DataFrame, length: int, groups: Sequence[str] = ("split",)) -> DataFrame:
    """Ids and sequences per split."""
    return stream_length(df, groups).withColumn("sequences", sequence_count(F.col("tokens"), length))


def batches_per_epoch(samples: Column, batch_size: int) -> Column:
    """Batches of one pass; a last partial batch counts."""
    return ceil_div(samples, batch_size)


def id_range_violations(df: DataFrame, vocab_size: int = MODEL_VOCAB_SIZE, groups: Sequence[str] = ("split",)) -> DataFrame:
    """Documents per split, and how many hold an id outside the vocabulary."""
    bad = (~ids_in_range("ids", vocab_size)).cast("long")
    return df.groupBy(*groups).agg(F.count("*").alias("docs"), F.sum(bad).alias("bad_docs"))
