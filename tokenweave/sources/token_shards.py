"""Token files as DataFrames: chunks of the stream, or its sequences."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import astuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from tokenweave.operators.pack import SEQUENCE_LENGTH, shift_targets
from tokenweave.sinks.token_shards import TokenShards
from tokenweave.sources.token_files import WORD, plain_files, read_span, shard_files

#: Ids between two wanted sequences that are read along, and ids that are read at once.
NEAR = 1 << 14
AT_ONCE = 1 << 22
#: Sequences of a batch of results.
ROWS = 2048

#: A folder of shards, or the plain files of each split in order.
Tokens = str | Mapping[str, Sequence[str]]


def _reader(spark: SparkSession, tokens: Tokens, partition_tokens: int) -> DataFrameReader:
    spark.dataSource.register(TokenShards)
    reader = spark.read.format("token_shards").option("partition_tokens", partition_tokens)
    if isinstance(tokens, str):
        return reader.option("path", tokens)
    return reader.option("files", json.dumps([astuple(f) for f in plain_files(tokens)]))


def read_token_shards(
    spark: SparkSession, tokens: Tokens, chunk: int = 1 << 16, partition_tokens: int = 1 << 24
) -> DataFrame:
    """Rows ``(split, start, ids)``: the stream of each split in chunks, read in parallel."""
    return _reader(spark, tokens, partition_tokens).option("chunk", chunk).load()


def read_sequences(
    spark: SparkSession, tokens: Tokens, length: int = SEQUENCE_LENGTH, partition_tokens: int = 1 << 24
) -> DataFrame:
    """Rows ``(split, seq_id, x, y)`` straight from token files.

    A sequence is a range of bytes, so nothing is shuffled: the same rows as
    ``pack_sequences`` gives for the documents the files were written from.
    """
    return shift_targets(_reader(spark, tokens, partition_tokens).option("sequence_length", length).load(), length)


def fetch_sequences(schedule: DataFrame, tokens: Tokens, split: str, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """``schedule`` with the sequences ``x``, ``y`` of its ``seq_id``, read by position from the files of one split.

    A sequence is a range of bytes of a known file, so a task opens what its own rows ask for: neither the sequences
    nor the schedule are shuffled, and what is not scheduled is not read.  Wanted sequences of a batch are read in the
    order of the files, near ones together.  An id outside the stream is an error.
    """
    found = shard_files(tokens) if isinstance(tokens, str) else plain_files(tokens)
    files = [f for f in found if f.split == split]
    starts = [f.start for f in files]
    sequences = max(0, sum(f.n_tokens for f in files) - 1) // length
    at = schedule.columns.index("seq_id")

    def windows(wanted: np.ndarray) -> np.ndarray:
        """Rows of ``length + 1`` ids, one for each of the sorted ids."""
        out = np.empty((len(wanted), length + 1), WORD)
        far = np.flatnonzero((np.diff(wanted) - 1) * length > NEAR) + 1
        borders = [0, *far.tolist(), len(wanted)]
        for a, b in zip(borders, borders[1:]):
            while a < b:
                first = int(wanted[a])
                to = a + int(np.searchsorted(wanted[a:b], first + max(1, AT_ONCE // length)))
                last = int(wanted[to - 1])
                held = files[max(0, bisect_right(starts, first * length) - 1) :]
                words = read_span([f for f in held if f.start <= (last + 1) * length], first * length, (last + 1) * length + 1)
                out[a:to] = words[((wanted[a:to] - first) * length)[:, None] + np.arange(length + 1)]
                a = to
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                ids = batch.column(at).to_numpy(zero_copy_only=False)
                if not ((0 <= ids) & (ids < sequences)).all():
                    raise ValueError(f"{split} holds sequences 0 to {sequences - 1} of {length} ids")
                wanted, place = np.unique(ids.astype(np.int64), return_inverse=True)
                t = windows(wanted)[place].astype(np.int32)
                ends = pa.array(np.arange(0, len(t) * length + 1, length, dtype=np.int32))
                x, y = (pa.ListArray.from_arrays(ends, pa.array(part.ravel())) for part in (t[:, :-1], t[:, 1:]))
                yield pa.RecordBatch.from_arrays([*batch.columns, x, y], names=[*batch.schema.names, "x", "y"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schedule.schema)
    return schedule.mapInArrow(run, f"{kinds}, x array<int>, y array<int>")
