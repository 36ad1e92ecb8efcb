"""Flat two-byte token files as a Spark data source.

A folder holds ``<split>/shard-NNNNN.bin`` with little-endian ``uint16`` words and
a manifest ``(split, shard, start, n_tokens)``.  The shards of a split, one after
the other, are its token stream.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tokenweave.functions.ids import WORD_LIMIT
from tokenweave.operators.order import contiguous_shard, ordered_sums
from tokenweave.sources.files import filesystem
from tokenweave.sources.token_files import (
    CHUNKS,
    MANIFEST,
    WINDOWS,
    WORD,
    StreamReader,
    TokenFile,
    read_manifest,
    shard_files,
)

# Fixed value: the most shards of a split.
MAX_SHARDS = 1024

#: Words that are written at a time.
WORDS = 1 << 18

SPLITS = ("train", "val", "test")


@dataclass
class WrittenShards(WriterCommitMessage):
    """What one task wrote: ``(split, shard, start, tokens, temporary file)``."""

    shards: list[tuple[str, int, int, int, str]]


class ShardWriter(DataSourceArrowWriter):
    """Each task appends to its own temporary files; the commit renames them."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path
        self.overwrite = overwrite
        self.attempt = f"_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenShards:
        files, root = filesystem(self.path)
        folder = f"{root}/{self.attempt}"
        files.create_dir(folder, recursive=True)
        done: list[tuple[str, int, int, int, str]] = []
        out, current, begin, place, target = None, None, 0, 0, ""
        try:
            for batch in iterator:
                owners = list(zip(batch.column("split").to_pylist(), batch.column("shard").to_pylist()))
                starts, ids = batch.column("start").to_numpy(), batch.column("ids")
                borders = [i for i in range(len(owners)) if i == 0 or owners[i] != owners[i - 1]] + [len(owners)]
                for a, b in zip(borders, borders[1:]):
                    if owners[a] != current:
                        if out is not None:
                            out.close()
                            done.append((*current, begin, place - begin, target))
                        current, begin, place = owners[a], int(starts[a]), int(starts[a])
                        target = f"{folder}/{uuid.uuid4().hex}.bin"
                        out = files.open_output_stream(target, compression=None)
                    run = ids.slice(a, b - a)
                    ends = place + np.cumsum(run.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                    if not np.array_equal(starts[a:b], np.append(place, ends[:-1])):
                        raise ValueError(f"shard {current} is not contiguous after {place}")
                    words = run.flatten().to_numpy(zero_copy_only=False)
                    for low in range(0, len(words), WORDS):
                        some = words[low : low + WORDS]
                        if not 0 <= int(some.min()) <= int(some.max()) < WORD_LIMIT:
                            raise ValueError(f"an id of shard {current} does not fit two bytes")
                        out.write(some.astype(WORD).data)
                    place = int(ends[-1])
        finally:
            if out is not None:
                out.close()
        if current is not None:
            done.append((*current, begin, place - begin, target))
        return WrittenShards(done)

    def commit(self, messages: list[WrittenShards | None]) -> None:
        files, root = filesystem(self.path)
        old = read_manifest(self.path)
        if old and not self.overwrite:
            raise ValueError(f"{self.path} already holds token shards")
        new = [s for m in messages if m is not None for s in m.shards]
        names = {(split, shard) for split, shard, *_ in new}
        if len(names) != len(new):
            raise ValueError("a shard was written by two tasks")
        if old:
            files.delete_file(f"{root}/{MANIFEST}")
        for split in sorted({split for split, _ in names}):
            files.create_dir(f"{root}/{split}", recursive=True)
        for split, shard, _, _, temporary in new:
            files.move(temporary, f"{root}/{split}/shard-{shard:05d}.bin")
        for s in old:
            if (s["split"], s["shard"]) not in names:
                files.delete_file(f"{root}/{s['split']}/shard-{s['shard']:05d}.bin")
        rows = [
            {"split": split, "shard": shard, "start": start, "n_tokens": tokens}
            for split, shard, start, tokens, _ in sorted(new)
        ]
        # The manifest comes last: a folder without one holds nothing.
        with files.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(rows).encode())
        self._drop_attempt()

    def abort(self, messages: list[WrittenShards | None]) -> None:
        self._drop_attempt()

    def _drop_attempt(self) -> None:
        from pyarrow import fs

        files, root = filesystem(self.path)
        if files.get_file_info(f"{root}/{self.attempt}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.attempt}")


class TokenShards(DataSource):
    """``format("token_shards")`` over a folder ``path``, or over plain ``files``.

    Reads rows of ``chunk`` ids; with ``sequence_length`` L instead rows of L + 1
    ids, one per sequence.  ``partition_tokens`` bounds what one task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return WINDOWS if "sequence_length" in self.options else CHUNKS

    def reader(self, schema) -> StreamReader:
        if "files" in self.options:
            files = [TokenFile(*f) for f in json.loads(self.options["files"])]
        else:
            files = shard_files(self.options["path"])
            if not files:
                raise ValueError(f"{self.options['path']} holds no token shards")
        length = int(self.options.get("sequence_length", 0))
        step = length or int(self.options.get("chunk", 1 << 16))
        tokens = int(self.options.get("partition_tokens", 1 << 24))
        return StreamReader(files, step, 1 if length else 0, tokens, bool(length))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite)


def assign_shards(df: DataFrame, order: Sequence[str], shards: int = MAX_SHARDS, **kw) -> DataFrame:
    """Adds ``start`` and ``shard``: contiguous runs of documents of each split."""
    placed = ordered_sums(
        df, {"start": "n", "rank": F.lit(1).cast("long")}, order, ("split",), **kw
    )
    return placed.withColumn("shard", contiguous_shard(F.col("rank"), F.col("rank_total"), shards))


def write_token_shards(
    df: DataFrame, path: str, order: Sequence[str], shards: int = MAX_SHARDS, overwrite: bool = False, **kw
) -> None:
    """Write the ids ``(split, ids, n, order...)`` of all splits as ordered token files.

    Each shard is one task, placed by its number, so no two shards share a task
    and shards are written in parallel.
    """
    df.sparkSession.dataSource.register(TokenShards)
    rows = assign_shards(df, order, shards, **kw)
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}  # one row a split
    if unknown := set(counts) - set(SPLITS):
        raise ValueError(f"unknown splits {sorted(unknown, key=str)}")
    first, tasks = {}, 0
    for split, count in counts.items():
        first[split] = tasks
        tasks += min(shards, count)
    base = F.lit(0)
    for split, task in first.items():
        base = F.when(F.col("split") == split, task).otherwise(base)
    (
        rows.select("split", "shard", "start", "ids", (base + F.col("shard")).alias("task"))
        .repartitionById(max(1, tasks), "task")
        .drop("task")
        .sortWithinPartitions("split", "shard", "start")
        .write.format("token_shards")
        .mode("overwrite" if overwrite else "append")
        .save(path)
    )
