"""Reading flat token files by position.

A stream may lie in several files one after the other; a reader partition is a
range of the stream and reads only its bytes, across file borders where needed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSourceReader, InputPartition

from tokenweave.sources.files import filesystem

# Fixed value: the word on disk.
WORD = np.dtype("<u2")

MANIFEST = "manifest.json"
CHUNKS = "split string, start bigint, ids array<int>"
WINDOWS = "split string, seq_id bigint, t array<int>"


@dataclass(frozen=True)
class TokenFile:
    """One file of a stream: its place in the stream, and where it is."""

    split: str
    start: int
    n_tokens: int
    path: str


@dataclass
class StreamRange(InputPartition):
    """Ids ``[first, last)`` of a stream, and the files that hold them."""

    split: str
    first: int
    last: int
    files: list[TokenFile]


def read_manifest(path: str) -> list[dict]:
    """Shards of a folder, in stream order; none when nothing was committed."""
    files, root = filesystem(path)
    try:
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return []


def shard_files(path: str) -> list[TokenFile]:
    """The files of a folder of token shards."""
    return [
        TokenFile(s["split"], s["start"], s["n_tokens"], f"{path}/{s['split']}/shard-{s['shard']:05d}.bin")
        for s in read_manifest(path)
    ]


def plain_files(paths: Mapping[str, Sequence[str]]) -> list[TokenFile]:
    """Headerless token files without a manifest: the files of each split, in order."""
    found = []
    for split, names in paths.items():
        start = 0
        for name in names:
            files, inside = filesystem(name)
            size = files.get_file_info(inside).size
            if size is None or size % WORD.itemsize:
                raise ValueError(f"{name} is not a file of two-byte words")
            found.append(TokenFile(split, start, size // WORD.itemsize, name))
            start += size // WORD.itemsize
    return found


def read_span(files: Sequence[TokenFile], first: int, last: int) -> np.ndarray:
    """Ids ``[first, last)`` of the stream that ``files`` hold in order."""
    parts = [np.zeros(0, WORD)]
    for f in files:
        low, high = max(first, f.start), min(last, f.start + f.n_tokens)
        if low < high:
            store, inside = filesystem(f.path)
            with store.open_input_file(inside) as stream:
                stream.seek((low - f.start) * WORD.itemsize)
                parts.append(np.frombuffer(stream.read((high - low) * WORD.itemsize), WORD))
    return np.concatenate(parts)


class StreamReader(DataSourceReader):
    """Rows of ``step`` ids each, and of the ``ahead`` ids after them."""

    def __init__(self, files: Sequence[TokenFile], step: int, ahead: int, partition_tokens: int, numbered: bool):
        self.files = list(files)
        self.step = step
        self.ahead = ahead
        self.run = max(1, partition_tokens // step) * step
        self.numbered = numbered

    def partitions(self) -> list[StreamRange]:
        ranges = []
        for split in dict.fromkeys(f.split for f in self.files):
            mine = [f for f in self.files if f.split == split]
            total = sum(f.n_tokens for f in mine)
            # With ids ahead only whole rows count; without, the last row may be short.
            end = max(0, total - self.ahead) // self.step * self.step if self.ahead else total
            at = 0
            for first in range(0, end, self.run):
                last = min(first + self.run, end)
                while mine[at].start + mine[at].n_tokens <= first:
                    at += 1
                reach = at
                while reach < len(mine) and mine[reach].start < last + self.ahead:
                    reach += 1
                ranges.append(StreamRange(split, first, last, mine[at:reach]))
        return ranges

    def read(self, partition: StreamRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read a source without partitions
            return
        # A few thousand rows at a time keep the batches small for any row length.
        rows = max(1, (1 << 20) // self.step)
        for low in range(partition.first, partition.last, rows * self.step):
            high = min(low + rows * self.step, partition.last)
            words = read_span(partition.files, low, high + self.ahead).astype(np.int32)
            starts = np.arange(low, high, self.step)
            if self.ahead:
                width = self.step + self.ahead
                ids = np.lib.stride_tricks.sliding_window_view(words, width)[:: self.step].reshape(-1)
                ends = np.arange(0, len(starts) * width + 1, width)
            else:
                ids, ends = words, np.append(starts - low, high - low)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            place = starts // self.step if self.numbered else starts
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.split] * len(starts)), pa.array(place.astype(np.int64)), lists],
                names=["split", "seq_id" if self.numbered else "start", "t" if self.numbered else "ids"],
            )
