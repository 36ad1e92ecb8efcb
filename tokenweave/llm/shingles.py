"""Word shingles, universal hash minima and Jaccard checks, as Arrow batches inside tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

#: Words whose hashes a worker remembers; a full memory is emptied.
REMEMBERED = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words given as bytes, computed at first sight."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hashes of all windows of ``width`` words; of all words if they are fewer."""
    width = min(width, len(hashes))
    if not width:
        return np.zeros(0, np.uint64)
    count = len(hashes) - width + 1
    found = np.full(count, width, np.uint64)
    for k in range(width):
        found = (found + hashes[k : k + count]) * MIX
        found ^= found >> np.uint64(29)
    return mixed(found)


def shingle_set(text: str | None, width: int, table: WordHashes) -> np.ndarray:
    """Sorted distinct shingles of a text, with A-Z in lower case and words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(windows(table.of(words), width)) if words else np.zeros(0, np.uint64)


class Minima:
    """``count`` universal hash functions (multiply-add with odd factors) and their minima over a set."""

    def __init__(self, count: int, seed: int = 2357):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, count, np.uint64)

    def of(self, values: np.ndarray, chunk: int = 1024) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(values), chunk):
            part = values[at : at + chunk, None] * self.a + self.b
            np.minimum(least, part.min(axis=0), out=least)
        return least


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` minima so that a pair at the threshold shares none with probability ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity**rows)))


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of the last axis, different between bands."""
    grouped = minima.reshape(*minima.shape[:-1], -1, rows)
    key = np.arange(1, grouped.shape[-2] + 1, dtype=np.uint64)
    for k in range(rows):
        key = mixed((key + grouped[..., k]) * MIX)
    return key


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrays of one batch as a list column."""
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)).cast(kind))


def shingles_udf(width: int):
    """Column function: text to its sorted shingle hashes."""

    @F.arrow_udf("array<bigint>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WordHashes()
        for texts in batches:
            yield lists([shingle_set(t, width, table) for t in texts.to_pylist()], pa.int64())

    return shingles


def equal_minima(left, right):
    """Number of equal entries of two signature columns."""

    @F.arrow_udf("int")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist())
        return pa.array(
            [int((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum()) for x, y in pairs], pa.int32()
        )

    return count(left, right)
