"""Sum-of-squares online packing of token sequences.

Every task packs its own input split, so nothing is shuffled.  A document's ids are
cut into full windows; what is left goes to the fill level for which the sum of the
squared counts of partially filled windows is smallest, tracked in an array over all levels.
At the end of a split the windows still open are emptied into one
stream, which is cut into full windows and a rest of power-of-two lengths: no padding is left.

Edge cases: a null or empty text is its end id alone; repeated rows and repeated or null
ids are documents of their own; the end-of-text literal in a text gets the id that the
tokenizer's file gives it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LENGTH = 2048
END_ID = 1

#: A tokenizer file beyond this is refused instead of broadcast.
MAX_TOKENIZER_BYTES = 64 << 20
#: Pieces, and their ids, that a worker remembers; a memory that either fills is emptied.
REMEMBERED = 1_000_000
REMEMBERED_IDS = 16_000_000
#: New pieces that are encoded as one text.
TOGETHER = 200
#: Input splits per 2**36 sequences: ids of sequences are numbered within a split.
SEQUENCE_BITS = 36

# A single space between two other characters always starts a token of a byte-level vocabulary.
CLOSE = re.compile(r"\s | \s")
CUT = re.compile(r"(?<=\S) (?=\S)")


class Known(dict):
    """Numbers of pieces, given at first sight; new ones wait in ``new`` for their ids."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Grown:
    """An array that numbers are put behind; its room doubles, so each is copied a few times at most."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.room):
            wider = np.zeros(max(size, 2 * len(self.room)), self.room.dtype)
            wider[: self.size] = self.room[: self.size]
            self.room = wider
        self.room[self.size : size] = more
        self.size = size


class PieceCoder:
    """Ids of texts, made of remembered ids of the pieces between single spaces."""

    def __init__(self, file: str):
        # One thread a task: Spark gives out the cores, and every thread would hold memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_str(file)
        for token in self.coder.get_added_tokens_decoder().values():
            if token.lstrip or token.rstrip or token.single_word or " " in token.content:
                raise ValueError(f"the added token {token.content!r} does not stand for itself alone")
        vocabulary = self.coder.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.flat, self.starts, self.sizes = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.coder.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def learn(self) -> None:
        """Ids of the new pieces, each as it stands behind a space."""
        new, self.known.new = self.known.new, []
        plain = [bool(p) and " " not in p and not p[0].isspace() and not p[-1].isspace() for p in new]
        easy = [p for p, ok in zip(new, plain) if ok]
        groups = [" " + " ".join(easy[at : at + TOGETHER]) for at in range(0, len(easy), TOGETHER)]
        ids = np.concatenate([np.zeros(0, np.uint32), *self._ids(groups)])
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(easy):
            raise ValueError("the vocabulary does not start its tokens at spaces")
        odd = self._ids([" " + p for p, ok in zip(new, plain) if not ok])
        odd_sizes = np.array([len(x) for x in odd], np.int64)
        plain = np.array(plain, bool)
        at, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        at[plain], sizes[plain] = starts, np.diff(np.append(starts, len(ids)))
        at[~plain], sizes[~plain] = len(ids) + np.cumsum(odd_sizes) - odd_sizes, odd_sizes
        self.starts.add(self.flat.size + at)
        self.sizes.add(sizes)
        for x in (ids, *odd):
            self.flat.add(x)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED or self.flat.size > REMEMBERED_IDS:
            self.clear()
        number, firsts, numbers = self.known.__getitem__, [], []
        for text in texts:
            text = text or ""
            pieces = CUT.split(text) if CLOSE.search(text) else text.split(" ")
            firsts.append(pieces[0])
            numbers.append(np.fromiter(map(number, pieces[1:]), np.int64, len(pieces) - 1))
        self.learn()
        out = []
        for first, at in zip(self._ids(firsts), numbers):
            starts, sizes = self.starts.room[at], self.sizes.room[at]
            before = np.cumsum(sizes) - sizes
            rest = self.flat.room[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]
            out.append(np.concatenate([first, rest]))
        return out


class Levels:
    """Open windows by fill level, and the level at which a piece adds least to the sum of squares."""

    def __init__(self, length: int):
        self.length = length
        self.count = np.zeros(length + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(length)]

    def place(self, size: int) -> int:
        """Level, zero for a new window, that a piece of this size goes to."""
        most = self.length - size
        before = self.count[: most + 1]
        after = self.count[size : self.length + 1].copy()
        after[-1] = 0  # a full window is no longer counted
        # (a+1)^2 - a^2 for the level reached and (b-1)^2 - b^2 for the one left; a full window adds nothing.
        change = 2 * after + 1
        change[-1] = 0
        change = change - np.where(before > 0, 2 * before - 1, 0)
        change[(before == 0) & (np.arange(most + 1) > 0)] = np.iinfo(np.int64).max
        return int(np.argmin(change))

    def add(self, piece: tuple, size: int) -> list | None:
        """Puts a piece in a window; gives the window when that fills it."""
        level = self.place(size)
        window = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        window.append(piece)
        if level + size == self.length:
            return window
        self.open[level + size].append(window)
        self.count[level + size] += 1
        return None

    def rest(self) -> list[list]:
        return [w for level in self.open for w in level]


def _cut(window: list, length: int) -> Iterator[list]:
    """Pieces laid end to end, cut into sequences of ``length`` and a rest of powers of two."""
    total = sum(len(ids) for _, _, ids in window)
    sizes = [length] * (total // length)
    left = total % length
    sizes += [1 << i for i in reversed(range(left.bit_length())) if left >> i & 1]
    pieces = iter(window)
    held = None
    for size in sizes:
        made, room = [], size
        while room:
            doc, start, ids = held or next(pieces)
            made.append((doc, start, ids[:room]))
            held = (doc, start + room, ids[room:]) if len(ids) > room else None
            room -= min(room, len(ids))
        yield made


_CODERS: dict[str, PieceCoder] = {}


def _coder(file: str) -> PieceCoder:
    """The coder of this worker process for a tokenizer file's content."""
    import hashlib

    name = hashlib.sha256(file.encode()).hexdigest()
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = PieceCoder(file)
    return _CODERS[name]


def pack_documents(
    docs: DataFrame, tokenizer: str, carry: tuple[str, ...] = ("doc_id",), length: int = LENGTH, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: ``carry`` columns, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``ids`` are unsigned little-endian 32-bit numbers.  ``tokenizer`` is the path of a
    byte-level tokenizer file; its content is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    if os.path.getsize(tokenizer) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is larger than {MAX_TOKENIZER_BYTES} bytes")
    with open(tokenizer, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())
    light = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").alias("text__"))
    schema = T.StructType(
        light.schema.fields[:-1]
        + T.StructType.fromDDL(
            "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
        ).fields
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, levels = _coder(file.value), Levels(length)
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        arrow = to_arrow_schema(schema)
        made, numbered = [], 0

        def emit(window: list) -> None:
            nonlocal numbered
            at = 0
            for (key, total), start, ids in window:
                made.append((*key, start, len(ids), ids.astype("<u4").tobytes(), total, base + numbered, at))
                at += len(ids)
            numbered += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*made)) or [()] * len(arrow)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            made.clear()
            return batch

        for batch in batches:
            keys = list(zip(*[c.to_pylist() for c in batch.columns[:-1]])) if carry else [()] * batch.num_rows
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for at in range(0, len(texts), 256):
                for key, ids in zip(keys[at : at + 256], coder.encode(texts[at : at + 256])):
                    ids = np.append(ids, np.uint32(end_id))
                    doc = (key, len(ids))
                    full = len(ids) // length * length
                    for start in range(0, full, length):
                        emit([(doc, start, ids[start : start + length])])
                    if full < len(ids):
                        window = levels.add((doc, full, ids[full:]), len(ids) - full)
                        if window:
                            emit(window)
                if made:
                    yield flush()
        for window in _cut([p for w in levels.rest() for p in w], length):
            emit(window)
        if made:
            yield flush()

    return light.mapInArrow(run, schema)
