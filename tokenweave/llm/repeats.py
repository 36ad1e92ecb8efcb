"""Removal of repeated byte strings by the common-prefix interval tree of a sampled suffix array.

Of the windows of ``length`` bytes each chooses the place with the least hash of ``GRAM`` bytes, its anchor; equal windows
choose anchors at equal places, so all occurrences of a repeat meet in the group of one anchor hash.  Equal
surroundings of anchors are counted first and go on once.  In a group with several surroundings the suffixes at the
anchors, sorted by Spark, and their common prefixes make an enhanced suffix array; a stack scan gives its interval
tree.  In each interval the texts before the anchors are scanned the same way: a stretch of them whose left and whose
right neighbours differ is a maximal repeat, and all its members are its occurrences.

A group of more than ``MEMBERS`` surroundings, such as a passage that a third of all documents quote, is split by halves
of the places that windows can have around the anchor: windows of one half share a longer core, so groups fall apart,
and what has become equal is counted and not compared; at single windows counting is all that is left.

Edge cases: a null or empty text has no bytes; texts below ``length`` bytes have nothing removed; repeated rows and
repeated or null keys are documents of their own, and copies of one another; matches may overlap, also within one
document; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.llm.shingles import MIX, mixed
from tokenweave.llm.text import ROW, with_fixed_rows
from tokenweave.session import stage

LENGTH = 400
#: Bytes whose hash chooses the anchor of a window.
GRAM = 64
#: Bytes that are sampled together; longer texts are cut into overlapping parts.
PART = 1 << 18
#: Distinct surroundings of a group that one interval tree is built over.
MEMBERS = 1000
#: Low bits of an anchor choice that hold the place; the hash is above them.
PLACE = np.uint64((1 << 24) - 1)

HITS = "id binary, left int, right int, repeat binary"


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    return tuple(
        np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64))
    )


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, from running sums."""
    up, down = _powers(4 * PART if len(raw) < 4 * PART else 1 << len(raw).bit_length())
    sums = np.append(np.uint64(0), np.cumsum(BYTES[raw] * up[: len(raw)]))
    return mixed((sums[size:] - sums[:-size]) * down[: len(raw) - size + 1])


def _least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: of a tail of one block and a head of the next."""
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, width)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(tails[:count], heads[width - 1 : width - 1 + count])


def anchors(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """``(part, place in the part, a, b, core)``: the anchors of all windows of each part.

    The windows that chose an anchor start ``a`` to ``b`` bytes before it; ``core`` is its hash.
    """
    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    grams = gram_hashes(raw, GRAM)
    chosen = _least_ahead(grams & ~PLACE | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1) & PLACE
    counts = sizes - length + 1
    starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    at = chosen[starts].astype(np.int64)
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (np.diff(starts) != 1)))
    last = np.append(first[1:], len(at)) - 1
    x = at[first]
    part = np.repeat(np.arange(len(parts)), counts)[first]
    return part, x - begin[part], x - starts[last], x - starts[first], grams[x].view(np.int64)


def sampled_anchors(texts: DataFrame, length: int) -> DataFrame:
    """``(row__, x, a, b, core, id)`` of all anchors; ``id`` names the bytes of all its windows."""

    def made(rows, offsets, parts) -> pa.RecordBatch:
        part, at, a, b, core = anchors(parts, length)
        views = [memoryview(p) for p in parts]
        spans = zip(part.tolist(), (at - b).tolist(), (at - a + length).tolist(), a.tolist())
        ids = [xxhash.xxh3_128_digest(views[p][s:e], seed=first) for p, s, e, first in spans]
        columns = [np.array(rows)[part], np.array(offsets)[part] + at, a.astype(np.int32), b.astype(np.int32), core]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ids, pa.binary())], names=[ROW, "x", "a", "b", "core", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, offsets, parts, size = [], [], [], 0
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                for at in range(0, len(raw) - length + 1, PART):
                    rows.append(row)
                    offsets.append(at)
                    parts.append(raw[at : at + PART + length - 1])
                    size += len(parts[-1])
                    if size >= PART:
                        yield made(rows, offsets, parts)
                        rows, offsets, parts, size = [], [], [], 0
        if parts:
            yield made(rows, offsets, parts)

    long = texts.where(F.octet_length("raw") >= length)
    return long.select(ROW, "raw").mapInArrow(run, f"{ROW} long, x long, a int, b int, core long, id binary")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(depth, first, last)`` of the intervals of a sorted list, inner ones first.

    ``shared[i]`` is the common prefix of entries ``i`` and ``i + 1``; within an interval all of them are at least
    ``depth``, and one is equal to it.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*shared, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            inner, first = stack.pop()
            yield inner, first, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """``(left, right, members)``: maximal repeats of ``length`` and more bytes with all members that they occur at.

    ``rights`` are sorted texts from the anchors on, ``lefts`` the texts before them.
    """
    back = [x[::-1] for x in lefts]
    rank = {i: k for k, i in enumerate(sorted(range(len(back)), key=back.__getitem__))}
    shared = [common(x, y) for x, y in zip(rights, rights[1:])]
    for right, first, last in intervals(shared):
        branch, branches = 0, {first: 0}
        for i in range(first + 1, last + 1):
            branch += shared[i - 1] == right
            branches[i] = branch
        members = sorted(range(first, last + 1), key=rank.__getitem__)
        for left, s, t in intervals([common(back[x], back[y]) for x, y in zip(members, members[1:])]):
            found = members[s : t + 1]
            # On the right it cannot be longer if the members go on in several branches of the interval.
            if left + right >= length and len({branches[i] for i in found}) > 1:
                yield left, right, found


def repeated_stretches(members: DataFrame, length: int) -> DataFrame:
    """Rows of ``HITS``: how far to either side of its anchor each member has company, longest stretches only.

    ``members`` has ``group``, ``id``, ``b`` and ``raw``, the bytes of the member's windows; ``b`` of them precede the anchor.
    """
    lined = members.withColumn("suffix", F.expr("substring(raw, b + 1)")).repartition("group")
    lined = lined.sortWithinPartitions("group", "suffix", "id").select("group", "id", "b", "raw")

    def found(group: list[tuple[bytes, int, bytes]], out: list) -> None:
        best = [-1] * len(group)
        lefts, rights = [raw[:b] for _, b, raw in group], [raw[b:] for _, b, raw in group]
        for left, right, places in maximal_repeats(lefts, rights, length):
            name = xxhash.xxh3_128_digest(lefts[places[0]][len(lefts[places[0]]) - left :] + rights[places[0]][:right])
            for i in places:
                if left > best[i]:
                    best[i] = left
                    out.append((group[i][0], left, right, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in HITS.split(", ")]
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        last, group = None, []
        for batch in batches:
            out: list = []
            for key, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    found(group, out)
                    last, group = key, []
                group.append(member)
            yield _rows(out, names, kinds)
        out = []
        found(group, out)
        yield _rows(out, names, kinds)

    return lined.mapInArrow(run, HITS)


def _rows(out: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def _whole(spans: DataFrame, length: int) -> DataFrame:
    """Surroundings that are there more than once repeat as a whole."""
    return spans.where("n > 1").select("id", F.col("b").alias("left"), (F.lit(length) - F.col("a")).alias("right"), F.col("id").alias("repeat"))


def _sized(spans: DataFrame, name: str) -> DataFrame:
    """Members of groups with several surroundings, and ``members``, their number."""
    sizes = stage(spans.groupBy("group").agg(F.count("*").alias("members")).where("members > 1"), name)
    return spans.join(sizes, "group")


def _halves(members: DataFrame, bit: int, length: int) -> DataFrame:
    """The members' windows by places ``i << bit``: ``(parent, group, id, n, a, b, raw)``.

    Windows that start ``low`` to ``high`` bytes before the anchor share the bytes from ``low`` before it to
    ``length - high`` behind it.
    """
    low = F.shiftleft("i", bit)
    high = F.least(low + ((1 << bit) - 1), F.lit(length - GRAM))
    each = members.withColumn("i", F.explode(F.sequence(F.shiftright("a", bit), F.shiftright("b", bit))))
    each = each.withColumns({"low": low, "high": high}).withColumns({"a2": F.greatest("a", "low"), "b2": F.least("b", "high")})

    def cut(start: str, size: str) -> Column:
        return F.expr(f"substring(raw, {start}, {size})")

    each = each.withColumns(
        {
            "core": F.xxhash64("group", F.lit(bit), "low", cut("b - low + 1", f"low + {length} - high")),
            "part": cut("b - b2 + 1", f"b2 + {length} - a2"),
        }
    )
    name = F.concat("part", F.concat_ws(":", "core", "a2", "b2").cast("binary"))
    return each.select(
        F.col("id").alias("parent"), F.col("core").alias("group"), F.unhex(F.sha2(name, 256)).alias("id"), "n",
        F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("part").alias("raw"),
    )


def _company(members: DataFrame, length: int) -> DataFrame:
    """Rows of ``HITS`` for members of groups of any size."""
    steps, hits = [], [repeated_stretches(members.where(F.col("members") <= MEMBERS), length)]
    large = members.where(F.col("members") > MEMBERS)
    for bit in reversed(range((length - GRAM).bit_length())):
        if large.isEmpty():
            break
        parts = stage(_halves(large, bit, length), "repeat-halves")
        steps.append(parts.select("parent", "id"))
        merged = stage(parts.groupBy("group", "id", "a", "b").agg(F.sum("n").alias("n"), F.max("raw").alias("raw")), "repeat-parts")
        sized = stage(_sized(merged, "repeat-sizes"), "repeat-members")
        hits.append(_whole(merged, length).unionByName(repeated_stretches(sized.where(F.col("members") <= MEMBERS), length)))
        large = sized.where(F.col("members") > MEMBERS)
    found = hits.pop()
    while steps:
        upward = steps.pop().join(stage(found, "repeat-hits"), "id").drop("id").withColumnRenamed("parent", "id")
        found = hits.pop().unionByName(upward)
    return found


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    return with_fixed_rows(docs.select(F.col(key).alias("own__"), raw.alias("raw")))


def _occurrences(texts: DataFrame, length: int) -> DataFrame:
    """``(row__, start, end, repeat)``: stretches of ``length`` and more bytes that occur elsewhere."""
    sampled = stage(sampled_anchors(texts, length), "anchors")
    spans = stage(
        sampled.groupBy(F.col("core").alias("group"), "id").agg(
            F.count("*").alias("n"), F.min(F.struct(ROW, "x", "a", "b")).alias("at")
        ).select("group", "id", "n", "at.*"),
        "spans",
    )
    members = stage(_sized(spans, "span-groups"), "span-members")
    raw = F.expr(f"substring(raw, cast(x - b + 1 as int), b + {length} - a)")
    members = texts.select(ROW, "raw").join(members, ROW).select("group", "id", "n", "a", "b", "members", raw.alias("raw"))
    hits = stage(_whole(spans, length).unionByName(_company(stage(members, "members"), length)), "repeats")
    return sampled.join(hits, "id").select(
        ROW, (F.col("x") - F.col("left")).alias("start"), (F.col("x") + F.col("right")).alias("end"), "repeat"
    )


def repeat_groups(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(repeat, size, key, start)``: repeats of at least ``length`` bytes around the sampled anchors, with their occurrences.

    A repeat is named by its bytes; a longer one shows at each of its anchors, ``length`` bytes to either side at most.
    """
    texts = _texts(docs, key, text)
    found = _occurrences(texts, length).distinct()
    return found.join(texts.select(ROW, "own__"), ROW).select(
        "repeat", (F.col("end") - F.col("start")).alias("size"), F.col("own__").alias(key), "start"
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs`` its ``key``, ``n_bytes``, ``removed array<struct<start, end>>`` and ``kept``, the bytes left."""
    texts = _texts(docs, key, text)
    spans = _occurrences(texts, length).groupBy(ROW).agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for raw, found in zip(batch.column(1), batch.column(2).to_pylist()):
                raw, runs = raw.as_py(), []
                for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                sizes.append(len(raw))
                removed.append([{"start": s, "end": e} for s, e in runs])
                borders = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[s:e] for s, e in zip(borders[::2], borders[1::2])))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["own", "n_bytes", "removed", "kept"])

    joined = texts.join(stage(spans, "repeat-spans"), ROW, "left").select("own__", "raw", "spans")
    kind = docs.schema[key].dataType.simpleString()
    made = joined.mapInArrow(run, f"own {kind}, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary")
    return made.withColumnRenamed("own", key)
