"""Line deduplication: equal lines, and lines within a few edits by a segment-partition join.

A line within ``edits`` of a shorter or equally long one contains one of its
``edits + 1`` segments near the segment's place.  Without a number, the edits grow with the shorter line: one for
every ``PER`` characters, ``MOST`` at most.  Index entries (a line's segments) and probes
(substrings of lines, by the length they are looked for in) meet by hash in one shuffle of sorted blocks; candidates
are verified by an edit distance along diagonals.  The first index entries of a key are its hubs, which meet all that
comes behind them; only where a key has more index entries than that, what is left of it in several components meets block
against block.  Of every component of linked lines the first line stays.

Lines are what stands between newlines.  Lines shorter than ``min_chars`` are near no other; with ``words`` those
that hold a letter or a digit count as equal lines, without it they stay everywhere.  Edge cases: a null text has no lines and stays null; repeated
rows are copies; null ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.llm.buckets import unsettled_links
from tokenweave.llm.components import connected_components, merged_components
from tokenweave.llm.edits import probes, segments, within
from tokenweave.llm.shingles import MIX, mixed
from tokenweave.llm.text import ROW, packed, unpacked, with_fixed_rows
from tokenweave.session import release, stage

#: Characters of the shorter line that allow an edit, and the edits that any line allows at most.
PER = 20
MOST = 4
MIN_CHARS = 20
#: Lines that a task remembers to have emitted already; a full memory is emptied.
REMEMBERED = 500_000
#: Characters of the lines whose entries a task makes at a time.
GROUP = 1 << 17
#: Entries that a task sorts into blocks at a time, and cells of the keys for each shuffle partition.
FLUSH = 1 << 21
CELLS = 4
#: Index entries of a key that are paired with whatever comes behind them.
HUBS = 2


def _name(one: str, two: str):
    """The 128-bit name of a line."""
    return F.concat(F.hex(one), F.lit("-"), F.hex(two))


def _lines(docs: DataFrame, min_chars: int, words: bool = False) -> DataFrame:
    """The lines that count, with their hashes; with ``words`` also shorter ones that hold a word."""
    each = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    counts = (F.length("line") >= min_chars) & (F.trim("line") != "")
    if words:
        counts |= F.col("line").rlike(r"[\p{L}\p{N}]")
    return each.where(counts).withColumns(
        {"one": F.xxhash64("line"), "two": F.xxhash64(F.lit(7), F.col("line"))}
    )


def allowed(length: int, edits: int | None) -> int:
    """Edits that a line of ``length`` may be away from an equally long or longer one."""
    return min(MOST, max(1, length // PER)) if edits is None else edits


BLOCKS = "cell int, base bigint, heads int, keys binary, refs binary"
#: In place of the number of index entries: the row has the lines' hashes.
NAMES = -1
#: What a row of two numbers is: a pair of lines, a line and its hash, or the first hub of a key and a line behind its hubs.
PAIR, NAMED, REST = range(3)


def candidate_pairs(docs: DataFrame, edits: int | None, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """``(hub, node)``: lines, by a hash, of which one looks up a segment of the other; and ``(bucket, short)`` of those behind the hubs.

    Tasks number their distinct lines and put the index entries and probes into blocks, one for each cell of the keys:
    four bytes of a key and three of a line number an entry, index entries first.  Those of all blocks of a cell are
    met together, so a task holds the entries of a cell and not their lines.  Lines that one of them looks up in another
    are a pair of the first frame, or both in a bucket of the second.  The numbers are replaced by the lines' hashes at the end.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bits = (CELLS * partitions - 1).bit_length()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = lru_cache(maxsize=4096)(_plan), set()
        base = TaskContext.get().partitionId() << 36
        held, nodes, count, lines, chars = [], [], 0, [], 0

        def entries():
            return _entries(lines, np.arange(len(nodes) - len(lines), len(nodes)), edits, plan)

        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) < min_chars or not line.strip(" "):
                        continue
                    node = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                    if node in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    lines.append(line)
                    nodes.append(node)
                    chars += len(line)
                    if chars >= GROUP:
                        held.append(entries())
                        count, lines, chars = count + len(held[-1][0]), [], 0
                        if count >= FLUSH:
                            yield _blocks(held, nodes, base, bits)
                            base, held, nodes, count = base + len(nodes), [], [], 0
        if lines:
            held.append(entries())
        if nodes:
            yield _blocks(held, nodes, base, bits)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for this, base, heads, keys, refs in zip(*(batch.column(i) for i in range(5))):
                base, heads, keys, refs = base.as_py(), heads.as_py(), keys.as_py(), refs.as_py()
                if heads == NAMES:
                    names = np.frombuffer(keys, np.int64)
                    yield _rows(np.arange(base, base + len(names)), names, NAMED)
                    continue
                if this.as_py() != cell:
                    yield _met(held)
                    cell, held = this.as_py(), []
                held.append((base, heads, keys, refs))
        yield _met(held)

    laid = docs.select("text").mapInArrow(blocks, BLOCKS).repartition("cell").sortWithinPartitions("cell")
    found = stage(laid.mapInArrow(pairs, "hub bigint, node bigint, kind int"), "line-runs")
    names = found.where(F.col("kind") == NAMED).select(F.col("hub").alias("id"), F.col("node").alias("name"))
    numbered = found.where(F.col("kind") == PAIR).select("hub", "node").distinct()
    first = names.withColumnsRenamed({"id": "hub", "name": "a"})
    second = names.withColumnsRenamed({"id": "node", "name": "b"})
    named = numbered.join(first, "hub").join(second, "node").where("a != b")
    pairs = stage(named.select(F.col("a").alias("hub"), F.col("b").alias("node")).distinct(), "line-pairs")
    behind = found.where(F.col("kind") == REST).select(F.col("hub").alias("bucket"), "node").distinct()
    rest = stage(behind.join(second, "node").select("bucket", F.col("b").alias("short")).distinct(), "line-rest")
    release(found)
    return pairs, rest


def _met(held: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    """Pairs of the blocks of one cell: of a key's hubs and what comes behind each, index entries first.  Then the rest.

    The rest is what stands behind the hubs where that still has index entries.  Its bucket is named by the first hub, so what
    lines of a family leave behind the same one in many keys is one bucket.
    """
    none = np.zeros(0, np.int64)
    keys, ids, probes = [np.zeros(0, np.uint32)], [none], [none.astype(bool)]
    for base, heads, packed_keys, refs in held:
        wide = np.zeros((len(refs) // 3, 4), np.uint8)
        wide[:, :3] = np.frombuffer(refs, np.uint8).reshape(-1, 3)
        ids.append(wide.view("<u4").ravel().astype(np.int64) + base)
        keys.append(np.frombuffer(packed_keys, "<u4"))
        probes.append(np.arange(len(wide)) >= heads)
    keys, ids, probes = np.concatenate(keys), np.concatenate(ids), np.concatenate(probes)
    order = np.argsort(keys, kind="stable")
    several = np.append(False, keys[order[1:]] == keys[order[:-1]])[: len(order)]
    order = order[several | np.append(several[1:], False)[: len(order)]]  # most keys come once
    order = order[np.lexsort((ids[order], probes[order], keys[order]))]
    keys, ids, probes = keys[order], ids[order], probes[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    sizes = np.diff(np.append(starts, len(keys)))
    heads = np.add.reduceat(~probes, starts, dtype=np.int64) if len(starts) else none
    place, count = np.arange(len(keys)) - np.repeat(starts, sizes), np.repeat(heads, sizes)
    left, right, kinds = [], [], []
    for k in range(HUBS):
        behind = np.flatnonzero((place > k) & (count > k))
        hubs, nodes = ids[behind - place[behind] + k], ids[behind]
        left.append(hubs[hubs != nodes])
        right.append(nodes[hubs != nodes])
        kinds.append(np.full(len(left[-1]), PAIR))
    rest = np.flatnonzero((place >= HUBS) & (count > HUBS) & (np.repeat(sizes, sizes) > HUBS + 1))
    if len(rest):
        left.append(ids[rest - place[rest]])
        right.append(ids[rest])
        kinds.append(np.full(len(rest), REST))
    return _rows(np.concatenate(left), np.concatenate(right), np.concatenate(kinds))


def _rows(left: np.ndarray, right: np.ndarray, kind: int | np.ndarray) -> pa.RecordBatch:
    kinds = np.broadcast_to(np.asarray(kind, np.int32), left.shape)
    columns = [pa.array(left), pa.array(right), pa.array(np.ascontiguousarray(kinds))]
    return pa.RecordBatch.from_arrays(columns, names=["hub", "node", "kind"])


def _blocks(held: list[tuple[np.ndarray, ...]], nodes: list[int], base: int, bits: int) -> pa.RecordBatch:
    """Entries sorted by cell, kind and key, a row for each cell, and a row of the lines' hashes."""
    keys, kinds, refs = (np.concatenate([x[i] for x in held]) for i in range(3))
    place = (keys >> np.uint64(64 - bits)) << np.uint64(33) | kinds.astype(np.uint64) << np.uint64(32)
    place |= (keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)
    order = np.argsort(place)
    place, refs = place[order], refs[order].astype("<u4")
    cells = place >> np.uint64(33)
    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    heads = np.add.reduceat((place >> np.uint64(32) & np.uint64(1)) == 0, starts, dtype=np.int32)
    cells, ends = cells[starts], np.append(starts, len(place))
    short = np.ascontiguousarray(refs.view(np.uint8).reshape(-1, 4)[:, :3])
    keys = (place & np.uint64(0xFFFFFFFF)).astype("<u4")
    # The hashes go to any one cell.
    names = np.array(nodes, np.uint64).tobytes()
    one = xxhash.xxh64_intdigest(str(base)) % (1 << bits)
    columns = [
        pa.array(np.append(cells, one).astype(np.int32)),
        pa.array(np.full(len(cells) + 1, base)),
        pa.array(np.append(heads, NAMES).astype(np.int32)),
        _binaries(ends * 4, keys.tobytes(), names),
        _binaries(ends * 3, short.tobytes(), b""),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["cell", "base", "heads", "keys", "refs"])


def _binaries(ends: np.ndarray, data: bytes, last: bytes) -> pa.Array:
    offsets = np.append(ends, len(data) + len(last)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data + last)])


def _entries(lines: list[str], refs: np.ndarray, edits: int | None, plan) -> tuple[np.ndarray, ...]:
    """``(key, kind, line)`` of lines, from running sums of scrambled characters times powers of an odd number."""
    sizes = np.array([len(line) for line in lines])
    wide = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _powers(len(wide) + 1)
    sums = np.append(np.uint64(0), np.cumsum(mixed(wide + MIX) * up[:-1]))
    plans = [plan(n, edits) for n in sizes.tolist()]
    counts = np.array([len(p[0]) for p in plans])
    start, end, seed, probe = (np.concatenate([p[i] for p in plans]) for i in range(4))
    at = np.repeat(np.cumsum(sizes) - sizes, counts)
    start, end = start + at, end + at
    keys = mixed((sums[end] - sums[start]) * down[start] + seed * MIX)
    return keys, probe, np.repeat(refs, counts)


@lru_cache(maxsize=1)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    return tuple(
        np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64))
    )


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse modulo 2^64."""
    up, down = _power_table(max(2 * GROUP, 1 << size.bit_length()))
    return up[:size], down[:size]


def _plan(length: int, edits: int | None) -> tuple[np.ndarray, ...]:
    """``(from, to, seed, probe)`` of a line's entries, an array each."""
    own = [(at, at + size, length * 64 + i, 0) for i, (at, size) in enumerate(segments(length, allowed(length, edits)))]
    numbers = {n: allowed(n, edits) for n in range(max(1, length - allowed(length, edits)), length + 1)}
    looked = [
        (at, at + size, other * 64 + i, 1)
        for most in set(numbers.values())
        for other, i, at, size in probes(length, most)
        if numbers.get(other) == most
    ]
    start, end, seed, probe = np.array(own + looked, np.int64).T
    return start, end, seed.astype(np.uint64), probe.astype(np.int32)


def near(a: str, b: str, edits: int | None) -> bool:
    return within(a, b, allowed(min(len(a), len(b)), edits))


#: Bits of a line's signature, and counts beside it.
SIGNATURE = 512
COUNTS = 512
#: Pairs of lines whose counts are compared at a time.
PAIRS = 1 << 12


@lru_cache(maxsize=1 << 14)
def signed(line: str) -> tuple[str, np.ndarray, np.ndarray]:
    """A line with a bit for the hash of each of its runs of three characters, and how often hashes of two come."""
    wide = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    twos = mixed(wide[:-1] * MIX + wide[1:]) % np.uint64(COUNTS)
    runs = mixed((wide[:-2] * MIX + wide[1:-1]) * MIX + wide[2:]) if len(wide) > 2 else wide[:0]
    bits = np.zeros(SIGNATURE, np.uint8)
    bits[runs % np.uint64(SIGNATURE)] = 1
    counts = np.minimum(np.bincount(twos.astype(np.int64), minlength=COUNTS), 255).astype(np.uint8)
    return line, np.packbits(bits).view(np.uint64), counts


def maybe_near(left: list, right: list, edits: int | None) -> np.ndarray:
    """Which lines of two lists can be near by their lengths, signatures and counts.

    An edit takes away three runs of three characters at most and brings three, so it changes six bits at most; of runs of
    two it takes and brings two.  Counts are compared where signatures leave a pair, as those of long lines have most bits set.
    """
    sizes = [np.array([len(line) for line, _, _ in side]) for side in (left, right)]
    most = np.array([allowed(n, edits) for n in range(int(max(s.max() for s in sizes)) + 1)])
    most = most[np.minimum(sizes[0][:, None], sizes[1][None, :])]
    close = np.abs(sizes[0][:, None] - sizes[1][None, :]) <= most
    if not close.any():
        return close
    a, b = (np.stack([bits for _, bits, _ in side], axis=1) for side in (left, right))
    differ = np.zeros(close.shape, np.int16)
    for x, y in zip(a, b):  # word by word, as a whole block's differences then stay in the cache
        differ += np.bitwise_count(x[:, None] ^ y[None, :])
    close &= differ <= 6 * most
    a, b = (np.stack([counts for _, _, counts in side]) for side in (left, right))
    i, j = np.nonzero(close)
    for at in range(0, len(i), PAIRS):
        p, q = i[at : at + PAIRS], j[at : at + PAIRS]
        x, y = a[p], b[q]
        close[p, q] = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int32) <= 4 * most[p, q]
    return close


def open_lines(left: list[str], right: list[str], edits: int | None) -> np.ndarray:
    return maybe_near([signed(x) for x in left], [signed(x) for x in right], edits)


def near_lines(edits: int | None):
    """Column function: whether two lines are within ``edits``."""

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([near(x, y, edits) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    return linked


def line_verdicts(docs: DataFrame, key: str = "doc_id", edits: int | None = None, min_chars: int = MIN_CHARS, words: bool = False) -> DataFrame:
    """Per row of ``docs`` its row key, ``key__``, ``n_lines``, and the line numbers to remove.

    ``equal`` lists lines with an equal line before them, ``near`` those that only a near one precedes.
    """
    light = with_fixed_rows(docs).select(ROW, F.col(key).alias("key__"), F.col("text").cast("string").alias("text"))
    found = stage(_lines(light, min_chars, words).drop("line"), "lines")
    place = F.struct(F.col("key__").isNull().alias("none"), F.col("key__").alias("key"), F.col(ROW).alias("row"), "line_no")
    classes = stage(found.groupBy("one", "two").agg(F.min(place).alias("first")), "line-classes")
    pairs, rest = candidate_pairs(light, edits, min_chars)
    shorts = pairs.select(F.explode(F.array("hub", "node")).alias("short")).distinct()
    texts = stage(
        _lines(light.select("text"), min_chars)
        .join(shorts.withColumnRenamed("short", "one"), "one", "left_semi")
        .select(F.col("one").alias("short"), _name("one", "two").alias("node"), F.col("line").alias("payload"))
        .dropDuplicates(["node"]),
        "line-texts",
    )
    a = texts.select(F.col("short").alias("hub"), F.col("node").alias("a"), F.col("payload").alias("x"))
    b = texts.select(F.col("short").alias("node"), F.col("node").alias("b"), F.col("payload").alias("y"))
    links = stage(pairs.join(a, "hub").join(b, "node").where(near_lines(edits)("x", "y")).select("a", "b"), "line-links")
    components = connected_components(links)
    behind = rest.join(texts.select("short", "node"), "short").select("bucket", "node")
    more = unsettled_links(behind, texts, components, partial(near, edits=edits), partial(open_lines, edits=edits))
    if more is not None:
        components = merged_components(components, more)
    rooted = classes.withColumn("node", _name("one", "two")).join(components, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("component", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("best"))
    settled = stage(rooted.join(firsts, "root").select("one", "two", "first", "best"), "line-firsts")
    release(classes, pairs, rest, texts, links)
    judged = found.join(settled, ["one", "two"])
    here = (F.col(ROW) == F.col("best.row")) & (F.col("line_no") == F.col("best.line_no"))
    leads = (F.col(ROW) == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no"))
    removed = judged.groupBy(ROW).agg(
        F.count("*").alias("n_lines"),
        F.array_sort(F.collect_list(F.when(~here & ~leads, F.col("line_no")))).alias("equal"),
        F.array_sort(F.collect_list(F.when(~here & leads, F.col("line_no")))).alias("near"),
    )
    none = F.array().cast("array<int>")
    return light.select(ROW, "key__").join(removed, ROW, "left").select(
        ROW,
        "key__",
        F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"),
        F.coalesce("equal", none).alias("equal"),
        F.coalesce("near", none).alias("near"),
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", edits: int | None = None, min_chars: int = MIN_CHARS, words: bool = False) -> DataFrame:
    """``docs`` without repeated lines; a text of which nothing but white space is left goes, if it had lines removed."""
    used = (key, "text", "n_chars")
    inside = packed(docs, *used)
    held = with_fixed_rows(inside)  # a table that is read as it is needs no copy
    verdicts = line_verdicts(held, key, edits, min_chars, words).select(ROW, F.concat("equal", "near").alias("gone__"))
    joined = held.join(verdicts.where(F.size("gone__") > 0), ROW, "left")
    return unpacked(joined.transform(_without_lines, inside.columns), docs.columns, *used)


def _without_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    @F.arrow_udf("string")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, numbers in zip(texts.to_pylist(), gone.to_pylist()):
            if numbers:
                away = set(numbers)
                text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in away)
            out.append(text)
        return pa.array(out, pa.string())

    made = df.withColumn("new__", cut("text", "gone__"))
    left = made.where(F.col("gone__").isNull() | (F.length(F.regexp_replace("new__", r"\s+", "")) > 0))
    return left.select(*[_column(c) for c in columns])


def _column(name: str):
    if name == "text":
        return F.col("new__").alias("text")
    if name == "n_chars":
        return F.when(F.col("gone__").isNull(), F.col("n_chars")).otherwise(F.length("new__")).cast("long").alias("n_chars")
    return F.col(f"`{name}`")
