"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Rows are ordered by label and by the Hilbert curve through their vectors, and written as shelves: Parquet rows of
some thousand vectors, cut into blocks, each with the least and the largest value of every dimension.  Anchors lie in
chunks of the same order.  Interval arithmetic over the zone maps bounds the scores that a block can give an anchor; a
chunk is sent to the shelves, and scored against the blocks, whose bounds meet one of its windows of scores.  All else
is skipped without loss: the results are those of a scan.

Scores are integer inner products, made by floating-point products only where these are exact.  Edge cases:
rows with a null label, a null vector, or a null or non-finite component take no part; a null id is no anchor and
comes last among ties; repeated ids are rows of their own, told apart by their place in the input, and only the anchor's
own row is left out; a vector shorter than the longest one counts as zero behind its end; scores beyond
a long are refused; an empty table, or one without anchors, gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenweave.llm.text import ROW, with_fixed_rows
from tokenweave.session import stage

#: Rows of a block, and the fewest and the most of a shelf; anchors of a chunk.
BLOCK_ROWS = 512
SHELF_ROWS = (2048, 65_536)
CHUNK_ROWS = 256
#: Chunks that meet a shelf in one task, and shelves whose zones are looked through together.
SLICE_CHUNKS = 256
ZONE_SHELVES = 256
#: Bits of a dimension on the curve.
BITS = 2

SHELF = "number long, n int, ids binary, none binary, rows binary, labels binary, v binary, low binary, high binary, label_low binary, label_high binary"
HIT = "chunk long, place int, w int, id long, row long, score long"
NO_ID = np.iinfo(np.int64).max
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve through a grid of ``2**bits`` cells a side, as bytes in curve order.

    By the transposed form of the index: the axes are unrotated from the top bit down, then put into Gray code.
    """
    x = cells.astype(np.uint8)
    for bit in reversed(range(1, bits)):
        side, below = np.uint8(1 << bit), np.uint8((1 << bit) - 1)
        for d in range(x.shape[1]):
            far = (x[:, d] & side) > 0
            swap = np.where(far, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(far, below, swap).astype(np.uint8)
            x[:, d] ^= swap.astype(np.uint8)
    x = np.bitwise_xor.accumulate(x, axis=1)
    turn = np.zeros(len(x), np.uint8)
    for bit in reversed(range(1, bits)):
        turn ^= np.where(x[:, -1] & np.uint8(1 << bit), np.uint8((1 << bit) - 1), np.uint8(0))
    x ^= turn[:, None]
    planes = np.concatenate([(x >> np.uint8(bit)) & 1 for bit in reversed(range(bits))], axis=1)
    return [row.tobytes() for row in np.packbits(planes, axis=1)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of one matrix, zero behind their ends."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = column.flatten().to_numpy()
    return out


def vectors(df: DataFrame, key: str, label: Column, vector: str, scale: int, anchor: Column) -> DataFrame:
    """``(row__, id, label, v, anchor)`` of the rows that take part, ``v`` as whole numbers ``floor(scale * x)``."""
    light = df.select(
        F.col(key).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    # NaN is above infinity.
    whole = F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    taking_part = with_fixed_rows(light).where(F.col("label").isNotNull() & F.col("x").isNotNull() & whole)
    return taking_part.select(ROW, "id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"), "anchor")


def _keyed(rows: DataFrame, width: int, step: float) -> DataFrame:
    @F.arrow_udf("binary")
    def place(v: pa.Array) -> pa.Array:
        cells = np.clip(np.floor(_matrix(v, width) / step) + (1 << BITS - 1), 0, (1 << BITS) - 1)
        return pa.array(hilbert_keys(cells, BITS), pa.binary())

    return rows.withColumn("place", place("v"))


def _zones(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(v), size)
    return np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)


def _shelves(rows: DataFrame, width: int, kind: str, shelf: int, block: int) -> DataFrame:
    """``rows``, which are in order within their partitions, as shelves of at most ``shelf`` rows."""

    def made(number: int, batch: pa.RecordBatch) -> dict:
        ids, v = batch.column(1), _matrix(batch.column(3), width)
        low, high = _zones(v, block)
        labels = batch.column(2).to_numpy()
        label_low, label_high = _zones(labels, block)
        return {
            "number": number,
            "n": len(v),
            "ids": ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).tobytes(),
            "none": ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
            "rows": batch.column(0).to_numpy().tobytes(),
            "labels": labels.tobytes(),
            "v": v.astype(kind).tobytes(),
            "low": low.astype(kind).tobytes(),
            "high": high.astype(kind).tobytes(),
            "label_low": label_low.tobytes(),
            "label_high": label_high.tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 33, [], 0
        names = [(c.split()[0], {"long": pa.int64(), "int": pa.int32()}.get(c.split()[1], pa.binary())) for c in SHELF.split(", ")]
        schema = pa.schema(names)

        def out(table: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([made(number, table.combine_chunks().to_batches()[0])], schema)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= shelf:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, shelf))
                number += 1
                held, count = table.slice(shelf).to_batches(), count - shelf
        if count:
            yield out(pa.Table.from_batches(held))

    return rows.select(ROW, "id", "label", "v").mapInArrow(run, SHELF)


class Shelf:
    """One shelf, or one chunk of anchors, in arrays."""

    def __init__(self, width: int, kind: str, work: type, row: dict, block: int):
        self.ids, self.rows, self.labels, self.label_low, self.label_high = (
            np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "labels", "label_low", "label_high")
        )
        self.none = np.frombuffer(row["none"], bool)
        self.v = np.frombuffer(row["v"], kind).reshape(-1, width).astype(work)
        self.starts = np.arange(0, len(self.ids), block)
        self.low, self.high = _bounds(row, width, kind, work)


def _bounds(row: dict, width: int, kind: str, work: type) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[c], kind).reshape(-1, width).astype(work) for c in ("low", "high"))


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest scores that each block can give each anchor."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return low @ up.T + high @ down.T, high @ up.T + low @ down.T


class Windows:
    """What a chunk's anchors look for: score windows, several an anchor, among rows of their own or of other labels."""

    def __init__(self, n: int, own: bool, best: int, windows: list[dict] | None):
        self.own, self.best = own, best
        if windows is None:
            self.place, self.w = np.arange(n), np.zeros(n, np.int64)
            self.low, self.high = np.full(n, LEAST), np.full(n, MOST)
        else:
            self.place, self.w, self.low, self.high = (
                np.array([x[c] for x in windows], np.int64) for c in ("place", "w", "low", "high")
            )

    def wanted(self, labels: np.ndarray, shelf_low, shelf_high, least, most) -> np.ndarray:
        """Blocks by windows: whether a block can hold a row of the window."""
        own = labels[self.place]
        if self.own:
            fits = (shelf_low[:, None] <= own) & (own <= shelf_high[:, None])
        else:
            fits = (shelf_low[:, None] != own) | (own != shelf_high[:, None])
        return fits & (most[:, self.place] >= self.low) & (least[:, self.place] <= self.high)


def first_of(windows: np.ndarray, score, none, ids, rows, best: int) -> np.ndarray:
    """Places of the first ``best`` entries of each window: higher scores first, then smaller ids, null ones last."""
    order = np.lexsort((rows, ids, none, -score, windows))
    sorted_ = windows[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(order)])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < best]


def search(shelf: Shelf, chunk: Shelf, looks: Windows) -> tuple[np.ndarray, ...] | None:
    """``(window, score, row in the shelf)`` of the first rows of each window in one shelf."""
    least, most = score_bounds(chunk.v, shelf.low, shelf.high)
    wanted = looks.wanted(chunk.labels, shelf.label_low, shelf.label_high, least, most)
    floor = looks.low.copy()
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    reach = np.where(wanted, most[:, looks.place], -np.inf).max(axis=1, initial=-np.inf) if len(looks.place) else np.zeros(0)
    ends = np.append(shelf.starts[1:], len(shelf.ids))
    for b in np.argsort(-reach, kind="stable"):
        # Only windows whose held rows this block can still beat or equal.
        open_ = np.flatnonzero(wanted[b] & (most[b][looks.place] >= floor))
        if not len(open_):
            continue
        at = slice(shelf.starts[b], ends[b])
        places, column = np.unique(looks.place[open_], return_inverse=True)
        scores = (shelf.v[at] @ chunk.v[places].T).astype(np.int64)
        fits = (shelf.labels[at, None] == chunk.labels[places]) == looks.own
        fits &= shelf.rows[at, None] != chunk.rows[places]
        from_, to = np.full(len(places), MOST), np.full(len(places), LEAST)
        np.minimum.at(from_, column, floor[open_])
        np.maximum.at(to, column, looks.high[open_])
        r, p = np.nonzero(fits & (scores >= from_) & (scores <= to))
        if not len(r):
            continue
        # Each found pair with every open window of its anchor.
        by_place = np.argsort(column, kind="stable")
        sizes = np.bincount(column, minlength=len(places))
        first, each = np.cumsum(sizes) - sizes, sizes[p]
        w = open_[by_place[np.repeat(first[p], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]]
        r, score = np.repeat(r, each) + shelf.starts[b], np.repeat(scores[r, p], each)
        inside = (score >= floor[w]) & (score <= looks.high[w])
        held = tuple(np.append(x, y) for x, y in zip(held, (w[inside], score[inside], r[inside])))
        kept = first_of(held[0], held[1], shelf.none[held[2]], shelf.ids[held[2]], shelf.rows[held[2]], looks.best)
        held = tuple(x[kept] for x in held)
        full = np.flatnonzero(np.bincount(held[0], minlength=len(floor)) == looks.best)
        worst = np.full(len(floor), MOST)
        np.minimum.at(worst, held[0], held[1])
        floor[full] = np.maximum(floor[full], worst[full])
    return held if len(held[0]) else None


class Mine:
    """The staged shelves and chunks, and what their numbers are kept in."""

    def __init__(self, rows: DataFrame):
        size, square = F.size("v"), F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
        largest = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
        stats = rows.agg(
            F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(size).alias("width"),
            F.max(largest).alias("most"), F.try_divide(F.sum(square), F.sum(size)).alias("square"),
        ).first()
        self.spark, self.width, most = rows.sparkSession, max(1, stats["width"] or 0), stats["most"] or 0.0
        top = self.width * most * most
        if top >= 2.0**62:
            raise ValueError(f"components of up to {most} give scores that do not fit into a long")
        self.kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
        self.work = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
        keyed = _keyed(rows, self.width, max(1.0, math.sqrt(stats["square"] or 0.0)))
        cores = self.spark.sparkContext.defaultParallelism
        low, high = SHELF_ROWS
        shelf = min(high, max(low, math.ceil(stats["n"] / (4 * cores))))
        self.shelves = self._laid(keyed, stats["n"], shelf, BLOCK_ROWS, "shelves")
        self.chunks = self._laid(keyed.where("anchor"), stats["anchors"], CHUNK_ROWS, CHUNK_ROWS, "chunks")
        self.n_chunks, self.n_shelves = self.chunks.count(), self.shelves.count()

    def _laid(self, rows: DataFrame, n: int, size: int, block: int, name: str) -> DataFrame:
        order = ["label", "place", "id", ROW]
        ordered = rows.repartitionByRange(max(1, math.ceil(n / size)), *order).sortWithinPartitions(*order)
        return stage(_shelves(ordered, self.width, self.kind, size, block), name)

    def _cut(self):
        return partial(Shelf, self.width, self.kind, self.work)

    def _pairs(self, chunks: DataFrame, own: bool, best: int) -> DataFrame:
        """``(number, shelf)``: shelves that chunks have to read, by the shelves' zones alone."""
        groups = max(1, math.ceil(self.n_shelves / ZONE_SHELVES))
        zone = F.struct("number", "low", "high", "label_low", "label_high")
        zones = self.shelves.groupBy(F.pmod(F.xxhash64("number"), F.lit(groups)).alias("g")).agg(
            F.collect_list(zone).alias("zones")
        )
        spread = chunks.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        joined = spread.join(zones, "g")
        width, kind, work, cut = self.width, self.kind, self.work, self._cut()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chosen = []
                for row in batch.to_pylist():
                    chunk = cut(row, CHUNK_ROWS)
                    looks = Windows(row["n"], own, best, row.get("windows"))
                    for z in row["zones"]:
                        least, most = score_bounds(chunk.v, *_bounds(z, width, kind, work))
                        labels = (np.frombuffer(z[c], np.int64) for c in ("label_low", "label_high"))
                        if looks.wanted(chunk.labels, *labels, least, most).any():
                            chosen.append((row["number"], z["number"]))
                columns = [pa.array([pair[i] for pair in chosen], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "shelf"])

        return joined.mapInArrow(run, "number long, shelf long")

    def nearest(self, own: bool, best: int, windows: DataFrame | None = None) -> DataFrame:
        """``(chunk, place, w, id, row, score, rank)``: the first ``best`` rows of each window.

        ``windows`` has ``number`` and ``windows array<struct<place, w, low, high>>``; without it, every anchor has one
        window that holds all scores.
        """
        chunks = self.chunks if windows is None else self.chunks.join(windows, "number")
        pairs = self._pairs(chunks, own, best)
        # A shelf and the chunks it meets go to one task in slices, the shelf first.
        slices = max(1, math.ceil(self.n_chunks / SLICE_CHUNKS))
        slice_ = F.pmod(F.xxhash64("number"), F.lit(slices))
        none = F.lit(None).cast("array<struct<place:int,w:int,low:bigint,high:bigint>>")
        with_windows = chunks if windows is not None else chunks.withColumn("windows", none)
        asked = with_windows.join(pairs, "number").withColumns({"slice": slice_, "is_chunk": F.lit(1)})
        laid = self.shelves.withColumns(
            {
                "windows": none,
                "shelf": F.col("number"),
                "slice": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))),
                "is_chunk": F.lit(0),
            }
        )
        met = asked.unionByName(laid).repartition("shelf", "slice").sortWithinPartitions("shelf", "slice", "is_chunk", "number")
        cut = self._cut()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shelf = None
            names = [n.split()[0] for n in HIT.split(", ")]
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if not row["is_chunk"]:
                        shelf = cut(row, BLOCK_ROWS)
                        continue
                    looks = Windows(row["n"], own, best, row["windows"])
                    found = search(shelf, cut(row, CHUNK_ROWS), looks)
                    if found is None:
                        continue
                    w, score, r = found
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(w), row["number"])),
                            pa.array(looks.place[w].astype(np.int32)),
                            pa.array(looks.w[w].astype(np.int32)),
                            pa.array(shelf.ids[r], mask=shelf.none[r]),
                            pa.array(shelf.rows[r]),
                            pa.array(score),
                        ],
                        names=names,
                    )

        order = Window.partitionBy("chunk", "place", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return met.mapInArrow(run, HIT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)

    def anchor_ids(self) -> DataFrame:
        """``(chunk, place, anchor_id)``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids, none = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["none"], bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), row["number"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids, mask=none)],
                        names=["chunk", "place", "anchor_id"],
                    )

        return self.chunks.select("number", "ids", "none").mapInArrow(run, "chunk long, place int, anchor_id long")


def mine_negatives(
    df: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    label: Column | None = None,
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """Per anchor and positive its hard negatives.

    ``anchor`` marks the anchors.  An anchor's positives are the ``positives`` other rows of its label with the highest
    scores; the negatives of a positive are the first ``negatives`` rows of other labels whose score is between ``low``
    and ``high`` percent of the positive's.
    """
    mine = Mine(vectors(df, key, F.col("label") if label is None else label, vector, scale, anchor))
    found = stage(mine.nearest(True, positives), "positives")
    score = F.col("score").cast("decimal(20,0)")
    # 100 * s lies in a window of whole numbers of percent times the positive's score.
    span = F.struct(
        "place",
        F.col("rank").cast("int").alias("w"),
        F.ceil(score * low / 100).cast("long").alias("low"),
        F.floor(score * high / 100).cast("long").alias("high"),
    )
    windows = found.select(F.col("chunk").alias("number"), span.alias("s")).where("s.low <= s.high")
    # At most ``positives`` windows for each anchor of a chunk.
    windows = windows.groupBy("number").agg(F.collect_list("s").alias("windows"))
    hard = mine.nearest(False, negatives, windows)
    known = found.join(mine.anchor_ids(), ["chunk", "place"]).select(
        "chunk", "place", F.col("rank").cast("int").alias("w"), "anchor_id",
        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return hard.join(known, ["chunk", "place", "w"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
