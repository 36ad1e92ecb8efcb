"""Cross-tokenizer alignment: how the tokens of a byte-level and of a piece vocabulary cover the same bytes.

Copies are told apart by their full text: one shuffle by text leaves each distinct text once, with its number of
copies, and only these are encoded and aligned.  Texts are aligned in blocks of a few megabytes; a block keeps its
distinct id pairs and, for each text, how often it holds which of them.  Pair counts are weighted by the copies and
summed over the blocks, brought back to the blocks that hold the pair, and the measures of a text join the
documents by its digest.

A text stands behind one space.  Where tokens of both vocabularies end at the same byte a group ends; tokens whose
byte ranges overlap are linked.  Edge cases: null and empty texts, and texts that either vocabulary does not give back
byte by byte, have no tokens: zeros and an empty digest; repeated rows count as often as they are there; repeated
and null keys are rows of their own; an empty table gives an empty result; other columns of ``docs`` are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.llm.packing import Grown, Known, PieceCoder
from tokenweave.session import stage

#: Bytes of text that are aligned together; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Segments that a worker remembers, and their ids; a memory that either fills is emptied.
REMEMBERED = 500_000
REMEMBERED_IDS = 8_000_000
#: A vocabulary file beyond this is refused instead of broadcast.
MAX_FILE_BYTES = 64 << 20

MARK = "▁"
BEHIND = re.compile(r"(?<=[^ ])(?= )")
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
TEXTS = (
    "array<struct<key:string,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,"
    "groups_sha256:string,groups:string,held:int>>"
)


def byte_table(file: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; its characters stand for bytes by the usual rule."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(c): b for c, b in [*zip(plain, plain), *((256 + i, b) for i, b in enumerate(rest))]}
    entries = Tokenizer.from_str(file).get_vocab()
    table = [b""] * (max(entries.values()) + 1)
    for token, i in entries.items():
        known = all(c in byte for c in token)
        table[i] = bytes(byte[c] for c in token) if known else token.encode()
    return table


class SegmentCoder:
    """Ids of a piece vocabulary, made of remembered ids of the segments that start at spaces.

    No piece holds a space behind another character, so no merge crosses the start of a run of spaces.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.table = [
            bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.flat, self.starts, self.sizes = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def segments(self, text: str) -> list[str]:
        """Segments without the space that each of them starts with."""
        if self.whole:
            return [text]
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        parts = BEHIND.split(" " + text)
        if len(parts) > 1 and not parts[-1].strip(" "):
            parts[-2:] = ["".join(parts[-2:])]
        return [p[1:] for p in parts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED or self.flat.size > REMEMBERED_IDS:
            self.clear()
        number = self.known.__getitem__
        numbers = []
        for text in texts:
            parts = self.segments(text)
            numbers.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        new, self.known.new = self.known.new, []
        found = self.coder.encode(new, num_threads=1) if new else []
        sizes = np.array([len(x) for x in found], np.int64)
        self.starts.add(self.flat.size + np.cumsum(sizes) - sizes)
        self.sizes.add(sizes)
        self.flat.add(np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())))
        out = []
        for at in numbers:
            starts, sizes = self.starts.room[at], self.sizes.room[at]
            before = np.cumsum(sizes) - sizes
            out.append(self.flat.room[np.repeat(starts - before, sizes) + np.arange(sizes.sum())])
        return out


class Aligner:
    """Both vocabularies, and the separators that their ids are written with."""

    def __init__(self, byte_file: str, model: bytes):
        self.a, self.b = PieceCoder(byte_file), SegmentCoder(model)
        self.a_bytes, self.b_bytes = byte_table(byte_file), self.b.table
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        ends = [(len(self.a_bytes), b","), (len(self.a_bytes), b"|"), (len(self.b_bytes), b","), (len(self.b_bytes), b";")]
        self.written = [b"%d%s" % (i, end) for n, end in ends for i in range(n)]

    def texts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both vocabularies; none where either does not give the bytes back."""
        none = np.zeros(0, np.uint32)
        pairs = []
        for text, a, b in zip(texts, self.a.encode([" " + t for t in texts]), self.b.encode(texts)):
            raw = b" " + text.encode("utf-8", "surrogatepass")
            same = text and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw
            same = same and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
            pairs.append((a, b) if same else (none, none))
        return pairs

    def align(self, texts: list[str], keep_groups: bool):
        """``(n_a, n_b, n_groups, n_links, digests, groups, link pairs)`` of texts, one after the other."""
        ids = self.texts(texts)
        n_a, n_b = (np.array([len(x[i]) for x in ids], np.int64) for i in (0, 1))
        a, b = (np.concatenate([np.zeros(0, np.uint32), *[x[i] for x in ids]]).astype(np.int64) for i in (0, 1))
        # Ends of both sides in one order; where they are equal, the first side's comes first.
        both = np.concatenate([np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])])
        order = np.argsort(both, kind="stable")
        both, of_a = both[order], order < len(a)
        new = np.append(True, both[1:] != both[:-1])[: len(both)]
        first = np.flatnonzero(new)
        a_at = (np.cumsum(of_a) - of_a)[first]
        b_at = first - a_at
        closed = np.diff(np.append(first, len(both))) == 2
        group = np.cumsum(closed) - closed
        rank = np.cumsum(new) - 1
        a_group, b_group = group[rank[of_a]], group[rank[~of_a]]
        cut = np.append(0, rank[of_a] + 1)[np.cumsum(n_a)]
        n_links = np.diff(np.append(0, cut))
        n_groups = np.diff(np.append(0, np.append(0, np.cumsum(closed))[cut]))
        digests, groups = self._written(a, b, n_a + n_b, a_group, b_group, keep_groups)
        return n_a, n_b, n_groups, n_links, digests, groups, a[a_at] << 32 | b[b_at]

    def _written(self, a, b, sizes, a_group, b_group, keep_groups):
        """Each group's ids of both sides, in order, as text; the ids of one side precede the other's."""
        a_last = np.append(a_group[1:] != a_group[:-1], True)[: len(a)]
        b_last = np.append(b_group[1:] != b_group[:-1], True)[: len(b)]
        groups = a_group[-1] + 1 if len(a) else 0
        a_upto, b_upto = (np.cumsum(np.bincount(x, minlength=groups)) for x in (a_group, b_group))
        order = np.empty(len(a) + len(b), np.int64)
        wide = len(self.a_bytes)
        order[np.arange(len(a)) + np.append(0, b_upto)[a_group]] = a + a_last * wide
        order[np.arange(len(b)) + a_upto[b_group]] = 2 * wide + b + b_last * len(self.b_bytes)
        digests, lines, at = [], [], 0
        for n in sizes.tolist():
            line = b"".join(map(self.written.__getitem__, order[at : at + n].tolist()))[:-1]
            digests.append(hashlib.sha256(line).hexdigest() if n else "")
            lines.append(line.decode() if keep_groups else None)
            at += n
        return digests, lines


def _planes(values: np.ndarray) -> bytes:
    """Four-byte numbers by byte planes: small ones leave planes of zeros, which any codec removes."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _block(aligner: Aligner, keys: list[str], texts: list[str], copies: np.ndarray, keep_groups: bool) -> dict:
    n_a, n_b, n_groups, n_links, digests, groups, links = aligner.align(texts, keep_groups)
    pairs, place = np.unique(links, return_inverse=True)
    text = np.repeat(np.arange(len(texts)), n_links)
    held, times = np.unique(text * max(1, len(pairs)) + place, return_counts=True)
    text, place = np.divmod(held, max(1, len(pairs)))
    each = np.bincount(text, minlength=len(texts))
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, place, times * copies[text])
    first = np.append(True, text[1:] != text[:-1])[: len(text)]
    steps = np.where(first, place, np.diff(np.append(0, place)))
    rows = zip(keys, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), digests, groups, each.tolist())
    names = ("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "held")
    return {
        "block": keys[0],
        "texts": [dict(zip(names, r)) for r in rows],
        "pairs": pairs.tolist(),
        "counts": counts.tolist(),
        "steps": _planes(steps),
        "times": _planes(times),
    }


def _file(path: str) -> bytes:
    """A vocabulary file, which the driver reads as the other operators' files."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def aligned_blocks(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text", keep_groups: bool = False) -> DataFrame:
    """Every distinct text aligned once, in blocks ``(block, texts, pairs, counts, steps, times)``.

    ``texts`` has a text's digest ``key`` and measures; ``pairs`` the block's distinct pairs ``a << 32 | b`` and
    ``counts`` their links, copies included.  With ``keep_groups`` the groups are kept as text beside their digest.
    """
    share = docs.sparkSession.sparkContext.broadcast
    first, second = share(_file(byte_file)), share(_file(piece_file))
    distinct = (
        docs.select(F.col(text).cast("string").alias("text"))
        .where(F.col("text") != "")
        .groupBy("text")
        .agg(F.count("*").alias("copies"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first.value.decode(), second.value)
        schema = pa.schema(
            [
                ("block", pa.string()),
                ("texts", pa.list_(pa.struct(
                    [("key", pa.string()), *[(n, pa.int64()) for n in MEASURES[:4]], ("groups_sha256", pa.string()),
                     ("groups", pa.string()), ("held", pa.int32())]))),
                ("pairs", pa.list_(pa.int64())),
                ("counts", pa.list_(pa.int64())),
                ("steps", pa.binary()),
                ("times", pa.binary()),
            ]
        )
        texts, copies, size = [], [], 0

        def made() -> pa.RecordBatch:
            keys = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            return pa.RecordBatch.from_pylist([_block(aligner, keys, texts, np.array(copies), keep_groups)], schema)

        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.append(t)
                copies.append(c)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield made()
                    texts, copies, size = [], [], 0
        if texts:
            yield made()

    kinds = f"block string, texts {TEXTS}, pairs array<bigint>, counts array<bigint>, steps binary, times binary"
    return stage(distinct.mapInArrow(run, kinds), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, count, best)``: the links of each id pair over all documents; best has the most of its second id."""
    each = blocks.select(F.inline(F.arrays_zip("pairs", "counts")))
    totals = stage(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("count")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    # No more rows than the second vocabulary has ids.
    most = totals.groupBy(second.alias("b")).agg(F.max("count").alias("most"))
    return (
        totals.withColumn("b", second)
        .join(F.broadcast(most), "b")
        .select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    )


def text_measures(blocks: DataFrame) -> DataFrame:
    """Per distinct text its digest ``key``, the measures and ``groups_sha256``."""
    marked = F.when(F.col("best"), F.col("count")).otherwise(-F.col("count")).alias("value")
    places = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    known = places.join(pair_counts(blocks), "pair").select("block", F.struct("place", marked).alias("known"))
    # A block's distinct pairs: bounded by its size.
    known = known.groupBy("block").agg(F.collect_list("known").alias("known"))
    joined = blocks.drop("pairs", "counts").join(known, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {n: batch.column(names.index(n)).slice(i, 1) for n in names}
                texts = pa.RecordBatch.from_struct_array(row["texts"].flatten())
                known = row["known"].flatten()
                place, value = known.field("place").to_numpy(), known.field("value").to_numpy()
                values = np.zeros(len(place), np.int64)
                values[place] = value
                held = texts.column("held").to_numpy()
                text = np.repeat(np.arange(len(held)), held)
                steps, times = (_from_planes(row[n][0].as_py()) for n in ("steps", "times"))
                sums = np.cumsum(steps)
                begin = np.append(0, np.cumsum(held))[:-1]
                before = np.where(held > 0, np.append(0, sums)[begin], 0)
                value = values[sums - np.repeat(before, held)]
                best, total = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
                np.add.at(best, text, times * (value > 0))
                np.add.at(total, text, times * np.abs(value))
                columns = [texts.column(n) for n in ("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(best), pa.array(total)],
                    names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum"],
                )

    kinds = "key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    return joined.mapInArrow(run, kinds)


def alignment_measures(
    docs: DataFrame, byte_file: str, piece_file: str, key: str = "doc_id", text: str = "text", keep_groups: bool = False
) -> DataFrame:
    """Per row of ``docs`` its ``key``, the measures of its text and ``groups_sha256``."""
    measures = stage(text_measures(aligned_blocks(docs, byte_file, piece_file, text, keep_groups)), "alignment")
    digest = F.sha2(F.col(text).cast("string").cast("binary"), 256)
    light = docs.select(F.col(key).alias("own__"), digest.alias("key"))
    joined = light.join(measures, "key", "left")
    kept = ["groups"] if keep_groups else []
    return joined.select(
        F.col("own__").alias(key),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
        *kept,
    )
