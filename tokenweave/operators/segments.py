"""Cutting a long text where byte-pair token borders are guaranteed.

A whole file is one string to the tokenizer, and white space joins across line
ends, so cutting at line ends would change ids.  A cut between a non-space and the
white space after it never does.  Each segment is therefore the white space since
the last non-blank line, followed by one line up to its last non-space.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.operators.order import ordered_sums

# Fixed value: the characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
)
TRAILING_SPACE = f"(?s)^(.*[^{WHITE_SPACE}])?([{WHITE_SPACE}]*)$"

#: Characters of a document that are encoded as one row.
MAX_CHARS = 1 << 24


def safe_segments(
    lines: DataFrame,
    file: str = "file",
    order: Sequence[str] = ("line_no",),
    text: str = "text",
) -> DataFrame:
    """Lines with their terminators to rows ``(file, segment, text)``.

    The texts of a file's segments, concatenated, are the file, and so are their
    ids.  Segment numbers count the non-blank lines before; a final segment of
    white space only exists where a file ends in white space.
    """
    body = F.regexp_extract(F.col(text), TRAILING_SPACE, 1)
    space = F.regexp_extract(F.col(text), TRAILING_SPACE, 2)
    cut = lines.select(file, *order, body.alias("body"), space.alias("space"))
    cut = cut.withColumn("filled", (F.col("body") != "").cast("long"))
    placed = ordered_sums(cut, {"segment": "filled"}, order, (file,))
    # Bodies go to their own segment, trailing white space and blank lines to the next.
    pieces = F.array(
        F.struct(F.col("segment").alias("segment"), F.col("body").alias("piece")),
        F.struct((F.col("segment") + F.col("filled")).alias("segment"), F.col("space").alias("piece")),
    )
    parts = placed.select(
        file,
        "bucket",
        F.struct(*order).alias("at"),
        F.col("segment_lo").alias("lo"),
        F.col("segment_hi").alias("hi"),
        F.inline(F.filter(pieces, lambda p: p["piece"] != "")),
    )
    # A segment between the first and last of its bucket lies in that bucket as a
    # whole and is joined where it is; only the border segments are shuffled again.
    whole = (F.col("segment") > F.col("lo")) & (F.col("segment") < F.col("hi"))
    inner = _joined(parts.where(whole), [file, "bucket", "segment"]).drop("bucket")
    return inner.unionByName(_joined(parts.where(~whole), [file, "segment"]))


def cut_long_texts(df: DataFrame, max_chars: int = MAX_CHARS, text: str = "text") -> DataFrame:
    """Rows ``(..., text, piece, last)``: texts beyond ``max_chars`` in several pieces.

    For documents too long for one row of ids.  A piece ends at the last safe cut
    within ``max_chars``, or at the next one where a word or a run of white space
    is longer, so the ids of the pieces are those of the text.  Only the ``last``
    piece is to be closed with the end-of-text id.
    """
    cut = f"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}])"
    within, beyond = f".{{1,{max_chars}}}(?:{cut}|\\z)", f".+?(?:{cut}|\\z)"
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s){within}|{beyond}"), F.lit(0))
    parts = F.when(F.length(text) > max_chars, pieces).otherwise(F.array(text))
    rest = [c for c in df.columns if c != text]
    return (
        df.withColumn("pieces", parts)
        .select(*rest, F.size("pieces").alias("of"), F.posexplode("pieces").alias("piece", text))
        .withColumn("last", F.col("piece") == F.col("of") - 1)
        .drop("of")
    )


def _joined(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("text"))
