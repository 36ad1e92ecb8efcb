"""Corpus recipes: from files on disk to tokenized rows with one common shape.

Every recipe gives ``(split, part, pos, doc_key, block, line, ids, n)``; the
columns :data:`ORDER` order the token stream of a split.  In a corpus of shuffled
documents ``pos`` is a hash key and leads the order, see :func:`stream_order`.  Recipes differ in how documents
are found, split, ordered and closed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenweave.functions.bpe import BytePairCoder, is_rejected
from tokenweave.functions.chars import char_encode
from tokenweave.functions.ids import append_eot, token_len
from tokenweave.functions.markup import convert_markup
from tokenweave.operators.mix import YEAR_PRESETS, check_years, concat_years, mix_corpora, select_years
from tokenweave.operators.segments import MAX_CHARS, cut_long_texts, safe_segments
from tokenweave.operators.splits import SPLIT_SEED, VAL_FRACTION, file_split, modulo_split, offset_split, random_split
from tokenweave.session import stage
from tokenweave.sinks.materialize import materialize_years
from tokenweave.sources.documents import (
    decoded_members,
    expand_archives,
    member_lines,
    read_document_files,
    read_documents,
    read_text_split,
    reject_null_text,
)

ORDER = ("part", "pos", "doc_key", "block", "line")
HASHED_ORDER = ("pos", "doc_key", "block", "line")

# Which file of the wiki corpus is which split.
WIKI_FILES = {"wiki.train.raw": "train", "wiki.valid.raw": "val"}


def _tokenized(df: DataFrame, ids: Column, **order: Column) -> DataFrame:
    """The common shape; the text is dropped as soon as it is encoded."""
    def place(name: str, type_: str = "long") -> Column:
        return order.get(name, F.lit(0)).cast(type_).alias(name)

    return (
        df.withColumn("ids", ids)
        .select(
            "split",
            place("part", "int"),
            place("pos"),
            F.col("doc_key").cast("string").alias("doc_key"),
            place("block"),
            place("line"),
            "ids",
        )
        .withColumn("n", token_len("ids"))
    )


def web_corpus(
    spark: SparkSession,
    path: str,
    coder: BytePairCoder,
    fraction: float = VAL_FRACTION,
    seed: int = SPLIT_SEED,
    format: str = "parquet",
    key: str | None = "doc_key",
    source: str | None = "source",
    schema: T.StructType | str | None = None,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """Rows with a text: seeded random split, shuffled order, end-of-text after each.

    A document beyond ``max_chars`` is several rows with the same ids in all.
    """
    docs, _ = reject_null_text(read_documents(spark, path, format, key, source=source, schema=schema))
    parts = random_split(docs, "doc_key", fraction, seed)
    pieces = cut_long_texts(parts, max_chars).withColumn("ids", coder.encode("text"))
    ids = F.when(F.col("last"), append_eot("ids", coder.eot)).otherwise(F.col("ids"))
    return _tokenized(pieces, ids, pos=F.col("order_key"), block=F.col("piece"))


def web_rejects(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """``(doc_key, reason)`` of the rows that :func:`web_corpus` leaves out."""
    _, out = reject_null_text(read_documents(spark, path, format, **options))
    return out.select(F.col("doc_key").cast("string").alias("doc_key"), F.lit("no text").alias("reason"))


def wiki_corpus(spark: SparkSession, path: str, coder: BytePairCoder) -> DataFrame:
    """Pre-split text files (a folder, or a zip of them), encoded as whole files."""
    if path.endswith(".zip"):
        # Unpacked once: the segments read their lines several times.
        lines = stage(member_lines(expand_archives(spark, path)), "lines")
    else:
        lines = read_text_split(spark, path)
    segments = safe_segments(lines, order=("block", "line_no"))
    parts = file_split(segments, F.col("file"), WIKI_FILES).withColumn("doc_key", F.col("file"))
    return _tokenized(parts, coder.encode("text"), line=F.col("segment"))


def converted_documents(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """``(year, doc_key, text, reason)`` from one archive of LaTeX sources a year, or from text files.

    Only the archives or folders of ``years`` are opened, when given.  ``reason`` says why
    a document has no text, and is null for the others.

    ``path`` is a glob of ``*.tar.gz`` / ``*.zip`` archives with the year in their
    names, or a folder with one folder of text files a year.
    """
    if not path.endswith((".tar.gz", ".tgz", ".zip")):
        files = read_document_files(spark, path, years)
        return files.withColumn("reason", F.when(F.col("year").isNull(), "no year"))

    def year(column: str) -> Column:
        return F.regexp_extract(column, r"(\d{4})[^/]*$", 1).try_cast("int")

    wanted = None if years is None else year("path").isin([int(y) for y in years])
    sources = decoded_members(expand_archives(spark, path, wanted=wanted), year("archive"))
    converted = convert_markup(sources, "markup", "latex")
    return converted.select("year", "doc_key", F.when(F.col("ok"), F.col("text")).alias("text"), "reason")


def year_documents(
    spark: SparkSession, path: str, years: Sequence[int] | None = None, cache: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(year, doc_key, text)`` of the documents that have a text, and the rejects with their reason.

    Unpacked and converted once, as the index of a document takes several reads of the keys: in
    ``cache``, where given, each year once for good.
    """
    if cache and years is not None:
        made = materialize_years(spark, cache, years, lambda todo: converted_documents(spark, path, todo))
    else:
        made = stage(converted_documents(spark, path, years), "converted", ("year",))
    good = made.where(F.col("reason").isNull()).select("year", "doc_key", "text")
    return good, made.where(F.col("reason").isNotNull()).select("year", "doc_key", "reason")


def year_rejects(
    spark: SparkSession, path: str, years: Sequence[int] | None = None, cache: str | None = None
) -> DataFrame:
    """``(year, doc_key, reason)`` of the documents that :func:`year_corpus` leaves out."""
    years = YEAR_PRESETS["all"] if years is None else list(years)
    good, out = year_documents(spark, path, years, cache)
    held = good.where(is_rejected("text")).select("year", "doc_key", F.lit("end-of-text literal").alias("reason"))
    return out.unionByName(held)


def year_corpus(
    spark: SparkSession,
    path: str,
    coder: BytePairCoder,
    years: Sequence[int] | None = None,
    cache: str | None = None,
) -> DataFrame:
    """Documents by year: every ten split seven, two, one; years in the order asked for."""
    years = YEAR_PRESETS["all"] if years is None else list(years)
    check_years(years)
    docs = select_years(year_documents(spark, path, years, cache)[0], years)
    parts = modulo_split(docs, "year", ("doc_key",)).where(~is_rejected("text"))
    placed = concat_years(parts, years)
    return _tokenized(placed, coder.encode("text", special="error"), part=F.col("part"), pos=F.col("i"))


def char_corpus(spark: SparkSession, path: str, coder: BytePairCoder | None = None) -> DataFrame:
    """One text, cut at four fifths of its characters, as character ids."""
    lines = read_text_split(spark, path)
    parts = offset_split(lines, ("file", "block", "line_no")).withColumn("doc_key", F.col("file"))
    return _tokenized(parts, char_encode("text"), block=F.col("block"), line=F.col("line_no"))


def year_and_wiki(spark: SparkSession, paths: Sequence[str], coder: BytePairCoder) -> DataFrame:
    """The yearly documents, then the wiki text, per split."""
    yearly, wiki = paths
    mixed = mix_corpora([year_corpus(spark, yearly, coder), wiki_corpus(spark, wiki, coder)])
    # The years' parts come first; every part of the second corpus follows them.
    part = F.col("part") + F.col("corpus") * len(YEAR_PRESETS["all"])
    return mixed.withColumn("part", part).drop("corpus")


# The names of the corpora.
CORPORA: dict[str, Callable[..., DataFrame]] = {
    "slimpajama": web_corpus,
    "openwebtext2": web_corpus,
    "wikitext": wiki_corpus,
    "shakespeare-char": char_corpus,
    "arxiv": year_corpus,
    "arxiv2000": lambda spark, path, coder: year_corpus(spark, path, coder, YEAR_PRESETS["2000"]),
    "arxiv+wiki": year_and_wiki,
}


def corpus(name: str) -> Callable[..., DataFrame]:
    """The recipe of that name, called with ``(spark, path, coder)``."""
    if name not in CORPORA:
        raise ValueError(f"unknown corpus {name!r}, known are {sorted(CORPORA)}")
    return CORPORA[name]


#: Corpora whose documents are in the order of a hash key.
SHUFFLED = frozenset({"slimpajama", "openwebtext2"})


def stream_order(name: str) -> dict:
    """How the stream of that corpus is ordered, as arguments of ``ordered_sums``.

    A hash order has as many even buckets as wanted without looking at the keys.
    """
    corpus(name)
    return {"order": HASHED_ORDER, "hashed": True} if name in SHUFFLED else {"order": ORDER, "hashed": False}
