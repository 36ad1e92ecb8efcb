"""Benchmark decontamination: a broadcast hash set of test n-grams over all token windows.

Every window of ``width`` normalised words of every text is hashed and looked up in the
set of the benchmark's windows; a hit is verified word by word.  Only hits and one
row per document are shuffled.

Edge cases: a null text or item has no words and no windows; an item with fewer words
than ``width`` is one window of all its words; empty tables give empty results or
clean documents; repeated rows and repeated or null ids are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.llm.text import (
    ROW,
    SEPARATORS,
    covered,
    lower_ascii,
    split_words,
    text_of,
    with_row_key,
    with_window_hashes,
)

WIDTH = 10

#: Distinct windows up to which their set is broadcast (about 200 bytes each).  A larger
#: set is joined by a shuffle of the window hashes, with the same result.
BROADCAST_WINDOWS = 1_000_000


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows ``(hash, gram, n, items)`` of a benchmark with ``item_id`` and ``text``."""
    words = items.select(
        F.col("item_id").cast("string").alias("item"), split_words(lower_ascii(text_of()), SEPARATORS).alias("w")
    ).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    grams = words.select(
        "item",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
        ).alias("gram"),
    )
    return grams.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn(
        "n", F.size("gram")
    )


def find_hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: ``n_words``, merged ``hits`` (word intervals) and ``items``.

    ``keep`` names columns to carry along.
    """
    windows = benchmark_windows(items, width)
    # At most `width` values; short items are windows of their own length.
    lengths = sorted(r.n for r in windows.select("n").distinct().collect()) or [width]
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    hashed = [
        with_window_hashes(windows.where(F.col("n") == n), "gram", [n], "h").select(
            F.get(F.col(f"h{n}"), F.lit(0)).alias("hash"), "gram", F.col("n").alias("long"), "items"
        )
        for n in lengths
    ]
    grams = hashed[0]
    for more in hashed[1:]:
        grams = grams.unionByName(more)
    words = with_row_key(docs.select(F.struct(*keep).alias("kept"), text_of().alias("text")) if keep
                         else docs.select(text_of().alias("text"))).withColumn(
        "words", split_words(lower_ascii(F.col("text")), SEPARATORS)
    ).drop("text")
    marked = with_window_hashes(words, "words", lengths, "h")
    # One more entry per document, without a hash, brings documents without hits through.
    rest = [c for c in marked.columns if c in (ROW, "kept", "words")]
    mark = F.array(F.lit(None).cast("long"))
    if len(lengths) == 1:
        rows = marked.select(*rest, F.posexplode(F.concat(f"h{lengths[0]}", mark)), F.lit(lengths[0]).alias("width"))
    else:
        parts = [_placed(f"h{n}", n) for n in lengths] + [F.transform(mark, lambda x: _entry(x, F.lit(0), 0))]
        rows = marked.select(*rest, F.inline(F.concat(*parts)))
    set_ = F.broadcast(grams) if few else grams
    looked = rows.join(set_, (rows.col == set_.hash) & (rows.width == set_["long"]), "left").where(
        F.col("gram").isNotNull() | F.col("col").isNull()
    )
    hit = F.slice("words", F.col("pos") + 1, F.col("width")) == F.col("gram")
    span = F.struct(F.col("pos").cast("long").alias("start"), (F.col("pos") + F.col("width")).cast("long").alias("end"))
    marks = looked.select(
        ROW,
        F.when(F.col("col").isNull(), F.size("words").cast("long")).alias("n_words"),
        *([F.when(F.col("col").isNull(), F.col("kept")).alias("kept")] if keep else []),
        F.when(hit, span).alias("span"),
        F.when(hit, F.col("items")).alias("items"),
    )
    found = marks.groupBy(ROW).agg(
        F.max("n_words").alias("n_words"),
        *([F.first("kept", ignorenulls=True).alias("kept")] if keep else []),
        F.array_sort(F.collect_set("span")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return found.select(*(["kept.*"] if keep else []), "n_words", "hits", "items")


def _entry(value, place, width: int):
    return F.struct(place.cast("int").alias("pos"), value.alias("col"), F.lit(width).alias("width"))


def _placed(hashes: str, width: int):
    """Window hashes with their places and their length."""
    return F.transform(hashes, lambda x, i: _entry(x, i, width))


def remove_hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, drop_share: float = 0.5) -> DataFrame:
    """``docs`` without benchmark text: hit words are cut out, and a document of which at
    least ``drop_share`` of the words are hit goes.  Other documents stay as they are."""
    columns = docs.columns
    safe = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("all__"), F.col("text"))
    found = find_hits(safe, items, width, keep=("all__", "text"))
    n_hit = covered(F.col("hits"))
    left = found.where((n_hit == 0) | (n_hit < drop_share * F.col("n_words")))
    # Words and what stands between them, from the text as it is.
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    some = F.size("hits") > 0
    parts = left.withColumns(
        {
            "w": F.when(some, F.regexp_extract_all("text", F.lit(word), F.lit(0))),
            "s": F.when(some, F.split("text", word, -1)),
        }
    )

    def is_hit(i):
        return F.exists("hits", lambda x: (x["start"] <= i) & (i < x["end"]))

    pieces = F.transform(
        F.sequence(F.lit(0), F.size("w") - 1),
        lambda i: F.when(is_hit(i), F.when(is_hit(i - 1), F.lit("")).otherwise(F.get("s", i))).otherwise(
            F.concat(F.get("s", i), F.get("w", i))
        ),
    )
    text = F.when(some, F.concat(F.array_join(pieces, ""), F.element_at("s", -1))).otherwise(F.col("text"))
    made = parts.select("all__", text.alias("new__"))
    return made.select(*[_column(c) for c in columns])


def _column(name: str):
    if name == "text":
        return F.col("new__").alias("text")
    if name == "n_chars":
        return F.length("new__").cast("long").alias("n_chars")
    return F.col(f"all__.`{name}`").alias(name)
