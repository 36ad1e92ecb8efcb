"""Column helpers shared by the text operators: words, window hashes, spans, row keys."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.session import stage

#: White space and the separators between normalised words.
SPACES = r"[\x20\x09-\x0D]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Running sums over an array are made in blocks of this many entries, so that a
#: document with very many matches costs little more than one with few.
BLOCK = 256

ROW = "row__"
SPAN = "struct<start:bigint,end:bigint,text:string>"


def text_of(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and everything else as it is.

    ``lower`` does that to a text without other letters; only the rest needs the slower ``translate``.
    """
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def with_fixed_rows(df: DataFrame) -> DataFrame:
    """Adds a row key that stays the same in every later read of ``df``.

    A scan with only projections and filters above it gives each row the same place each time;
    anything else is written out first.  A frame that has the key already stays as it is.
    """
    if ROW in df.columns:
        return df
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = set(re.findall(r"^[\s:+-]*(\w+)", plan, re.MULTILINE))
    keyed = with_row_key(df)
    return keyed if nodes <= {"Project", "Filter", "Relation"} else stage(keyed, "rows")


OTHERS = "others__"


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all but the ``used`` columns in one struct, so that no name of theirs meets one of the operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    kept = [F.col(f"`{c}`") for c in docs.columns if c in used]
    return docs.select(*kept, F.struct(*rest).alias(OTHERS)) if rest else docs


def unpacked(df: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """The columns of the frame that was :func:`packed`, as they were."""
    return df.select(*[F.col(f"`{c}`") if c in used else F.col(f"{OTHERS}.`{c}`").alias(c) for c in columns])


def split_words(text: Column, between: str) -> Column:
    """Words of a text, where ``between`` matches what separates them."""
    return F.array_remove(F.split(text, between), "")


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds a key per row, so that repeated or missing ids stay rows of their own.

    It follows from the input split and the place in it: a redone task gives the same keys.
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def with_window_hashes(df: DataFrame, words: str, lengths: list[int], out: str) -> DataFrame:
    """Adds ``out<L>`` for each length L: the hashes of all windows of L consecutive words.

    Hashes of 2, 4, 8 ... words are combined pairwise, so a window of ten words costs
    four combinations a word and no copy of its words.
    """
    steps = sorted({1 << i for n in lengths for i in range(n.bit_length())})
    df = df.withColumn(f"{out}_1", F.transform(words, lambda w: F.xxhash64(w)))
    for half in steps[: len([s for s in steps if 2 * s <= max(lengths)])]:
        df = df.withColumn(f"{out}_{2 * half}", _combined(f"{out}_{half}", f"{out}_{half}", half))
    made = []
    for n in lengths:
        parts = [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]
        name, done = f"{out}_{parts[0]}", parts[0]
        for k, part in enumerate(parts[1:]):
            df = df.withColumn(f"{out}_{n}_{k}", _combined(name, f"{out}_{part}", done))
            name, done = f"{out}_{n}_{k}", done + part
        made.append(F.slice(name, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))).alias(f"{out}{n}"))
    kept = [c for c in df.columns if not c.startswith(f"{out}_")]
    return df.select(*kept, *made)


def _combined(left: str, right: str, shift: int) -> Column:
    return F.zip_with(left, F.slice(right, shift + 1, F.size(right)), lambda a, b: F.xxhash64(a, b))


def with_matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: all leftmost non-overlapping matches as ``(start, end, text)``.

    Places are code points, the end exclusive.  A text is split by the pattern and
    the lengths of the parts and of the matches are summed up.
    """
    size = F.size(f"{out}_m")
    df = df.withColumns(
        {
            f"{out}_m": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            f"{out}_g": F.split(text, pattern, -1),
        }
    )
    df = df.withColumn(
        f"{out}_z",
        F.zip_with(
            F.slice(f"{out}_g", 1, size),
            f"{out}_m",
            lambda g, m: F.struct(
                F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), m.alias("text")
            ),
        ),
    )
    df = df.withColumn(
        f"{out}_b",
        F.when(
            size > 0,
            F.transform(
                F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")),
                lambda b: F.slice(f"{out}_z", b * BLOCK + 1, F.lit(BLOCK)),
            ),
        ),
    )
    df = df.withColumn(
        f"{out}_s",
        F.aggregate(
            f"{out}_b",
            F.array(F.lit(0).cast("long")),
            lambda acc, block: F.concat(
                acc,
                F.array(
                    F.element_at(acc, -1)
                    + F.aggregate(block, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["len"])
                ),
            ),
        ),
    )
    df = df.withColumn(
        out,
        F.coalesce(
            F.flatten(
                F.zip_with(
                    f"{out}_b", F.slice(f"{out}_s", 1, F.size(f"{out}_b")), lambda block, base: _placed(block, base)
                )
            ),
            F.array().cast(f"array<{SPAN}>"),
        ),
    )
    return df.drop(*[f"{out}_{x}" for x in "mgzbs"])


def _placed(block: Column, base: Column) -> Column:
    """The matches of one block with their places."""
    zero = F.struct(base.cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("made"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + x["gap"] + x["len"]
        span = F.struct((a["at"] + x["gap"]).alias("start"), end.alias("end"), x["text"].alias("text"))
        return F.struct(end.alias("at"), F.concat(a["made"], F.array(span)).alias("made"))

    return F.aggregate(block, zero, step, lambda a: a["made"])


def tagged(spans: str, kind: str, rank: int) -> Column:
    """Spans with their kind and its place in the list of kinds."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            s["end"].alias("end"),
            s["text"].alias("text"),
        ),
    )


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of tagged spans, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def covered(intervals: Column) -> Column:
    """Number of places in a sorted array of intervals ``(start, end)``, each counted once."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["end"], x["start"]))
        return F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + new).alias("n"))

    return F.aggregate(intervals, zero, step, lambda a: a["n"])
