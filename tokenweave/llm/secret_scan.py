"""Secret scan: fixed patterns, and a sliding-window entropy over candidate strings.

A candidate is a run of key characters.  A window slides over it; the sum of
``c * log2(c)`` over the window's character counts is kept up to date from the
counts of the one character that enters and the one that leaves.  A candidate whose highest window
entropy reaches the threshold of its character class is a secret, unless it lies in
a pattern's span or is on the allow-list.

Edge cases: a null text has no spans; places are code points; repeated rows and
repeated or null ids are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.llm.text import tagged, text_of, with_matches

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of a window, and the bits a class needs in its best window.
WINDOW = 20
BITS = {"hex": 3.0, "letters": 3.7, "mixed": 3.6}

#: Strings that look like keys and are none: words of examples, long repeats, alphabets, UUIDs.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|your[_-]|(.)\1{5}|0123456789|abcdefghij"
    r"|^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
)


def _term(count: Column) -> Column:
    """``c * log2(c)``, zero for no character."""
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def _count(window: Column, char: Column) -> Column:
    return (F.size(window) - F.size(F.array_remove(window, char))).cast("double")


def best_entropy(text: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits a character, of any window of the text."""
    chars = F.split(text, "")
    return F.aggregate(
        F.array(chars), F.lit(0.0), lambda _, c: _slide(c, window)
    )


def _slide(chars: Column, window: int) -> Column:
    first = F.slice(chars, 1, window)
    begin = F.aggregate(F.array_distinct(first), F.lit(0.0), lambda a, c: a + _term(_count(first, c)))
    zero = F.struct(begin.alias("sum"), begin.alias("least"))

    def step(a: Column, i: Column) -> Column:
        # The window that ended before place i (from 1) loses its first character and gains that one.
        old = F.slice(chars, i - window, F.lit(window))
        out, into = F.get(chars, i - window - 1), F.get(chars, i - 1)
        gone = _count(old, out)
        left = F.slice(chars, i - window + 1, F.lit(window - 1))
        there = _count(left, into)
        now = a["sum"] - _term(gone) + _term(gone - 1) - _term(there) + _term(there + 1)
        return F.struct(now.alias("sum"), F.least(a["least"], now).alias("least"))

    places = F.when(F.size(chars) > window, F.sequence(F.lit(window + 1), F.size(chars))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(
        places, zero, step, lambda a: F.lit(float(_log2(window))) - a["least"] / F.lit(float(window))
    )


def _log2(n: int) -> float:
    import math

    return math.log2(n)


def needed_bits(text: Column) -> Column:
    """Entropy that a candidate of this character class needs; null for plain words and numbers."""
    lower, upper, digit = (text.rlike(p) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return (
        F.when(digit & text.rlike("^[0-9a-fA-F]+$") & (lower | upper), F.lit(BITS["hex"]))
        .when(digit & (lower | upper), F.lit(BITS["mixed"]))
        .when(lower & upper & text.rlike("[a-z][A-Z].*[a-z][A-Z]"), F.lit(BITS["letters"]))
    )


def scan_secrets(docs: DataFrame, text: str = "text", allow: str = ALLOWED) -> DataFrame:
    """Adds ``base_spans`` and ``spans``, arrays of ``(start, rank, kind, end, text)`` in text order."""
    df = docs.withColumn("t__", text_of(text))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)):
        df = with_matches(df, "t__", pattern, f"{name}__")
    df = df.drop("t__").withColumns(
        {
            "assign__": F.filter(
                "assign__", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= 6
            ),
            "access__": F.filter("access__", lambda s: F.length(s["text"]) >= 20),
        }
    )
    df = df.withColumn(
        "base_spans",
        F.array_sort(F.concat(*[tagged(f"{k}__", k, i) for i, k in enumerate(KINDS[:3])])),
    )

    def is_secret(s: Column) -> Column:
        apart = ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        bits = needed_bits(s["text"])
        allowed = s["text"].rlike(allow)
        return apart & F.coalesce((best_entropy(s["text"]) >= bits) & ~allowed, F.lit(False))

    df = df.withColumn("entropy__", F.filter("entropy__", is_secret))
    return df.withColumn(
        "spans", F.array_sort(F.concat("base_spans", tagged("entropy__", "entropy", 3)))
    ).drop(*[f"{k}__" for k in KINDS])
