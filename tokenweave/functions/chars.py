"""The 96-symbol character vocabulary, as JVM column expressions.

The symbols in code-point order are the newline and the printable ASCII range
from space to tilde, so the table is a rule: newline is 0, any other symbol is
its code point minus 31.  Characters outside the table are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the character vocabulary.
VOCAB_SIZE = 96
NEWLINE_ID = 0
CODE_POINT_SHIFT = 31
OUT_OF_VOCAB = "[^\n -~]"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def drop_out_of_vocab(text: Column | str) -> Column:
    """The text without the characters that have no id."""
    return F.regexp_replace(_col(text), OUT_OF_VOCAB, "")


def char_len(text: Column | str) -> Column:
    """Number of ids of a text, without building them."""
    return F.length(drop_out_of_vocab(text)).cast("long")


def char_encode(text: Column | str) -> Column:
    """Text to character ids (``array<int>``); null stays null, empty gives no ids."""
    kept = drop_out_of_vocab(text)
    ids = F.transform(
        F.split(kept, ""), lambda c: F.when(c == "\n", NEWLINE_ID).otherwise(F.ascii(c) - CODE_POINT_SHIFT)
    )
    return F.when(F.length(kept) == 0, F.array().cast("array<int>")).otherwise(ids)


def char_decode(ids: Column | str) -> Column:
    """Character ids back to text."""
    return F.array_join(
        F.transform(
            _col(ids), lambda i: F.when(i == NEWLINE_ID, "\n").otherwise(F.chr((i + CODE_POINT_SHIFT).cast("long")))
        ),
        "",
    )
