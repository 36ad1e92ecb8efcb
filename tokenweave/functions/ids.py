"""Column expressions over id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The padded vocabulary of the models and the word size on disk.
MODEL_VOCAB_SIZE = 50304
WORD_LIMIT = 1 << 16


def _col(ids: Column | str) -> Column:
    return F.col(ids) if isinstance(ids, str) else ids


def append_eot(ids: Column | str, eot: int) -> Column:
    """Close a document with the end-of-text id."""
    return F.concat(_col(ids), F.array(F.lit(eot)))


def token_len(ids: Column | str) -> Column:
    """Ids of a document, as a long."""
    return F.size(_col(ids)).cast("long")


def ids_in_range(ids: Column | str, vocab_size: int = MODEL_VOCAB_SIZE) -> Column:
    """True when every id fits the vocabulary and a two-byte word; empty arrays fit."""
    a = _col(ids)
    top = min(vocab_size, WORD_LIMIT)
    return F.coalesce((F.array_min(a) >= 0) & (F.array_max(a) < top), F.size(a) == 0)
