"""Byte-pair encoding as Arrow UDFs over a rank file.

The ranks travel as one broadcast of bounded size and the encoder is built once
per worker process, so a rank file is needed on the driver only.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values of the byte-pair vocabulary.
EOT_TEXT = "<|endoftext|>"
EOT_ID = 50256
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A rank file beyond this is refused instead of broadcast.
MAX_RANK_BYTES = 64 << 20

#: Arrow bytes that are encoded or decoded at a time.
PART_BYTES = 1 << 20

POLICIES = ("ordinary", "allow", "error")


def default_rank_file() -> str | None:
    """Rank file of the 50k vocabulary, where the vocabularies package is installed."""
    try:
        import public_tokenizers
    except ImportError:
        return None
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _ranks(content: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in content.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


#: Encoders of this worker process, by the digest of their ranks and the end-of-text id.
_ENCODINGS: dict[tuple[str, int], object] = {}


def _encoding(name: tuple[str, int], ranks: bytes):
    """The encoder of that name, built on first use."""
    import tiktoken

    if name not in _ENCODINGS:
        _ENCODINGS[name] = tiktoken.Encoding(
            name[0], pat_str=SPLIT_PATTERN, mergeable_ranks=_ranks(ranks), special_tokens={EOT_TEXT: name[1]}
        )
    return _ENCODINGS[name]


def in_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches in parts of about ``PART_BYTES``, as a batch of long texts or lists is many times its size as objects."""
    for batch in batches:
        rows = max(1, len(batch) * PART_BYTES // max(1, batch.nbytes))
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


class BytePairCoder:
    """Column functions for one vocabulary, given by the path or the content of its rank file."""

    def __init__(self, spark: SparkSession, rank_file: str | bytes | None = None, eot: int = EOT_ID):
        path = rank_file or default_rank_file()
        if path is None:
            raise ValueError("give the path of a byte-pair rank file")
        if (len(path) if isinstance(path, bytes) else os.path.getsize(path)) > MAX_RANK_BYTES:
            raise ValueError(f"a rank file is larger than {MAX_RANK_BYTES} bytes")
        if isinstance(path, bytes):
            content, path = path, "the rank file"
        else:
            with open(path, "rb") as f:
                content = f.read()
        if eot in _ranks(content).values():
            raise ValueError(f"{path} has a token with the end-of-text id {eot}")
        self.eot = eot
        self._ranks = spark.sparkContext.broadcast(content)
        self._name = hashlib.sha256(content).hexdigest(), eot

    def _coder(self) -> Callable[[], object]:
        name, ranks = self._name, self._ranks
        return lambda: _encoding(name, ranks.value)

    def encode(self, text: Column | str, special: str = "ordinary") -> Column:
        """Text to ids (``array<int>``); null stays null.

        ``special`` says what the end-of-text literal in a text means: "ordinary"
        characters, "allow" for the special id, "error" for a null result, which
        :func:`is_rejected` marks beforehand.
        """
        if special not in POLICIES:
            raise ValueError(f"special must be one of {POLICIES}, not {special!r}")
        coder = self._coder()
        allowed = {EOT_TEXT} if special == "allow" else set()
        refused = special == "error"

        @F.arrow_udf("array<int>")
        def encode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            enc = coder()
            for texts in in_parts(batches):
                found: list[np.ndarray | None] = []
                for text in texts.to_pylist():
                    if text is None or (refused and EOT_TEXT in text):
                        found.append(None)
                    else:
                        ids = enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
                        found.append(ids)
                ends = np.cumsum([0] + [0 if a is None else len(a) for a in found]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint32)] + [a for a in found if a is not None])
                missing = pa.array([a is None for a in found], pa.bool_())
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)), mask=missing)

        return encode_ids(text)

    def decode(self, ids: Column | str) -> Column:
        """Ids to text."""
        coder = self._coder()

        @F.arrow_udf("string")
        def decode_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            enc = coder()
            for lists in in_parts(batches):
                yield pa.array([None if x is None else enc.decode(x) for x in lists.to_pylist()], pa.string())

        return decode_text(ids)


def is_rejected(text: Column | str) -> Column:
    """True for a text that the "error" policy refuses: null, or holding the end-of-text literal."""
    col = F.col(text) if isinstance(text, str) else text
    return col.isNull() | F.coalesce(F.contains(col, F.lit(EOT_TEXT)), F.lit(False))
