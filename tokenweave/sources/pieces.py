"""Cutting byte streams where lines, and token borders, are sure not to be hurt.

A range of a file begins at the first cut at or behind its start and ends at the first cut at or behind its end, so
neighbouring ranges agree without talking to each other.  A cut is the place behind a line end; where none is near, it
is the next line end or place between a visible ASCII character and white space, which no byte-pair token crosses.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: How far a line end is looked for before a word end will do.
NEAR = 1 << 20
#: Bytes read at a time.
READ_BYTES = 1 << 20

#: A cut is one byte behind the start of a match.
CUT = re.compile(rb"[\x21-\x7e][\t-\r ]|\n")
SPACES = b"\t\n\x0b\x0c\r "


def cut_behind(read: Callable[[int, int], bytes], length: int, at: int, near: int = NEAR) -> int:
    """The first cut at or behind ``at`` of ``length`` bytes; ``read(place, size)`` gives bytes."""
    if at <= 0 or at >= length:
        return max(0, min(at, length))
    block = read(at - 1, min(near, length - at + 1))
    if (end := block.find(b"\n")) >= 0:
        return at + end
    place = at - 1
    while place < length - 1:
        # Blocks overlap by a byte, as a cut is between two.
        block = read(place, min(READ_BYTES + 1, length - place))
        if found := CUT.search(block):
            return place + found.start() + 1
        place += READ_BYTES
    return length


def range_piece(read: Callable[[int, int], bytes], length: int, start: int, size: int, near: int = NEAR) -> tuple[int, bytes]:
    """The piece that belongs to the range of ``size`` bytes from ``start``: where it begins, and its bytes."""
    first = cut_behind(read, length, start, near)
    last = cut_behind(read, length, start + size, near)
    return first, read(first, last - first) if last > first else b""


def stream_pieces(stream, size: int) -> Iterator[bytes]:
    """A stream that can only be read once, in pieces of about ``size`` bytes that end at cuts."""
    held = bytearray()
    looked = 0
    while block := stream.read(min(READ_BYTES, size)):
        held += block
        if len(held) < size:
            continue
        end = held.rfind(b"\n", looked) + 1 or _last_word_end(held, looked)
        looked = max(0, len(held) - 1)
        if end:
            yield bytes(held[:end])
            del held[:end]
            looked = max(0, len(held) - 1)
    yield bytes(held)


def _last_word_end(held: bytearray, low: int) -> int:
    """The last place between a visible ASCII character and white space behind ``low``; zero without one."""
    at = len(held) - 1
    while at > low:
        if held[at] in SPACES and 0x21 <= held[at - 1] <= 0x7E:
            return at
        at -= 1
    return 0
