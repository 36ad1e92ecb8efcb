"""Edit distance by diagonals, and the segments and substrings of the partition join."""

from __future__ import annotations


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two strings is at most ``most``.

    Behind the common ends, the furthest place on each diagonal is kept for one number of edits after the other.  Along a
    diagonal equal stretches are passed by comparing slices, so the steps grow with the square of the edits and hardly with the length.
    """
    if abs(len(a) - len(b)) > most:
        return False
    head = _common(len(a), len(b), lambda n: a[:n] == b[:n])
    a, b = a[head:], b[head:]
    tail = _common(len(a), len(b), lambda n: not n or a[-n:] == b[-n:])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return max(len(a), len(b)) <= most
    goal = len(b) - len(a)
    reached = {0: 0}  # the diagonal, and how far along ``a``
    for e in range(1, most + 1):
        before, reached = reached, {}
        # Other diagonals lead back to the ends of both with too many edits.
        for d in range(max(-e, goal - most + e), min(e, goal + most - e) + 1):
            i = max(before.get(d, -2) + 1, before.get(d - 1, -1), before.get(d + 1, -2) + 1)
            i = min(i, len(a), len(b) - d)
            if i >= max(0, -d):
                reached[d] = i + _stretch(a, i, b, i + d)
        if reached.get(goal) == len(a):
            return True
    return False


def _stretch(a: str, i: int, b: str, j: int) -> int:
    """How many characters are equal from two places on."""
    if a[i : i + 1] != b[j : j + 1]:
        return 0
    return _common(len(a) - i, len(b) - j, lambda n: a[i : i + n] == b[j : j + n])


def _common(x: int, y: int, same) -> int:
    """Largest n up to both lengths for which ``same(n)`` holds."""
    low, high = 0, min(x, y)
    while low < high:
        middle = (low + high + 1) // 2
        if same(middle):
            low = middle
        else:
            high = middle - 1
    return low


def segments(length: int, most: int) -> list[tuple[int, int]]:
    """``(start, size)`` of the ``most + 1`` segments of a string, the longer ones last."""
    count = most + 1
    size, longer = divmod(length, count)
    out, at = [], 0
    for i in range(count):
        this = size + (i >= count - longer)
        out.append((at, this))
        at += this
    return out


def probes(length: int, most: int) -> list[tuple[int, int, int, int]]:
    """``(indexed length, segment, start, size)`` of the substrings that a string has to look up.

    Of the lengths up to its own; the start may be off by the edits that the segments before
    and behind it leave.  Looking up a segment at its own place in a string of the same
    length is left out, as that string's own index entry meets it.
    """
    out = []
    for other in range(max(most + 1, length - most), length + 1):
        off = length - other
        for i, (at, size) in enumerate(segments(other, most)):
            low = max(0, at - i, at + off - (most - i))
            high = min(length - size, at + i, at + off + (most - i))
            out += [(other, i, start, size) for start in range(low, high + 1) if off or start != at]
    return out
