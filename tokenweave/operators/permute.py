"""Seeded permutations of the numbers below n by arithmetic alone.

A number is written as two digits of a mixed radix, about the square root of n each.  Rounds add a keyed function of
one digit to the other, which can be undone, so they permute all pairs of digits; a pair that is no number below n
is sent through the rounds again until it is one.  Few pairs are: less than one in the square root of n.
Every place is computed from its own number, so nothing is ranked, shuffled or kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenweave.functions.numbers import div, let

#: A prime below 2**31: products of two remainders stay below 2**62.
PRIME = (1 << 31) - 1
#: Additions to either digit.
ROUNDS = 4
#: Times that a pair goes through the rounds again.  More pairs than that are no number only where n is
#: above 4,096, and then each further time is needed with a chance below 1 / 64.
AGAIN = 64


def round_keys(seed: int, epoch: int) -> list[list[int]]:
    """Per round three numbers below the prime for each of its two additions.

    They are the first slices of an md5 of seed, epoch and the number of the addition.
    """

    def numbers(addition: int) -> list[int]:
        digest = hashlib.md5(f"{seed}:{epoch}:{addition}".encode()).hexdigest()
        return [int(digest[8 * k : 8 * k + 8], 16) % PRIME for k in range(3)]

    return [numbers(2 * i) + numbers(2 * i + 1) for i in range(ROUNDS)]


def _noise(digit: Column, key: Column, at: int) -> Column:
    """A keyed function of a digit: a quadratic of a linear remainder."""
    a, b, c = (F.get(key, at + k) for k in range(3))
    return let((digit * a + b) % PRIME, lambda m: (m * m % PRIME + m * c % PRIME + b) % PRIME)


def _pass(x: Column, high: Column, low: Column, keys: Column, back: bool) -> Column:
    """One number through all rounds, or back through them."""

    def there(s: Column, k: Column) -> Column:
        left = (s["l"] + _noise(s["r"], k, 0)) % high
        return let(left, lambda l: F.struct(l.alias("l"), ((s["r"] + _noise(l, k, 3)) % low).alias("r")))

    def again(s: Column, k: Column) -> Column:
        right = F.pmod(s["r"] - _noise(s["l"], k, 3), low)
        return let(right, lambda r: F.struct(F.pmod(s["l"] - _noise(r, k, 0), high).alias("l"), r.alias("r")))

    start = F.struct(div(x, low).alias("l"), (x % low).alias("r"))
    return F.aggregate(F.reverse(keys) if back else keys, start, again if back else there, lambda s: s["l"] * low + s["r"])


def permuted(x: Column, n: Column, keys: Column, back: bool = False) -> Column:
    """Where ``x`` of the numbers below ``n`` goes under the permutation of ``keys``; ``back`` gives its origin.

    ``keys`` is an ``array<array<bigint>>`` of :func:`round_keys`.  ``n`` is at most 2**60.
    """
    high = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def walked(y: Column, high: Column, low: Column) -> Column:
        on = F.aggregate(
            F.sequence(F.lit(1), F.lit(AGAIN)), y, lambda z, _: F.when(z < n, z).otherwise(_pass(z, high, low, keys, back))
        )
        return F.when(y < n, y).otherwise(on)

    def placed(high: Column) -> Column:
        low = div(n + high - 1, high)
        return let(low, lambda low: let(_pass(x, high, low, keys, back), lambda y: walked(y, high, low)))

    outside = F.raise_error(F.concat(F.lit("no place below n for "), x.cast("string"))).cast("long")
    return let(F.when((x >= 0) & (x < n), let(high, placed)), lambda p: F.when(p < n, p).otherwise(outside))
