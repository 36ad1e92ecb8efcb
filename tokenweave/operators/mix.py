"""Putting corpora one after another."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The years that exist, and the preset of a single year.
FIRST_YEAR, LAST_YEAR = 1992, 2003
YEAR_PRESETS = {"2000": [2000], "all": list(range(FIRST_YEAR, LAST_YEAR + 1))}


def mix_corpora(corpora: Sequence[DataFrame], out: str = "corpus") -> DataFrame:
    """Concatenate corpora per split, the first one first.

    The position of the corpus becomes the leading order column ``out``; pass it
    first in the order of ``token_offsets``.
    """
    numbered = [df.withColumn(out, F.lit(i)) for i, df in enumerate(corpora)]
    return reduce(DataFrame.unionByName, numbered)


def check_years(years: Sequence, known: Sequence | None = None) -> None:
    """Refuses years that do not exist."""
    unknown = sorted(set(years) - set(YEAR_PRESETS["all"] if known is None else known))
    if unknown:
        raise ValueError(f"unknown years {unknown}")


def select_years(df: DataFrame, years: Sequence, known: Sequence | None = None, column: str = "year") -> DataFrame:
    """Rows of the wanted years; a filter on a partition column reads only those."""
    check_years(years, known)
    return df.where(F.col(column).isin(list(years)))


def concat_years(df: DataFrame, years: Sequence, column: str = "year", out: str = "part") -> DataFrame:
    """Rows of the wanted years with ``out``, the position of their year in the list.

    A year asked for twice is there twice, as in a concatenation.
    """
    places = F.array(
        *[F.struct(F.lit(y).alias("wanted"), F.lit(i).alias(out)) for i, y in enumerate(years)]
    )
    mine = F.filter(places, lambda p: p["wanted"] == F.col(column))
    return df.where(F.col(column).isin(list(years))).select("*", F.inline(mine)).drop("wanted")
