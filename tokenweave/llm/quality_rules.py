"""Quality rules: robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics.  A minimum covariance
determinant estimate of every (language, source) is found by concentration steps:
from a start by medians, the share of texts nearest to the estimate gives the next one.  A text too
far from its group's estimate, by Mahalanobis distance, is rejected.

Only per-group counts and sums are shuffled.  Quantiles come from counts of fixed
bins, so they do not depend on the order of merging.  Small groups are drawn towards
their language by a pseudo-count, at every size alike.

Edge cases: a null text has no words and fails the base rule; null languages and
sources are groups of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenweave.llm.text import SPACES, covered, split_words, text_of, with_window_hashes
from tokenweave.session import release, stage

SYMBOLS = r"[^#*$%&|<>]++"
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of the words
WINDOW = 5

#: Transformed statistics, and the spread each is taken to have at least: differences
#: below it say nothing about quality.
FLOORS = {
    "x_length": 0.08,  # log of the mean word length
    "x_symbols": 0.03,  # square roots of shares
    "x_upper": 0.05,
    "x_marks": 0.06,
    "x_lines": 0.10,
    "x_repeats": 0.10,
}

#: Share of a group that the estimate rests on, and the number of concentration steps.
SUPPORT = 0.75
STEPS = 4
#: Texts of its language that a group's estimate is mixed with.
PSEUDO = 50
#: Points of the chi-square distribution with six degrees of freedom: median, 97.5 %, 99.99 %.
CHI_HALF, CHI_WEIGHT, CHI_CUT = 5.348, 14.449, 27.856

BINS = 32
PARTS = 16


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of a text and its transformed statistics."""
    df = docs.withColumn("t__", text_of(text))
    df = df.withColumns(
        {
            "w__": split_words(F.col("t__"), SPACES),
            "l__": F.filter(F.split("t__", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""),
        }
    )
    df = with_window_hashes(df, "w__", [WINDOW], "g__")
    grams = f"g__{WINDOW}"
    df = df.withColumn(
        "s__",
        F.when(
            F.size(F.array_distinct(grams)) < F.size(grams),
            F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))),
        ),
    )
    # Sorted by hash, equal windows stand side by side.
    df = df.withColumn(
        "r__",
        F.sort_array(
            F.transform(
                F.filter(
                    "s__",
                    lambda x, k: F.coalesce(F.get("s__", k - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get("s__", k + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: F.struct(x["i"].alias("start"), (x["i"] + WINDOW).alias("end")),
            )
        ),
    )
    df = df.withColumns(
        {
            "n_words": F.size("w__").cast("long"),
            "word_chars": F.length(F.array_join("w__", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("t__", SYMBOLS, "")).cast("long"),
            "n_lines": F.size("l__").cast("long"),
            "n_dup_lines": (F.size("l__") - F.size(F.array_distinct("l__"))).cast("long"),
            "n_repeat_words": F.coalesce(covered(F.col("r__")), F.lit(0).cast("long")),
            "n_upper": F.length(F.regexp_replace("t__", r"[^\p{Lu}]++", "")).cast("long"),
            "n_marks": F.length(F.regexp_replace("t__", r"[^!?=~^@_\\\[\]{}]++", "")).cast("long"),
        }
    ).drop("t__", "w__", "l__", "s__", "r__", grams)
    df = df.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
    )
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    return df.withColumns(
        {
            "x_length": F.log(chars / words),
            "x_symbols": F.sqrt(F.col("n_symbols") / chars),
            "x_upper": F.sqrt(F.col("n_upper") / chars),
            "x_marks": F.sqrt(F.col("n_marks") / chars),
            "x_lines": F.sqrt(F.col("n_dup_lines") / lines),
            "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


def quantiles(df: DataFrame, groups: list[str], bin_: str, points: dict[str, float]) -> DataFrame:
    """Per group the smallest bin that reaches each share of its rows, from counts per bin."""
    # Counted in parts first, so that a large group's counts from all tasks do not meet in one.
    parts = df.groupBy(*groups, bin_, F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")).agg(
        F.count("*").alias("c")
    )
    counts = parts.groupBy(*groups, bin_).agg(F.sum("c").alias("c"))
    whole = Window.partitionBy(*groups)
    upto = F.sum("c").over(whole.orderBy(bin_).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = counts.select(*groups, bin_, upto.alias("u"), F.sum("c").over(whole).alias("n"))
    return reached.groupBy(*groups).agg(
        F.max("n").alias("n"),
        *[F.min(F.when(F.col("u") >= share * F.col("n"), F.col(bin_))).alias(name) for name, share in points.items()],
    )


def _start(df: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """Medians and quartile ranges per group, as a first estimate with a diagonal covariance."""
    each = df.select(
        *groups,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("s"), F.floor(F.col(n) * 400).alias("b")) for n in names])
        ).alias("v"),
    ).select(*groups, "v.s", "v.b")
    cut = quantiles(each, [*groups, "s"], "b", {"low": 0.25, "mid": 0.5, "high": 0.75})
    params = []
    for i, n in enumerate(names):
        here = F.col("s") == n
        params.append(F.max(F.when(here, (F.col("mid") + 0.5) / 400)).alias(f"m_{i}"))
        spread = F.greatest((F.col("high") - F.col("low")) / (400 * 1.349), F.lit(FLOORS[n]))
        params.append(F.max(F.when(here, spread * spread)).alias(f"c_{i}_{i}"))
        params += [F.lit(0.0).alias(f"c_{i}_{j}") for j in range(i)]
    return cut.groupBy(*groups).agg(*params)


def _moments(names: list[str]) -> list[Column]:
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    return [
        F.count("*").cast("double").alias("n"),
        *[F.sum(n).alias(f"a_{i}") for i, n in enumerate(names)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"b_{i}_{j}") for i, j in pairs],
    ]


def _estimate(chosen: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """Mean and covariance per group, mixed with those of the first of the ``groups``."""
    p = range(len(names))
    sums = chosen.groupBy(*groups).agg(*_moments(names))
    scatter = {(i, j): F.col(f"b_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}") / F.col("n") for i in p for j in range(i + 1)}
    wide = Window.partitionBy(groups[0])
    total = F.sum("n").over(wide)
    mixed = sums.select(
        *groups,
        "n",
        *[F.col(f"a_{i}") for i in p],
        *[(F.sum(f"a_{i}").over(wide) / total).alias(f"am_{i}") for i in p],
        *[s.alias(f"s_{i}_{j}") for (i, j), s in scatter.items()],
        *[(F.sum(s).over(wide) / total).alias(f"sm_{i}_{j}") for (i, j), s in scatter.items()],
    )
    n = F.col("n") + PSEUDO
    return mixed.select(
        *groups,
        *[((F.col(f"a_{i}") + PSEUDO * F.col(f"am_{i}")) / n).alias(f"m_{i}") for i in p],
        *[
            (
                (F.col(f"s_{i}_{j}") + PSEUDO * F.col(f"sm_{i}_{j}")) / n
                + (FLOORS[names[i]] ** 2 if i == j else 0.0)
            ).alias(f"c_{i}_{j}")
            for i, j in scatter
        ],
    )


def _factored(params: DataFrame, groups: list[str], size: int) -> DataFrame:
    """Means and the Cholesky factor of each group's covariance."""
    for i in range(size):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"f_{i}_{k}") * F.col(f"f_{j}_{k}")
            params = params.withColumn(
                f"f_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"f_{j}_{j}")
            )
    return params.drop(*[f"c_{i}_{j}" for i in range(size) for j in range(i + 1)])


def with_distance(df: DataFrame, params: DataFrame, groups: list[str], names: list[str], out: str = "d2") -> DataFrame:
    """Adds the squared Mahalanobis distance of each row to its group's estimate."""
    columns = df.columns
    near = df.join(_factored(params, groups, len(names)), groups, "left")
    for i, n in enumerate(names):
        rest = F.col(n) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"f_{i}_{k}") * F.col(f"z_{k}")
        near = near.withColumn(f"z_{i}", rest / F.col(f"f_{i}_{i}"))
    d2 = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(names))), F.lit(0.0))
    return near.select(*columns, *[c for c in ("scale",) if c in near.columns], d2.alias(out))


def _bin(d2: str) -> Column:
    return F.floor(F.log(F.col(d2) + 1e-9) * BINS)


def robust_estimate(vectors: DataFrame, groups: list[str], names: list[str], steps: int = STEPS) -> DataFrame:
    """Minimum covariance determinant estimate per group: means, covariance, ``scale``.

    ``scale`` makes the median distance that of the chi-square distribution.
    """
    params = stage(_start(vectors, groups, names), "mcd")
    for _ in range(steps):
        near = with_distance(vectors, params, groups, names).withColumn("bin", _bin("d2"))
        cut = quantiles(near, groups, "bin", {"most": SUPPORT}).drop("n")
        chosen = near.join(cut, groups).where(F.col("bin") <= F.col("most"))
        params = stage(_estimate(chosen, groups, names), "mcd")
    near = with_distance(vectors, params, groups, names).withColumn("bin", _bin("d2"))
    half = quantiles(near, groups, "bin", {"half": 0.5})
    scale = F.greatest(F.exp((F.col("half") + 0.5) / BINS) / CHI_HALF, F.lit(1.0))
    weighted = near.join(half.select(*groups, scale.alias("scale")), groups)
    chosen = weighted.where(F.col("d2") <= CHI_WEIGHT * F.col("scale"))
    return stage(_estimate(chosen, groups, names), "mcd")


def quality_verdicts(docs: DataFrame, lang: str = "lang", source: str = "source", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, the counts, ``base_failed``, ``distance`` and ``kept`` of every row."""
    stats = stage(with_statistics(_light(docs, lang, source, carry)).drop("text"), "quality")
    return _judged(stats, _group_estimates(stats))


def _light(docs: DataFrame, lang: str, source: str, carry: tuple[str, ...]) -> DataFrame:
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried__"),
        # A group's name, with a mark that a name was given at all.
        F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("")).alias("g_lang"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("g_source"),
        F.col("text"),
    )


GROUPS = ["g_lang", "g_source"]


def _group_estimates(stats: DataFrame) -> DataFrame:
    names = list(FLOORS)
    return robust_estimate(stats.where(~F.col("base_failed")).select(*GROUPS, *names), GROUPS, names)


def _judged(stats: DataFrame, params: DataFrame) -> DataFrame:
    judged = with_distance(stats, params, GROUPS, list(FLOORS), "distance")
    return judged.select(
        "carried__.*",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.sqrt("distance").alias("distance"),
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= CHI_CUT, F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    Only the statistics are staged for the estimates.  The documents are judged in a second pass, so that no copy of them stays behind.
    """
    docs = docs.withColumn("all__", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    stats = stage(with_statistics(_light(docs, "lang", "source", ())).drop("text", "carried__"), "quality")
    params = _group_estimates(stats)
    release(stats)
    judged = _judged(with_statistics(_light(docs, "lang", "source", ("all__",))), params)
    # A condition on ``kept`` would be pushed down into the statistics, and be computed there once for every time that it
    # names one.  Nothing is pushed below a column that follows from the task.
    passing = judged.select("all__", F.when(F.col("kept"), F.spark_partition_id()).alias("passed__"))
    return passing.where(F.col("passed__").isNotNull()).select("all__.*")
