"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction.

Tokens with digits or an at-sign are instances; the words around them, with the
instance's shape left open, are lexical patterns.  Starting from the instances that the fixed patterns
found, the bipartite graph of patterns and instances is scored in rounds, until a round finds nothing new: a pattern by the
share and the number of its instances that are known, an instance by its best pattern.
Instances of confident patterns join the known ones, and their
occurrences that no fixed pattern covers are added as spans of kind ``context``.

The graph is aggregated by pattern and by instance, with partial sums before each shuffle,
so a pattern that half of all documents share is no more than one row per task.

Edge cases: a null text has no spans; places are code points; repeated rows and
repeated or null ids are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.llm.text import ROW, tagged, text_of, with_matches, with_row_key
from tokenweave.session import stage

LOCAL = r"[A-Za-z0-9._%+-]"
# An attempt inside a run that already failed cannot succeed, except where the match before ended.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A word with a digit or an at-sign; tried at the start of a word only.
TOKEN = r"(?<!\S)\S*?[0-9@]\S*+"
KINDS = ("email", "ip", "card", "phone", "context")

#: A pattern is confident from this share of known instances and this many distinct ones.
PRECISION = 0.8
SUPPORT = 3
#: Characters before and after a token that its context words are taken from.
REACH = 48


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]++", "")


def passes_luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    places = F.split(F.reverse(digits), "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _is_ip(s: Column) -> Column:
    return F.forall(
        F.transform(F.split(s["text"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")),
        lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255),
    )


def _is_card(s: Column) -> Column:
    digits = _digits(s["text"])
    return F.when(F.length(digits).between(16, 19), passes_luhn(digits)).otherwise(F.lit(False))


def _is_phone(s: Column) -> Column:
    return F.length(_digits(s["text"])).between(8, 15)


def with_base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``base_spans`` of the fixed patterns, by kind and place, and the ``tokens`` with their contexts."""
    df = docs.withColumn("t__", text_of(text))
    for name, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("token", TOKEN)):
        df = with_matches(df, "t__", pattern, f"{name}__")
    df = df.withColumns(
        {
            "ip__": F.filter("ip__", _is_ip),
            "card__": F.filter("card__", _is_card),
            "phone__": F.filter("phone__", _is_phone),
        }
    )
    base = F.concat(*[tagged(f"{k}__", k, i) for i, k in enumerate(KINDS[:4])])
    df = df.withColumn("base_spans", _by_kind(base))
    # The words around a token come from the parts between the tokens.
    df = df.withColumn("g__", F.split("t__", TOKEN, -1))
    df = df.withColumn(
        "tokens",
        F.transform(
            "token__",
            lambda s, k: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.regexp_replace(s["text"], r"^[\p{Punct}&&[^+]]+|\p{Punct}+$", "").alias("instance"),
                _words(F.right(F.get("g__", k), F.lit(REACH)), r"(\p{L}+\P{L}*\p{L}+)\P{L}*$").alias("left"),
                _words(F.left(F.get("g__", k + 1), F.lit(REACH)), r"^\P{L}*(\p{L}+)").alias("right"),
                F.get(
                    F.filter("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), F.lit(0)
                )["kind"].alias("kind"),
            ),
        ),
    )
    return df.drop("t__", "g__", "token__", *[f"{k}__" for k in KINDS[:4]])


def _words(part: Column, pattern: str) -> Column:
    return F.lower(F.regexp_extract(part, pattern, 1))


def _by_kind(spans: Column) -> Column:
    """Spans in the order of kind and place."""
    return F.transform(
        F.array_sort(
            F.transform(
                spans,
                lambda s: F.struct(
                    s["rank"].alias("rank"),
                    s["start"].alias("start"),
                    s["kind"].alias("kind"),
                    s["end"].alias("end"),
                    s["text"].alias("text"),
                ),
            )
        ),
        lambda s: s,
    )


def confident_instances(edges: DataFrame, precision: float = PRECISION, support: int = SUPPORT) -> DataFrame:
    """Unseen instances that confident patterns discover, as ``(instance, score)``.

    ``edges`` has ``pattern``, ``instance`` and ``seed`` (known from the start).
    """
    known = edges.groupBy("instance").agg(F.max("seed").alias("known"), F.lit(1.0).alias("score"))
    known = known.withColumn("score", F.when(F.col("known"), 1.0).otherwise(0.0))
    links = stage(edges.select("pattern", "instance").distinct(), "pii-links")
    known = stage(known, "pii-known")
    n_known, before = known.where("known").count(), -1
    while n_known > before:
        scored = (
            links.join(known, "instance")
            .groupBy("pattern")
            .agg(F.sum(F.col("known").cast("long")).alias("hits"), F.count("*").alias("all"))
            .select("pattern", "hits", (F.col("hits") / F.col("all")).alias("precision"))
            .where((F.col("hits") >= support) & (F.col("precision") >= precision))
        )
        reached = links.join(scored, "pattern").groupBy("instance").agg(F.max("precision").alias("best"))
        known = stage(
            known.join(reached, "instance", "left").select(
                "instance",
                (F.col("known") | F.col("best").isNotNull()).alias("known"),
                F.greatest("score", F.coalesce("best", F.lit(0.0))).alias("score"),
            ),
            "pii-known",
        )
        n_known, before = known.where("known").count(), n_known
    return known.where("known").select("instance", "score")


def scan_personal_data(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with ``base_spans`` and ``spans``: arrays of ``(rank, start, kind, end, text)``."""
    light = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried__"), F.col(text).alias("text"))
    found = stage(with_base_spans(with_row_key(light), "text").drop("text"), "pii")
    tokens = found.select(ROW, F.explode("tokens").alias("k")).select(ROW, "k.*")
    # An instance stands for its exact text; its shape keeps numbers of unlike forms apart in a pattern.
    shape = F.regexp_replace(F.regexp_replace("instance", "[0-9]+", "9"), r"\p{L}+", "a")
    tokens = tokens.where((F.col("left") != "") & (F.length("instance") >= 4)).withColumn(
        "pattern", F.concat_ws(" ", "left", F.concat(F.lit("<"), shape, F.lit(">")), "right")
    )
    # The context alone, without the shape, lets a pattern reach identifiers of another form.
    wide = tokens.withColumn("pattern", F.concat_ws(" ", "left", F.lit("<>"), "right"))
    both = tokens.unionByName(wide)
    edges = both.groupBy("pattern", "instance").agg(F.max(F.col("kind").isNotNull()).alias("seed"))
    unseen = confident_instances(edges)
    added = (
        tokens.where(F.col("kind").isNull())
        .join(unseen, "instance")
        .groupBy(ROW)
        .agg(
            F.collect_list(
                F.struct(
                    F.lit(4).alias("rank"), "start", F.lit("context").alias("kind"), "end", F.col("instance").alias("text")
                )
            ).alias("more")
        )
    )
    none = F.array().cast(found.schema["base_spans"].dataType)
    return found.join(added, ROW, "left").select(
        "carried__.*",
        "base_spans",
        F.array_sort(F.concat("base_spans", F.coalesce(F.col("more").cast(found.schema["base_spans"].dataType), none))).alias("spans"),
    )
