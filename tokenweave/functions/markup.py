"""Newline normalization and markup-to-text conversion as regular expressions and folds over their matches.

The expressions avoid look-around, so any linear-time regex engine gives the same text.  What no expression can tell,
where an element nested in one of its own name ends, is counted in arrays of tags.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.functions.numbers import let


def drop_balanced(text: Column, opening: str, closing: str) -> Column:
    """Elements from an opening tag to the closing tag that balances it become a space.

    A tag without its counterpart is no element and stays, and so does the text around it.
    """
    tag = F.lit(f"{opening}|{closing}")

    def folded(body: Column, tags: Column) -> Column:
        def deeper(depths: Column, t: Column) -> Column:
            step = F.when(t.rlike(f"^(?:{opening})$"), 1).otherwise(-1)
            return F.concat(depths, F.array(F.greatest(F.lit(0), F.element_at(depths, -1) + step)))

        def least(found: Column, depth: Column) -> Column:
            return F.concat(found, F.array(F.least(F.element_at(found, -1), depth)))

        depths = F.aggregate(tags, F.array(F.lit(0)), deeper)
        return let(
            depths,
            lambda d: let(
                # The levels that no later tag closes.
                F.reverse(F.aggregate(F.reverse(d), F.array(F.element_at(d, -1)), least, lambda x: F.slice(x, 2, F.size(d)))),
                lambda s: F.array_join(F.transform(F.split(body, tag, -1), lambda g, i: _kept(g, i, tags, d, s)), ""),
            ),
        )

    def matched(body: Column) -> Column:
        return F.when(body.rlike(f"{opening}|{closing}"), let(F.regexp_extract_all(body, tag, F.lit(0)), lambda t: folded(body, t))).otherwise(body)

    return let(text, matched)


def _kept(gap: Column, i: Column, tags: Column, depths: Column, open_: Column) -> Column:
    """What is left of the ``i``-th tag, counted from one, and of the text behind it."""
    here, before = F.get(depths, i), F.get(depths, i - 1)
    opens, outermost = here > before, before == F.get(open_, i - 1)
    of_tag = (
        F.when(i == 0, "")
        .when(opens & (here > F.get(open_, i)), F.when(outermost, " ").otherwise(""))
        .when(opens | (before == 0), F.get(tags, i - 1))
        .otherwise("")
    )
    return F.concat(of_tag, F.when(here == F.get(open_, i), gap).otherwise(""))


NUMBERED = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def _character(entity: Column) -> Column:
    """The character of ``&#65;`` or ``&#x41;``; the replacement character where there is none."""
    code = F.when(
        entity.rlike("^&#[xX]"), F.conv(F.regexp_extract(entity, "[xX]([0-9a-fA-F]+)", 1), 16, 10)
    ).otherwise(F.regexp_extract(entity, "([0-9]+)", 1)).cast("long")

    def valid(c: Column) -> Column:
        known = ((c > 0) & (c < 0xD800)) | ((c > 0xDFFF) & (c <= 0x10FFFF))
        return F.decode(F.unhex(F.lpad(F.hex(F.when(known, c).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    return let(code, valid)


def numbered_entities(text: Column) -> Column:
    """Numeric character references as the characters they stand for."""

    def replaced(body: Column) -> Column:
        found = F.regexp_extract_all(body, F.lit(NUMBERED), F.lit(0))
        # Text before each reference, then the reference; nothing stands behind the last text.
        pairs = F.zip_with(F.split(body, F.lit(NUMBERED), -1), F.transform(found, _character), lambda t, c: F.concat(t, F.coalesce(c, F.lit(""))))
        return F.when(body.rlike(NUMBERED), F.array_join(pairs, "")).otherwise(body)

    return let(text, replaced)


# The conversion rules, applied from the top down.
HTML_RULES = [
    *[partial(drop_balanced, opening=rf"(?i:<{name}(?:\s[^>]*)?>)", closing=rf"(?i:</{name}\s*>)") for name in ("script", "style")],
    (r"(?s)<!--.*?-->", " "),
    (r"<[^>]*>", " "),
    (r"&nbsp;", " "),
    numbered_entities,
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"[ \t\r\n]+", " "),
]
LATEX_RULES = [
    # the preamble and what follows the document
    (r"(?s)^.*\\begin\{document\}", ""),
    (r"(?s)\\end\{document\}.*$", ""),
    # comments, but not escaped percent signs
    (r"(?m)(^|[^\\])%.*$", "$1"),
    # environments without running text
    *[
        partial(drop_balanced, opening=rf"\\begin\{{{name}\*?\}}", closing=rf"\\end\{{{name}\*?\}}")
        for name in ("tabular", "picture", "figure", "table", "thebibliography")
    ],
    # headings, list items, paragraph ends
    (r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", "\n\n# $2\n\n"),
    (r"\\item\b *", "\n- "),
    (r"\\(begin|end)\{[^{}]*\}(\[[^\[\]]*\])?", "\n"),
    (r"\\par\b", "\n\n"),
    (r"\\\\(\[[^\[\]]*\])?", "\n"),
    # references and other commands whose argument is not text
    (r"\\(label|ref|eqref|cite|bibliographystyle|bibliography|usepackage|vspace|hspace|input|include)\*?(\[[^\[\]]*\])?\{[^{}]*\}", ""),
    # any other command keeps its argument
    (r"\\[a-zA-Z]+\*?(\[[^\[\]]*\])?\{([^{}]*)\}", "$2"),
    (r"\\[a-zA-Z]+\*?(\[[^\[\]]*\])?\{([^{}]*)\}", "$2"),
    (r"\\[a-zA-Z]+\*?", ""),
    # escaped characters, ties, leftover braces
    (r"\\([%$#&_{}])", "$1"),
    (r"~", " "),
    (r"[{}]", ""),
    # white space
    (r"[ \t]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
]
DIALECTS = {"html": HTML_RULES, "latex": LATEX_RULES}


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def normalize_newlines(text: Column | str) -> Column:
    """Every kind of line end becomes a newline, as in text-mode reading."""
    return F.regexp_replace(_col(text), "\r\n?", "\n")


def markup_to_text(markup: Column | str, dialect: str = "html") -> Column:
    """Plain text of a marked-up source, trimmed; empty when nothing is left."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}, known are {sorted(DIALECTS)}")
    body = reduce(lambda t, rule: rule(t) if callable(rule) else F.regexp_replace(t, *rule), DIALECTS[dialect], _col(markup))
    return F.regexp_replace(body, "^[ \\n]+|[ \\n]+$", "") if dialect == "latex" else F.trim(body)


def convert_markup(df: DataFrame, column: str = "markup", dialect: str = "html") -> DataFrame:
    """Adds ``text``, ``ok`` and, for what failed, a ``reason``."""
    text = markup_to_text(column, dialect)
    reason = F.when(F.col(column).isNull(), "no source").when(F.col("text") == "", "no text")
    return df.withColumn("text", text).withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def keep_converted(df: DataFrame) -> DataFrame:
    """Only the documents whose conversion worked."""
    return df.where("ok").drop("ok", "reason")


def conversion_rejects(df: DataFrame) -> DataFrame:
    """The documents :func:`keep_converted` leaves out, with the reason."""
    return df.where(~F.col("ok")).drop("text", "ok")
