import string

import pytest
from pyspark.sql import functions as F

from tokenweave.functions.bpe import EOT_ID, EOT_TEXT, BytePairCoder, is_rejected
from tokenweave.functions.chars import char_decode, char_encode, char_len, drop_out_of_vocab
from tokenweave.functions.ids import append_eot, ids_in_range, token_len
from tokenweave.functions.markup import (
    conversion_rejects,
    convert_markup,
    keep_converted,
    markup_to_text,
    normalize_newlines,
)

SYMBOLS = sorted(set(string.ascii_letters + string.digits + string.punctuation + " \n"))
TEXTS = ["", "Hello world", "é😀\tA", "a\nb~ !", "".join(SYMBOLS), "a" + EOT_TEXT + "b", "x \n\n  y ", "日本語 text 12345"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)


def column(df, col):
    return [r[1] for r in sorted(df.select("id", col.alias("v")).collect())]


def test_char_table(spark):
    assert len(SYMBOLS) == 96
    got = column(frame(spark, TEXTS), char_encode("text"))
    assert got == [[SYMBOLS.index(c) for c in t if c in SYMBOLS] for t in TEXTS]
    assert got[2] == [SYMBOLS.index("A")]


def test_char_round_trip_and_length(spark):
    df = frame(spark, TEXTS)
    assert column(df, char_decode(char_encode("text"))) == ["".join(c for c in t if c in SYMBOLS) for t in TEXTS]
    assert column(df, char_len("text")) == [sum(c in SYMBOLS for c in t) for t in TEXTS]
    assert column(df, drop_out_of_vocab("text"))[2] == "A"


def test_null_text_gives_null_ids(spark, coder):
    df = spark.createDataFrame([(0, None), (1, "a")], "id int, text string")
    assert column(df, char_encode("text"))[0] is None
    assert column(df, coder.encode("text"))[0] is None
    assert column(df, is_rejected("text")) == [True, False]


def test_bpe_equals_plain_encoder(spark, coder, plain):
    got = column(frame(spark, TEXTS), coder.encode("text"))
    assert got == [plain.encode_ordinary(t) for t in TEXTS]
    assert got[1] == [15496, 995] and plain.n_vocab == EOT_ID + 1


def test_bpe_round_trip(spark, coder):
    assert column(frame(spark, TEXTS), coder.decode(coder.encode("text"))) == TEXTS


def test_special_policies(spark, coder, plain):
    df = frame(spark, TEXTS)
    assert column(df, coder.encode("text", "allow")) == [plain.encode(t, allowed_special={EOT_TEXT}) for t in TEXTS]
    refused = column(df, coder.encode("text", "error"))
    assert [r is None for r in refused] == [EOT_TEXT in t for t in TEXTS] == column(df, is_rejected("text"))
    assert [r for r in refused if r is not None] == [plain.encode(t) for t in TEXTS if EOT_TEXT not in t]
    with pytest.raises(ValueError):
        coder.encode("text", "maybe")


def test_missing_rank_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        BytePairCoder(spark, str(tmp_path / "none"))


def test_ids(spark):
    df = spark.createDataFrame([(0, []), (1, [0, 50303]), (2, [50304]), (3, [-1, 2])], "id int, ids array<int>")
    assert column(df, append_eot("ids", 9)) == [[9], [0, 50303, 9], [50304, 9], [-1, 2, 9]]
    assert column(df, token_len("ids")) == [0, 2, 1, 2]
    assert column(df, ids_in_range("ids")) == [True, True, False, False]
    wide = spark.createDataFrame([(0, [65535]), (1, [65536])], "id int, ids array<int>")
    assert column(wide, ids_in_range("ids", 1 << 20)) == [True, False]


def test_newlines(spark):
    texts = ["a\r\nb\rc\n", "\r\r\n\n", "none"]
    assert column(frame(spark, texts), normalize_newlines("text")) == ["a\nb\nc\n", "\n\n\n", "none"]


def test_html(spark):
    pages = [
        "<p>a&amp;b</p><script>x<y</script> <!-- no --> c &lt;d&gt;",
        "<html><style>p{}</style></html>",
        None,
    ]
    df = convert_markup(frame(spark, pages).withColumnRenamed("text", "markup"))
    assert column(df, F.col("text")) == ["a&b c <d>", "", None]
    assert column(df, F.col("reason")) == [None, "no text", "no source"]
    assert [r.id for r in keep_converted(df).collect()] == [0]
    assert sorted(r.id for r in conversion_rejects(df).collect()) == [1, 2]


def test_latex(spark):
    source = "\n".join(
        [
            r"\documentclass{article}",
            r"\title{Not text}",
            r"\begin{document}",
            r"\section{First}\label{sec:a} % a comment",
            r"Some \emph{very \textbf{bold}} words~here, 50\% of \cite{x}them.",
            r"\begin{itemize}",
            r"\item one",
            r"\item two",
            r"\end{itemize}",
            r"\begin{figure} dropped \end{figure}",
            r"\end{document}",
            "after",
        ]
    )
    texts = [source, r"\documentclass{a}\begin{document}\end{document}"]
    got = column(frame(spark, texts), markup_to_text("text", "latex"))
    assert got == ["# First\n\nSome very bold words here, 50% of them.\n\n- one\n\n- two", ""]
    with pytest.raises(ValueError):
        markup_to_text("text", "rtf")


@pytest.mark.parametrize(
    "text, want",
    [
        ("a(b(c)d)e", "a e"),
        ("a(b)c(d)e", "a c e"),
        ("a)b(c", "a)b(c"),
        ("a(b(c)d", "a(b d"),
        ("a(b)c)d", "a c)d"),
        ("((x)(y))", " "),
        (")(", ")("),
        ("none", "none"),
        ("", ""),
        (None, None),
    ],
)
def test_balanced_elements(spark, text, want):
    from tokenweave.functions.markup import drop_balanced

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(drop_balanced(F.col("t"), r"\(", r"\)").alias("x")).first().x == want


def test_balanced_elements_against_a_stack(spark):
    import random

    from tokenweave.functions.markup import drop_balanced

    def model(text):
        opened, pairs = [], []
        for i, c in enumerate(text):
            if c == "(":
                opened.append(i)
            elif c == ")" and opened:
                pairs.append((opened.pop(), i))
        out, i = "", 0
        ends = dict(pairs)
        while i < len(text):
            if i in ends:
                out += " "
                i = ends[i]
            else:
                out += text[i]
            i += 1
        return out

    r = random.Random(2)
    texts = ["".join(r.choice("()ab") for _ in range(r.randrange(14))) for _ in range(400)]
    df = frame(spark, texts)
    assert column(df, drop_balanced(F.col("text"), r"\(", r"\)")) == [model(t) for t in texts]


def test_numbered_entities(spark):
    from tokenweave.functions.markup import numbered_entities

    texts = ["&#65;b&#x1F600;", "&#0;&#xD800;&#1114112;", "&#;&#x;&amp;#65;", "plain"]
    assert column(frame(spark, texts), numbered_entities(F.col("text"))) == ["Ab\U0001f600", "\ufffd" * 3, "&#;&#x;&amp;#65;", "plain"]
