"""The registered queries again, as SQL for a single-node engine over the same tables.

These statements define the expected results with plain windows over whole tables;
they share no code with the operators.
"""

from __future__ import annotations

from tokenweave.plans.queries import (
    ACC,
    BATCH,
    BYTES,
    CHUNK,
    EOT,
    EPOCHS,
    FRACTION,
    IDS,
    LENGTH,
    LONG,
    SHARDS,
    WORLD,
    YEARS,
)

# The prime and the additions of the permutation.
PRIME = 2_147_483_647
ROUNDS = 4

SIZE = BATCH  # the accumulation steps divide over the ranks, the batch size stays


def _clean(text: str = "text") -> str:
    return rf"regexp_replace({text}, '[^\n -~]', '', 'g')"


def _ids(text: str = "text") -> str:
    kept = _clean(text)
    return (
        f"CASE WHEN {kept} = '' THEN []::INT[] ELSE list_transform(string_split({kept}, ''), "
        "lambda c: CASE WHEN c = chr(10) THEN 0 ELSE ascii(c) - 31 END) END"
    )


# What the conversion is to do, spelled for a linear-time regex engine.
WHITE_SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PAGE_STEPS = [
    *[(f"(?is)<{name}[^>]*>.*?</{name}>", " ") for name in ("script", "style")],
    ("(?s)<!--.*?-->", " "),
    ("<[^>]*>|&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&amp;", "&"),
    (r"[\t\n\r ]+", " "),
]
TEX_STEPS = [
    (r"(?s)^.*\\begin[{]document[}]", ""),
    (r"(?s)\\end[{]document[}].*$", ""),
    (r"(?m)(^|[^\\])%[^\n]*$", r"\1"),
    *[
        (rf"(?s)\\begin[{{]{name}[*]?[}}].*?\\end[{{]{name}[*]?[}}]", " ")
        for name in ("tabular", "picture", "figure", "table", "thebibliography")
    ],
    (r"\\(?:chapter|(?:sub){0,2}section|paragraph)[*]?[{]([^{}]*)[}]", "\n\n# \\1\n\n"),
    (r"\\item\b *", "\n- "),
    (r"\\(?:begin|end)[{][^{}]*[}](?:\[[^\[\]]*\])?", "\n"),
    (r"\\par\b", "\n\n"),
    (r"\\\\(?:\[[^\[\]]*\])?", "\n"),
    (
        r"\\(?:label|ref|eqref|cite|bibliographystyle|bibliography|usepackage|[vh]space|input|include)[*]?"
        r"(?:\[[^\[\]]*\])?[{][^{}]*[}]",
        "",
    ),
    *2 * [(r"\\[A-Za-z]+[*]?(?:\[[^\[\]]*\])?[{]([^{}]*)[}]", r"\1")],
    (r"\\[A-Za-z]+[*]?", ""),
    (r"\\([#$%&_{}])", r"\1"),
    ("[{}]", ""),
    (r"[~\t ]+", " "),
    (" ?\n ?", "\n"),
    ("\n\n\n+", "\n\n"),
    (r"\A[ \n]+|[ \n]+\z", ""),
]


def _replaced(steps: list, column: str) -> str:
    """Nested replacements."""
    out = column
    for pattern, new in steps:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), new)
    return out


def _split(fraction: float = FRACTION, size: str = f"length({_clean()})") -> str:
    return f"""docs AS (
  SELECT *, substr(md5('2357:' || doc_id), 1, 15) AS k, ({size})::BIGINT + 1 AS n FROM documents),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY k, doc_id) - 1 AS r, count(*) OVER () AS total FROM docs),
parts AS (
  SELECT *, CASE WHEN r < ceil({fraction}::DOUBLE * total) THEN 'val' ELSE 'train' END AS split FROM ranked),
placed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY k, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM parts)"""


def _stream(parts: str, ids: str, eot: int) -> str:
    return f"""{parts},
tokens AS (
  SELECT split, start + unnest(range(n)) AS p, unnest(list_append({ids}, {eot})) AS id FROM placed),
pairs AS (
  SELECT split, p, p // {LENGTH} AS seq_id, id AS x, lead(id) OVER (PARTITION BY split ORDER BY p) AS y,
    (max(p) OVER (PARTITION BY split)) // {LENGTH} AS sequences FROM tokens),
kept AS (SELECT * FROM pairs WHERE seq_id < sequences)"""


STREAM = _stream(_split(), _ids(), EOT)
BYTE_IDS = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INT)"
BYTE_STREAM = _stream(_split(size="octet_length(encode(text))"), BYTE_IDS, BYTES)

TRAIN_IDS = f"""{_split()},
counted AS (SELECT greatest(0, (sum(n)::BIGINT - 1) // {LENGTH}) AS sequences FROM parts WHERE split = '{{split}}'),
seqs AS (SELECT unnest(range(sequences)) AS seq_id FROM counted)"""


def _key(addition: int, k: int) -> str:
    return f"(('0x' || substr(md5('1337:' || epoch || ':{addition}'), {8 * k + 1}, 8))::BIGINT % {PRIME})"


def _added(digit: str, other: str, radix: str, addition: int) -> str:
    """One addition of the permutation's rounds, in columns l and r."""
    mixed = f"(({other} * {_key(addition, 0)} + {_key(addition, 1)}) % {PRIME})"
    noise = f"({mixed} * {mixed} % {PRIME} + {mixed} * {_key(addition, 2)} % {PRIME} + {_key(addition, 1)}) % {PRIME}"
    return f"({digit} + {noise}) % {radix}"


def _rounds(source: str, x: str) -> str:
    """``x`` of ``source`` once through the rounds."""
    found = f"SELECT * EXCLUDE (x), {x} // low AS l, {x} % low AS r FROM {source}"
    for i in range(ROUNDS):
        found = f"SELECT * REPLACE ({_added('l', 'r', 'high', 2 * i)} AS l) FROM ({found})"
        found = f"SELECT * REPLACE ({_added('r', 'l', 'low', 2 * i + 1)} AS r) FROM ({found})"
    return f"SELECT epoch, seq_id, n, high, low, l * low + r AS x FROM ({found})"


def _order(split: str = "train", epochs: int = EPOCHS) -> str:
    return f"""RECURSIVE {TRAIN_IDS.format(split=split)},
runs AS (SELECT unnest(range({epochs})) AS epoch, seq_id, sequences AS n,
  ceil(sqrt(sequences::DOUBLE))::BIGINT AS high FROM seqs, counted),
digits AS (SELECT *, (n + high - 1) // high AS low, seq_id AS x FROM runs),
walk AS ({_rounds("digits", "x")} UNION ALL {_rounds("(SELECT * FROM walk WHERE x >= n)", "x")}),
ordered AS (SELECT epoch, seq_id, n, x AS pos FROM walk WHERE x < n)"""


def _dealt(split: str = "train", epochs: int = EPOCHS, world: int = WORLD) -> str:
    return f"""{_order(split, epochs)},
sized AS (SELECT *, (n + {world} - 1) // {world} AS per_rank FROM ordered),
slots AS (SELECT *, unnest(range(pos, per_rank * {world}, n)) AS place FROM sized),
dealt AS (SELECT epoch, seq_id, per_rank, (place % {world})::INT AS rank, place // {world} AS i FROM slots),
batched AS (
  SELECT *, i // {SIZE} AS batch_id, (i % {SIZE})::INT AS slot, (per_rank + {SIZE} - 1) // {SIZE} AS batches
  FROM dealt)"""


RANK_ACC = ACC // WORLD
SCHEDULE = f"""{_dealt()},
run AS (SELECT {3 * EPOCHS - 2} * sequences // {3 * BATCH * WORLD} AS iterations FROM counted),
schedule AS (
  SELECT *, epoch * batches + batch_id AS substep, (epoch * batches + batch_id) // {RANK_ACC} AS itr,
    ((epoch * batches + batch_id) % {RANK_ACC})::INT AS micro
  FROM batched, run WHERE epoch * batches + batch_id < iterations * {RANK_ACC})"""

SCORED = f"""{STREAM},
counts AS (SELECT x, y, count(*) AS c FROM kept WHERE split = 'train' GROUP BY x, y),
inputs AS (SELECT x, sum(c) AS c_x FROM counts GROUP BY x),
best AS (SELECT x, y AS pred FROM (
  SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS place FROM counts) WHERE place = 1),
val AS (SELECT seq_id // {BATCH} AS batch_id, x, y FROM kept WHERE split = 'val'),
scored AS (
  SELECT batch_id, val.y AS target, coalesce(pred, 0) AS pred,
    -ln((coalesce(c, 0) + 1) / (coalesce(c_x, 0) + {IDS})::DOUBLE) AS nll
  FROM val LEFT JOIN counts ON val.x = counts.x AND val.y = counts.y
  LEFT JOIN inputs ON val.x = inputs.x LEFT JOIN best ON val.x = best.x)"""

PAGE_TEXT = f"trim({_replaced(PAGE_STEPS, 'markup')})"
LATEX_SOURCE = (
    r"""'\documentclass{article}' || chr(10) || '% draft' || chr(10) || '\begin{document}' || chr(10) ||"""
    r""" '\section{Results}\label{s}' || chr(10) ||"""
    r""" replace(text, '. ', '.\\' || chr(10) || '\textbf{see} \cite{a} ')"""
    r""" || chr(10) || '\begin{table}x & y\end{table}' || chr(10)"""
    r""" || '\begin{figure}\begin{tabular}x\end{tabular}\caption{Cap}\end{figure}' || chr(10) || '\end{document}' || chr(10)"""
)
TEX_TEXT = _replaced(TEX_STEPS, "tex")

REPORT = """count(*) AS docs, sum(n)::BIGINT AS tokens, max(n) AS longest, round(avg(n), 6) AS mean_len"""
YEAR_LIST = ", ".join(f"'{y}'" for y in YEARS)
SEGMENT = rf"[{WHITE_SPACE}]*[^{WHITE_SPACE}](?:[^\n]*[^{WHITE_SPACE}])?"


def _hex_sequences() -> str:
    """Sequences of the bytes of ``s(split, whole)``, two digits a byte."""
    return f""", n AS (SELECT split, whole, unnest(range((length(whole) // 2 - 1) // {LENGTH})) AS seq_id FROM s)
            SELECT split, seq_id, md5(substring(whole, seq_id * {2 * LENGTH} + 1, {2 * LENGTH})) AS x_md5 FROM n"""


def statements() -> dict[str, str]:
    """SQL by query name; queries that SQL cannot state are left out."""
    pack = f"""WITH {STREAM} SELECT split, seq_id, string_agg(x, ',' ORDER BY p) AS x,
            string_agg(y, ',' ORDER BY p) AS y FROM kept GROUP BY split, seq_id"""
    fetched = f"""WITH {SCHEDULE},
            tokens AS (SELECT split, start + unnest(range(n)) AS p,
              unnest(list_append({_ids()}, {EOT})) AS id FROM placed WHERE split = 'train'),
            pairs AS (SELECT p, p // {LENGTH} AS seq_id, id AS x, lead(id) OVER (ORDER BY p) AS y FROM tokens),
            packed AS (SELECT seq_id, md5(string_agg(x, ',' ORDER BY p)) AS x_md5,
              md5(string_agg(y, ',' ORDER BY p)) AS y_md5 FROM pairs GROUP BY seq_id)
            SELECT itr, micro, rank, slot, x_md5, y_md5 FROM schedule JOIN packed ON schedule.seq_id = packed.seq_id"""
    return {
        "read_documents": """SELECT doc_id AS doc_key, source, md5(text) AS text_md5,
            length(text)::BIGINT AS chars FROM documents""",
        "read_text_split": """WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
            SELECT lang, count(*) AS lines, sum(length(line) + 1)::BIGINT AS chars,
              max(length(line) + 1)::BIGINT AS longest FROM l GROUP BY lang""",
        "drop_text": f"SELECT doc_id AS doc_key, source, lang, length({_clean()})::BIGINT AS n FROM documents",
        "select_years": f"""SELECT doc_id AS doc_key, source AS year, length(text)::BIGINT AS chars
            FROM documents WHERE source IN ({YEAR_LIST})""",
        "drop_out_of_vocab": f"""SELECT doc_id AS doc_key, md5({_clean()}) AS kept_md5,
            (length(text) - length({_clean()}))::BIGINT AS dropped FROM documents""",
        "markup_to_text": f"""WITH p AS (SELECT page_id, html AS markup FROM pages)
            SELECT page_id, {PAGE_TEXT} AS text FROM p""",
        "keep_converted": f"""WITH p AS (SELECT page_id, html AS markup FROM pages),
            t AS (SELECT page_id, {PAGE_TEXT} AS text FROM p)
            SELECT page_id, length(text)::BIGINT AS chars FROM t WHERE text <> ''""",
        "conversion_rejects": rf"""WITH p AS (
              SELECT page_id, 0 AS variant, html AS markup FROM pages UNION ALL
              SELECT page_id, 1, regexp_replace(html, '>[^<]*', '>', 'g') FROM pages),
            t AS (SELECT page_id, variant, {PAGE_TEXT} AS text FROM p)
            SELECT page_id, variant, 'no text' AS reason FROM t WHERE text = ''""",
        "latex_to_text": f"""WITH s AS (SELECT doc_id, {LATEX_SOURCE} AS tex FROM documents)
            SELECT doc_id AS doc_key, md5({TEX_TEXT}) AS text_md5 FROM s""",
        # The sources as they are once what balances is a space, and characters stand for themselves.
        "nested_markup": rf"""WITH p AS (SELECT page_id, '<div>a<div>b Hi😀� ' || html || '</div>c</div> g<style>h' AS markup FROM pages),
            t AS (SELECT doc_id, '\begin{{document}} A ' || text || ' B C\end{{picture}}D\begin{{table}}E\end{{document}}' AS tex
              FROM documents)
            SELECT 'html' AS dialect, page_id AS key, md5({PAGE_TEXT}) AS text_md5 FROM p UNION ALL
            SELECT 'latex', doc_id, md5({TEX_TEXT}) FROM t""",
        "normalize_newlines": """SELECT doc_id AS doc_key, (length(text) + CASE WHEN lang = 'en'
              THEN length(text) - length(replace(text, chr(10), '')) ELSE 0 END)::BIGINT AS raw_chars,
            md5(text) AS text_md5 FROM documents""",
        "random_split": f"""WITH {_split()} SELECT doc_id AS doc_key, split,
            ('0x' || k)::BIGINT AS order_key FROM parts""",
        "random_split_default": f"""WITH {_split(0.0005)} SELECT split, count(*) AS docs,
            sum(doc_id)::BIGINT AS key_sum FROM parts GROUP BY split""",
        "modulo_split": """WITH d AS (SELECT doc_id AS doc_key, source,
              row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
            SELECT *, CASE WHEN i % 10 <= 6 THEN 'train' WHEN i % 10 <= 8 THEN 'val' ELSE 'test' END AS split FROM d""",
        "document_index": """SELECT doc_id AS doc_key, source,
            row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents""",
        "offset_split": """WITH d AS (SELECT doc_id, text, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id) AS e,
              floor(0.8::DOUBLE * sum(length(text)) OVER ()) AS cut FROM documents),
            h AS (SELECT doc_id, text, n, greatest(0, least(n, cut - (e - n)))::BIGINT AS head FROM d),
            pieces AS (SELECT doc_id, 'train' AS split, substring(text, 1, head) AS piece FROM h UNION ALL
              SELECT doc_id, 'val', substring(text, head + 1) FROM h)
            SELECT doc_id AS doc_key, split, md5(piece) AS piece_md5, length(piece)::BIGINT AS chars
            FROM pieces WHERE piece <> ''""",
        "file_split": """SELECT doc_id AS doc_key, lang, CASE WHEN lang = 'de' THEN 'val' ELSE 'train' END AS split
            FROM documents WHERE lang IN ('en', 'fr', 'de')""",
        "char_encode": f"SELECT doc_id AS doc_key, array_to_string({_ids()}, ',') AS ids FROM documents",
        "char_decode": f"SELECT doc_id AS doc_key, {_clean()} AS text FROM documents",
        "append_eot": f"""SELECT doc_id AS doc_key, length({_clean()})::BIGINT + 1 AS n, {EOT}::INT AS last_id
            FROM documents""",
        "token_len": f"SELECT doc_id AS doc_key, length({_clean()})::BIGINT AS n FROM documents",
        "byte_encode": f"""SELECT doc_id AS doc_key, array_to_string({BYTE_IDS}, ',') AS ids,
            octet_length(encode(text))::BIGINT AS n FROM documents""",
        "byte_pack_sequences": f"""WITH {BYTE_STREAM} SELECT split, seq_id, md5(string_agg(x, ',' ORDER BY p)) AS x_md5,
            md5(string_agg(y, ',' ORDER BY p)) AS y_md5 FROM kept GROUP BY split, seq_id""",
        "bpe_round_trip": "SELECT doc_id AS doc_key, md5(text) AS text_md5 FROM documents",
        "bpe_special_policy": """WITH d AS (SELECT documents.doc_id, coalesce(toxic, 0) AS toxic,
              coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)
            SELECT doc_id AS doc_key, toxic = 1 OR quality = 1 AS rejected, toxic = 1 OR quality = 1 AS refused,
              0::BIGINT AS specials_ordinary,
              CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 ELSE 0 END::BIGINT AS specials_allow FROM d""",
        "safe_segments": f"""WITH w AS (SELECT lang, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS whole
              FROM documents GROUP BY lang),
            s AS (SELECT lang, regexp_extract_all(whole, '{SEGMENT}') AS filled, whole FROM w),
            a AS (SELECT lang, list_append(filled, regexp_extract(whole, '[{WHITE_SPACE}]*$')) AS texts FROM s),
            u AS (SELECT lang, unnest(range(len(texts))) AS segment, unnest(texts) AS text FROM a)
            SELECT lang, segment, md5(text) AS text_md5, length(text)::BIGINT AS chars FROM u WHERE text <> ''""",
        "cut_long_texts": f"""SELECT doc_id AS doc_key, md5(text) AS text_md5, 0::BIGINT AS unsafe_cuts,
            1::BIGINT AS last_pieces, length(text) > {LONG} AND
              regexp_matches(text, '[^{WHITE_SPACE}][{WHITE_SPACE}]') AS was_cut FROM documents""",
        "check_id_range": f"""WITH {_split()} SELECT split, count(*) AS docs,
            sum(contains(text, '~')::BIGINT)::BIGINT AS bad_docs FROM parts GROUP BY split""",
        "token_offsets": f"WITH {_split()} SELECT doc_id AS doc_key, split, n, start FROM placed",
        "token_offsets_natural": f"""WITH d AS (SELECT doc_id, source, length({_clean()})::BIGINT AS n FROM documents)
            SELECT doc_id AS doc_key, source, n, (sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n)::BIGINT AS start
            FROM d""",
        "global_rank": f"WITH {_split()} SELECT doc_id AS doc_key, r AS pos FROM ranked",
        "contiguous_shard": f"""WITH {_split()}, g AS (
              SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY k, doc_id) - 1 AS i,
                count(*) OVER (PARTITION BY split) AS c FROM parts),
            b AS (SELECT split, c, least({SHARDS}, c) AS shards FROM g GROUP BY split, c),
            s AS (SELECT split, c, shards, unnest(range(shards)) AS shard FROM b),
            e AS (SELECT split, shard, shard * (c // shards) + least(shard, c % shards) AS low,
              (shard + 1) * (c // shards) + least(shard + 1, c % shards) AS high FROM s)
            SELECT g.doc_id AS doc_key, g.split, e.shard::INT AS shard FROM g JOIN e
            ON g.split = e.split AND g.i >= e.low AND g.i < e.high""",
        "pack_sequences": pack,
        "shard_sequences": pack,
        "shift_targets": f"""WITH {STREAM} SELECT split, seq_id, arg_min(x, p) AS first_x, arg_min(y, p) AS first_y,
            arg_max(y, p) AS last_y FROM kept GROUP BY split, seq_id""",
        "stream_length": f"WITH {_split()} SELECT split, sum(n)::BIGINT AS tokens FROM parts GROUP BY split",
        "corpus_report": f"WITH {_split()} SELECT source, split, {REPORT} FROM parts GROUP BY source, split",
        "quality_report": f"""WITH {_split()} SELECT quality, split, {REPORT} FROM parts LEFT JOIN labels
            ON parts.doc_id = labels.doc_id GROUP BY quality, split""",
        "sequence_count": f"""WITH {_split()} SELECT split, sum(n)::BIGINT AS tokens,
            greatest(0, (sum(n)::BIGINT - 1) // {LENGTH}) AS sequences FROM parts GROUP BY split""",
        "batches_per_epoch": f"""WITH {_split()}, c AS (SELECT split,
              greatest(0, (sum(n)::BIGINT - 1) // {LENGTH}) AS sequences FROM parts GROUP BY split)
            SELECT split, sequences, ((sequences + {WORLD - 1}) // {WORLD} + {BATCH - 1}) // {BATCH} AS batches FROM c""",
        "bigram_counts": f"""WITH {STREAM} SELECT x, y, count(*) AS c FROM kept WHERE split = 'train' GROUP BY x, y""",
        "score_pairs": f"""WITH {SCORED} SELECT batch_id, target, pred, count(*) AS m, round(sum(nll), 5) AS nll
            FROM scored GROUP BY batch_id, target, pred""",
        "match_targets": f"""WITH {SCORED} SELECT batch_id, count(*) AS pairs,
            sum((pred = target)::BIGINT)::BIGINT AS hits FROM scored GROUP BY batch_id""",
        "eval_metrics": f"""WITH {SCORED}, b AS (SELECT batch_id, avg(nll) AS loss, avg((pred = target)::INT) AS acc
              FROM scored GROUP BY batch_id)
            SELECT count(*) AS n_batches, round(avg(loss), 6) AS loss, round(avg(acc), 6) AS acc,
              round(pow(2.71828::DOUBLE, avg(loss)), 6) AS perplexity FROM b""",
        "drop_ignored_targets": f"""WITH {SCORED} SELECT batch_id, round(avg(CASE WHEN target <> 0 THEN nll END), 6) AS loss,
            round(avg((target <> 0 AND pred = target)::INT), 6) AS acc FROM scored GROUP BY batch_id""",
        "next_token_candidates": f"""WITH {STREAM},
            counts AS (SELECT x, y, count(*) AS c FROM kept WHERE split = 'train' GROUP BY x, y),
            top AS (SELECT *, rank() OVER (PARTITION BY x ORDER BY c DESC) AS place FROM counts),
            s AS (SELECT x, y, c, pow(c::DOUBLE, 1 / 0.9::DOUBLE) AS w FROM top WHERE place <= 5)
            SELECT x, y, c, round(w / sum(w) OVER (PARTITION BY x), 6) AS prob FROM s""",
        "epoch_permutation": f"WITH {_order(epochs=1)} SELECT seq_id, pos FROM ordered",
        "reshuffle": f"WITH {_order()} SELECT epoch, seq_id, pos FROM ordered",
        "sequence_at": f"WITH {_order()} SELECT epoch, pos, seq_id FROM ordered",
        "rank_shard": f"WITH {_dealt()} SELECT epoch, rank, i, seq_id FROM dealt",
        "batch_assign": f"WITH {_dealt()} SELECT epoch, rank, batch_id, slot, seq_id FROM batched",
        "step_schedule": f"WITH {SCHEDULE} SELECT itr, micro, substep, epoch, batch_id, rank, slot, seq_id FROM schedule",
        "resume_from": f"""WITH {SCHEDULE} SELECT itr, epoch, batch_id, rank, slot, seq_id FROM schedule
            WHERE itr >= iterations // 2""",
        "eval_window": f"""WITH {_dealt("val", 1, 1)}, e AS (SELECT unnest(range(5)) AS eval_id),
            v AS (SELECT DISTINCT batches FROM batched),
            reads AS (SELECT eval_id, least((eval_id + 1) * 100, 450) AS eval_itr, batches,
              unnest(range(CASE WHEN eval_id < 4 THEN 5 ELSE batches END)) AS t FROM e, v)
            SELECT eval_id, eval_itr, t, batch_id, slot, seq_id FROM reads JOIN batched
            ON batched.batch_id = (5 * eval_id + t) % reads.batches""",
        "fetch_batches": fetched,
        "fetch_from_shards": fetched,
        "token_offsets_by_date": """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS day,
              length(o_orderpriority)::BIGINT AS n FROM orders)
            SELECT * EXCLUDE (day), (sum(n) OVER (PARTITION BY o_orderstatus ORDER BY day, o_orderkey) - n)::BIGINT AS start
            FROM o""",
        "global_rank_by_amount": """SELECT o_orderkey,
            row_number() OVER (ORDER BY o_totalprice::DECIMAL(15, 2), o_orderkey) - 1 AS pos FROM orders""",
        "random_split_repeated_keys": f"""WITH t AS (SELECT count(*) AS n, ceil({FRACTION}::DOUBLE * count(*))::BIGINT AS v
              FROM documents)
            SELECT 'val' AS split, v AS docs FROM t UNION ALL SELECT 'train', n - v FROM t""",
        "archive_members": """SELECT CASE lang WHEN 'en' THEN 'en.tar' WHEN 'de' THEN 'de.tar.gz'
              WHEN 'fr' THEN 'fr-packed.zip' ELSE 'other-stored.zip' END AS archive,
            'docs/' || lpad(doc_id::VARCHAR, 12, '0') AS member,
            CASE lang WHEN 'de' THEN 'stream' WHEN 'fr' THEN 'packed' ELSE 'stored' END AS kind,
            octet_length(encode(text))::BIGINT AS size FROM documents""",
        "expand_archives": "SELECT doc_id AS doc_key, md5(text) AS text_md5 FROM documents",
        "read_document_files": f"""SELECT (doc_id % 3 + 1999)::INT AS year,
            (doc_id % 3 + 1999) || '/' || lpad(doc_id::VARCHAR, 12, '0') || '.md' AS doc_key, md5(text) AS text_md5
            FROM documents""",
        "recipe_wiki": f"""WITH s AS (SELECT CASE lang WHEN 'en' THEN 'train' ELSE 'val' END AS split,
              lower(hex(encode(string_agg(text || chr(10), '' ORDER BY doc_id)))) AS whole
              FROM documents WHERE lang IN ('en', 'de') GROUP BY split) {_hex_sequences()}""",
        "recipe_years": f"""WITH d AS (SELECT doc_id, text, doc_id % 3 AS y,
              row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS i FROM documents),
            s AS (SELECT CASE WHEN i % 10 <= 6 THEN 'train' WHEN i % 10 <= 8 THEN 'val' ELSE 'test' END AS split,
              lower(hex(encode(string_agg(text, '' ORDER BY (y + 1) % 3, i)))) AS whole FROM d GROUP BY split)
            {_hex_sequences()}""",
        "recipe_char": f"""WITH w AS (SELECT string_agg(text || chr(10), '' ORDER BY doc_id) AS whole FROM documents),
            c AS (SELECT whole, floor(0.8::DOUBLE * length(whole))::BIGINT AS cut FROM w),
            p AS (SELECT 'train' AS split, {_clean("substring(whole, 1, cut)")} AS part FROM c UNION ALL
              SELECT 'val', {_clean("substring(whole, cut + 1)")} FROM c),
            n AS (SELECT split, part, unnest(range((length(part) - 1) // {LENGTH})) AS seq_id FROM p)
            SELECT split, seq_id, md5(substring(part, seq_id * {LENGTH} + 1, {LENGTH})) AS x_md5 FROM n""",
        "mix_corpora": f"""WITH m AS (
              SELECT 0 AS corpus, doc_id AS key, 0::BIGINT AS turn, length({_clean()})::BIGINT AS n FROM documents UNION ALL
              SELECT 1, conv_id, turn, length({_clean()}) FROM conversations UNION ALL
              SELECT 2, item_id, 0, length({_clean()}) FROM benchmark)
            SELECT *, (sum(n) OVER (ORDER BY corpus, key, turn) - n)::BIGINT AS start FROM m""",
        "concat_years": f"""WITH y AS (SELECT unnest([{YEAR_LIST}]) AS year, unnest(range({len(YEARS)}))::INT AS part),
            d AS (SELECT part, year, doc_id AS doc_key, length({_clean()})::BIGINT AS n
              FROM documents JOIN y ON source = year)
            SELECT *, (sum(n) OVER (ORDER BY part, doc_key) - n)::BIGINT AS start FROM d""",
        "token_shards": f"""WITH {STREAM} SELECT split, p // {CHUNK} * {CHUNK} AS start, count(*) AS n,
            md5(string_agg(x, ',' ORDER BY p)) AS ids_md5 FROM pairs GROUP BY split, p // {CHUNK}""",
        "bpe_shard_documents": f"""WITH {_split()} SELECT split,
            row_number() OVER (PARTITION BY split ORDER BY k, doc_id) - 1 AS i, md5(text) AS text_md5 FROM parts""",
        "materialize_once": f"""WITH {_split()} SELECT split, count(*) AS docs, sum(n)::BIGINT AS tokens,
            sum(n)::BIGINT AS ids FROM parts GROUP BY split""",
        "token_offsets_null_group": f"""WITH d AS (SELECT quality, documents.doc_id AS doc_key, length({_clean()})::BIGINT AS n
              FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)
            SELECT *, (sum(n) OVER (PARTITION BY quality ORDER BY doc_key) - n)::BIGINT AS start FROM d""",
        "recipe_rejects": """SELECT doc_id::VARCHAR AS doc_key, 'no text' AS reason
            FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""",
        "random_split_text_only": f"""WITH t AS (SELECT count(*) AS n FROM documents)
            SELECT 'val' AS split, ceil({FRACTION}::DOUBLE * n)::BIGINT AS docs, ceil({FRACTION}::DOUBLE * n)::BIGINT AS names FROM t
            UNION ALL SELECT 'train', n - ceil({FRACTION}::DOUBLE * n)::BIGINT, n - ceil({FRACTION}::DOUBLE * n)::BIGINT FROM t""",
        "pin": f"WITH {_split()} SELECT split, {REPORT} FROM parts GROUP BY split",
    }
