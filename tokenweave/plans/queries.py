"""The registered queries: each operator over the whole fixture tables.

Character ids stand for tokens wherever a SQL engine is to check the result; the
end-of-text id is then the first id behind the character vocabulary.
"""

from __future__ import annotations

import base64
import io
import itertools
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.functions.bpe import BytePairCoder, EOT_TEXT, is_rejected
from tokenweave.functions.chars import VOCAB_SIZE, char_decode, char_encode, char_len, drop_out_of_vocab
from tokenweave.functions.ids import append_eot, token_len
from tokenweave.functions.markup import (
    conversion_rejects,
    convert_markup,
    keep_converted,
    markup_to_text,
    normalize_newlines,
)
from tokenweave.functions.numbers import ceil_div, div
from tokenweave.operators.mix import concat_years, mix_corpora, select_years
from tokenweave.operators.order import (
    contiguous_shard,
    document_index,
    global_rank,
    hash_order,
    ordered_sums,
    token_offsets,
)
from tokenweave.operators.pack import pack_sequences, pack_windows, shift_targets
from tokenweave.operators.report import (
    batches_per_epoch,
    corpus_report,
    id_range_violations,
    sequence_counts,
    stream_length,
)
from tokenweave.operators.sampling import (
    batch_assign,
    epoch_order,
    eval_window,
    fetch_batches,
    rank_batch_plan,
    rank_shard,
    resume_from,
    sequence_at,
    step_schedule,
)
from tokenweave.operators.scoring import (
    batch_metrics,
    batch_pairs,
    bigram_counts,
    eval_metrics,
    match_targets,
    next_token_candidates,
    score_pairs,
    token_pairs,
)
from tokenweave.operators.segments import WHITE_SPACE, cut_long_texts, safe_segments
from tokenweave.operators.splits import file_split, modulo_split, offset_split, random_split
from tokenweave.plans.corpora import corpus, stream_order, web_rejects, year_corpus
from tokenweave.sinks.materialize import materialize_once, pin
from tokenweave.sinks.token_shards import write_token_shards
from tokenweave.session import default_buckets, scratch_path, spread, stage, task_count
from tokenweave.sources.documents import (
    archive_members,
    decoded_members,
    expand_archives,
    read_document_files,
    read_documents,
    read_text_split,
)
from tokenweave.sources.files import filesystem
from tokenweave.sources.token_shards import fetch_sequences, read_sequences, read_token_shards

LENGTH = 256
EOT = VOCAB_SIZE
BYTES = 256
IDS = VOCAB_SIZE + 1
FRACTION = 0.05
BATCH = 8
WORLD = 4
ACC = 4
EPOCHS = 2
SHARDS = 16
CHUNK = 4096
LONG = 1000
SHELF = 1 << 14
ROWS = 500
YEARS = ["src7", "src3", "src14"]
HASHED = ["order_key", "doc_key"]


def joined(ids: Column | str) -> Column:
    """Ids as one comparable string."""
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(col.cast("array<string>"), ",")


def documents(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return read_documents(spark, f"{sf}/documents.parquet", key="doc_id", extra=extra)


def texts(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Documents for text work, spread over the cores where the table is one small file."""
    return spread(documents(spark, sf, *extra), "doc_key")


def split_documents(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Documents with split, order key and ``n``; the ids themselves come later."""
    parts = spread(random_split(documents(spark, sf, *extra), fraction=FRACTION), "doc_key")
    return parts.withColumn("n", char_len("text") + 1)


def char_ids() -> Column:
    return append_eot(char_encode("text"), EOT)


def windows(spark: SparkSession, sf: str) -> DataFrame:
    offsets = token_offsets(split_documents(spark, sf), HASHED, hashed=True)
    return pack_windows(offsets, LENGTH, ids=char_ids())


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return shift_targets(windows(spark, sf), LENGTH)


def sequence_total(spark: SparkSession, sf: str, split: str = "train") -> int:
    """Sequences of a split, from its token count."""
    light = split_documents(spark, sf).where(F.col("split") == split)
    return sequence_counts(light, LENGTH, groups=()).first()["sequences"] or 0


def sequence_ids(spark: SparkSession, sf: str, split: str = "train") -> DataFrame:
    """``seq_id`` of all sequences of a split."""
    return spark.range(sequence_total(spark, sf, split)).withColumnRenamed("id", "seq_id")


# --- sources, projections, filters ---------------------------------------------------


def q_read_documents(spark, sf):
    return documents(spark, sf).select(
        "doc_key", "source", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars")
    )


def q_read_text_split(spark, sf):
    out = scratch_path(spark, "text-files")
    texts(spark, sf, "lang").select("lang", "text").write.partitionBy("lang").text(out)
    lines = read_text_split(spark, out)
    lang = F.regexp_extract("file", "lang=([^/]*)/", 1).alias("lang")
    return lines.groupBy(lang).agg(
        F.count("*").alias("lines"),
        F.sum(F.length("text")).cast("long").alias("chars"),
        F.max(F.length("text")).cast("long").alias("longest"),
    )


def q_drop_text(spark, sf):
    return texts(spark, sf, "lang").withColumn("n", char_len("text")).drop("text")


def q_select_years(spark, sf):
    docs = documents(spark, sf).withColumnRenamed("source", "year")
    known = [f"src{i}" for i in range(20)]
    return select_years(docs, YEARS, known).select("doc_key", "year", F.length("text").cast("long").alias("chars"))


def q_drop_out_of_vocab(spark, sf):
    kept = drop_out_of_vocab("text")
    return texts(spark, sf).select(
        "doc_key", F.md5(kept).alias("kept_md5"), (F.length("text") - F.length(kept)).cast("long").alias("dropped")
    )


def _pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("html").alias("markup"))
    return convert_markup(spread(pages, "page_id"))


def q_markup_to_text(spark, sf):
    return _pages(spark, sf).select("page_id", "text")


def q_keep_converted(spark, sf):
    return keep_converted(_pages(spark, sf)).select("page_id", F.length("text").cast("long").alias("chars"))


def q_conversion_rejects(spark, sf):
    # Pages cut to their markup alone have nothing to convert, as scripts and styles have not.
    bare = spark.read.parquet(f"{sf}/pages.parquet").select(
        "page_id", F.regexp_replace("html", r"(?s)>[^<]*", ">").alias("markup")
    )
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("html").alias("markup"))
    both = mix_corpora([pages, bare], out="variant")
    return conversion_rejects(convert_markup(both)).select("page_id", "variant", "reason")


def q_latex_to_text(spark, sf):
    tex = F.concat(
        F.lit("\\documentclass{article}\n% draft\n\\begin{document}\n\\section{Results}\\label{s}\n"),
        F.replace("text", F.lit(". "), F.lit(".\\\\\n\\textbf{see} \\cite{a} ")),
        F.lit("\n\\begin{table}x & y\\end{table}\n"
            "\\begin{figure}\\begin{tabular}x\\end{tabular}\\caption{Cap}\\end{figure}\n\\end{document}\n"),
    )
    return texts(spark, sf).select("doc_key", F.md5(markup_to_text(tex, "latex")).alias("text_md5"))


NESTED_PAGE = ("<div>a<div>b &#72;&#x69;&#128512;&#0; ", "</div>c</div><STYLE x='1'>d<style>e</style >f</style>g<style>h")
NESTED_TEX = (
    "\\begin{document}\\begin{table}a\\begin{table*}b\\begin{tabular}c\\end{tabular}\\end{table*}d\\end{table}A ",
    " B\\begin{figure}\\begin{figure}e\\end{figure}\\caption{f}\\end{figure}C\\end{picture}D\\begin{table}E\\end{document}",
)


def q_nested_markup(spark, sf):
    """Elements within elements of their own name, tags without a counterpart, characters by number."""
    pages = spread(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").select(
        "page_id", F.concat(F.lit(NESTED_PAGE[0]), "html", F.lit(NESTED_PAGE[1])).alias("html")
    )
    html = pages.select(F.lit("html").alias("dialect"), F.col("page_id").alias("key"), F.md5(markup_to_text("html")).alias("text_md5"))
    tex = F.concat(F.lit(NESTED_TEX[0]), "text", F.lit(NESTED_TEX[1]))
    latex = texts(spark, sf).select(
        F.lit("latex").alias("dialect"), F.col("doc_key").alias("key"), F.md5(markup_to_text(tex, "latex")).alias("text_md5")
    )
    return html.unionByName(latex)


def q_normalize_newlines(spark, sf):
    ends = F.when(F.col("lang") == "en", "\r\n").when(F.col("lang") == "de", "\r").otherwise("\n")
    foreign = texts(spark, sf, "lang").withColumn("raw", F.replace("text", F.lit("\n"), ends))
    return foreign.select(
        "doc_key",
        F.length("raw").cast("long").alias("raw_chars"),
        F.md5(normalize_newlines("raw")).alias("text_md5"),
    )


# --- splits --------------------------------------------------------------------------


def q_random_split(spark, sf):
    return random_split(documents(spark, sf), fraction=FRACTION).select("doc_key", "split", "order_key")


def q_random_split_default(spark, sf):
    parts = random_split(documents(spark, sf))
    return parts.groupBy("split").agg(F.count("*").alias("docs"), F.sum("doc_key").alias("key_sum"))


def q_modulo_split(spark, sf):
    return modulo_split(documents(spark, sf), "source").select("doc_key", "source", "i", "split")


def q_document_index(spark, sf):
    return document_index(documents(spark, sf), "source", ["doc_key"]).select("doc_key", "source", "i")


def q_offset_split(spark, sf):
    pieces = offset_split(texts(spark, sf), ["doc_key"])
    return pieces.select(
        "doc_key", "split", F.md5("text").alias("piece_md5"), F.length("text").cast("long").alias("chars")
    )


def q_file_split(spark, sf):
    rules = {"en": "train", "fr": "train", "de": "val"}
    return file_split(documents(spark, sf, "lang"), F.col("lang"), rules).select("doc_key", "lang", "split")


# --- text, ids, text -----------------------------------------------------------------


def q_char_encode(spark, sf):
    ids = texts(spark, sf).select("doc_key", char_encode("text").alias("ids"))
    return ids.select("doc_key", joined("ids").alias("ids"))


def q_char_decode(spark, sf):
    ids = texts(spark, sf).withColumn("ids", char_encode("text"))
    return ids.select("doc_key", char_decode("ids").alias("text"))


def q_append_eot(spark, sf):
    ids = texts(spark, sf).withColumn("ids", char_ids())
    return ids.select("doc_key", token_len("ids").alias("n"), F.element_at("ids", -1).alias("last_id"))


def q_token_len(spark, sf):
    return texts(spark, sf).select("doc_key", token_len(char_encode("text")).alias("n"))


def q_bpe_round_trip(spark, sf):
    coder = BytePairCoder(spark)
    decoded = texts(spark, sf).withColumn("decoded", coder.decode(coder.encode("text")))
    return decoded.select("doc_key", F.md5("decoded").alias("text_md5"))


def q_bpe_encode(spark, sf):
    ids = texts(spark, sf).withColumn("ids", BytePairCoder(spark).encode("text"))
    return ids.select("doc_key", "ids", token_len("ids").alias("n"))


def byte_coder(spark: SparkSession) -> BytePairCoder:
    """The vocabulary of the 256 bytes, whose ids a SQL engine can state; the end of text is id 256."""
    ranks = b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(BYTES))
    return BytePairCoder(spark, ranks, eot=BYTES)


def q_byte_encode(spark, sf):
    ids = texts(spark, sf).withColumn("ids", byte_coder(spark).encode("text"))
    return ids.select("doc_key", joined("ids").alias("ids"), token_len("ids").alias("n"))


def q_bpe_special_policy(spark, sf):
    coder = BytePairCoder(spark)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("doc_key"), "quality", "toxic")
    marked = F.when(F.col("toxic") == 1, F.concat("text", F.lit(EOT_TEXT)))
    marked = marked.when(F.col("quality") == 1, F.concat(F.lit(EOT_TEXT), "text", F.lit(EOT_TEXT)))
    docs = texts(spark, sf).join(labels, "doc_key", "left").withColumn("text", marked.otherwise(F.col("text")))
    special = {p: coder.encode("text", p) for p in ("ordinary", "allow", "error")}

    def count(ids: str) -> Column:
        return F.size(F.filter(ids, lambda i: i == coder.eot)).cast("long")

    return docs.select("doc_key", is_rejected("text").alias("rejected"), *[c.alias(p) for p, c in special.items()]).select(
        "doc_key",
        "rejected",
        F.col("error").isNull().alias("refused"),
        count("ordinary").alias("specials_ordinary"),
        count("allow").alias("specials_allow"),
    )


def q_safe_segments(spark, sf):
    docs = texts(spark, sf, "lang").select("lang", "doc_key", F.split("text", "\n").alias("rows"))
    lines = docs.select("lang", "doc_key", F.posexplode("rows").alias("line_no", "text"))
    ended = lines.withColumn("text", F.concat("text", F.lit("\n")))
    segments = safe_segments(ended, "lang", ["doc_key", "line_no"])
    return segments.select(
        "lang", "segment", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars")
    )


def q_cut_long_texts(spark, sf):
    pieces = cut_long_texts(texts(spark, sf), LONG)
    # A cut is safe between a non-space and a white space; pieces may be longer only without one.
    joined_up = F.array_sort(F.collect_list(F.struct("piece", "text")))
    unsafe = (F.col("piece") > 0) & ~F.col("text").rlike(f"^[{WHITE_SPACE}]")
    return (
        pieces.groupBy("doc_key")
        .agg(
            F.array_join(F.transform(joined_up, lambda p: p["text"]), "").alias("text"),
            F.sum(unsafe.cast("long")).alias("unsafe_cuts"),
            F.sum(F.col("last").cast("long")).alias("last_pieces"),
            (F.count("*") > 1).alias("was_cut"),
        )
        .select("doc_key", F.md5("text").alias("text_md5"), "unsafe_cuts", "last_pieces", "was_cut")
    )


def q_check_id_range(spark, sf):
    # One symbol less than the vocabulary: the tilde and the end-of-text id are out of range.
    ids = split_documents(spark, sf).withColumn("ids", char_encode("text"))
    return id_range_violations(ids, VOCAB_SIZE - 1)


# --- positions -----------------------------------------------------------------------


def q_token_offsets(spark, sf):
    offsets = token_offsets(split_documents(spark, sf), HASHED, hashed=True)
    return offsets.select("doc_key", "split", "n", "start")


def q_token_offsets_natural(spark, sf):
    docs = texts(spark, sf).withColumn("n", char_len("text"))
    return token_offsets(docs, ["doc_key"], ("source",)).select("doc_key", "source", "n", "start")


def q_token_offsets_by_date(spark, sf):
    """A natural order by date: the words of orders, by status."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("day", F.col("o_orderdate").cast("date"))
    placed = orders.withColumn("n", F.length("o_orderpriority").cast("long"))
    return token_offsets(placed, ["day", "o_orderkey"], ("o_orderstatus",)).select(
        "o_orderkey", "o_orderstatus", "n", "start"
    )


def q_global_rank_by_amount(spark, sf):
    """A natural order by a decimal, largest numbers of digits first by value, not by text."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    amount = F.col("o_totalprice").cast("decimal(15,2)")
    ranked = global_rank(orders.withColumn("amount", amount), ["amount", "o_orderkey"])
    return ranked.select("o_orderkey", "pos")


def q_random_split_repeated_keys(spark, sf):
    """Ten keys for all documents: the size of the validation part holds nevertheless."""
    docs = documents(spark, sf).withColumn("doc_key", F.col("doc_key") % 10)
    return random_split(docs, fraction=FRACTION).groupBy("split").agg(F.count("*").alias("docs"))


def q_global_rank(spark, sf):
    keyed = documents(spark, sf).withColumn("order_key", hash_order(2357, "doc_key"))
    return global_rank(keyed, HASHED, hashed=True).select("doc_key", "pos")


def q_contiguous_shard(spark, sf):
    docs = random_split(documents(spark, sf), fraction=FRACTION)
    ranked = global_rank(docs, HASHED, ("split",), hashed=True)
    shard = contiguous_shard(F.col("pos"), F.col("pos_total"), SHARDS)
    return ranked.select("doc_key", "split", shard.alias("shard"))


def q_pack_sequences(spark, sf):
    return packed(spark, sf).select("split", "seq_id", joined("x").alias("x"), joined("y").alias("y"))


def q_shift_targets(spark, sf):
    ends = packed(spark, sf)
    return ends.select(
        "split",
        "seq_id",
        F.element_at("x", 1).alias("first_x"),
        F.element_at("y", 1).alias("first_y"),
        F.element_at("y", -1).alias("last_y"),
    )


def _pack_staged(spark, sf, coder: BytePairCoder) -> DataFrame:
    docs = spread(random_split(documents(spark, sf), fraction=FRACTION), "doc_key")
    docs = docs.withColumn("ids", append_eot(coder.encode("text"), coder.eot))
    tokens = stage(docs.select("split", *HASHED, "ids").withColumn("n", token_len("ids")), "bpe-tokens")
    return pack_sequences(token_offsets(tokens, HASHED, hashed=True), LENGTH)


def q_bpe_pack_sequences(spark, sf):
    return _pack_staged(spark, sf, BytePairCoder(spark))


def q_byte_pack_sequences(spark, sf):
    sequences = _pack_staged(spark, sf, byte_coder(spark))
    return sequences.select("split", "seq_id", F.md5(joined("x")).alias("x_md5"), F.md5(joined("y")).alias("y_md5"))


# --- counts --------------------------------------------------------------------------


def q_stream_length(spark, sf):
    return stream_length(split_documents(spark, sf))


def q_corpus_report(spark, sf):
    report = corpus_report(split_documents(spark, sf))
    return report.withColumn("mean_len", F.round("mean_len", 6))


def q_quality_report(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("doc_key"), "quality")
    docs = split_documents(spark, sf).drop("text").join(labels, "doc_key", "left")
    return corpus_report(docs, ("quality", "split")).withColumn("mean_len", F.round("mean_len", 6))


def q_sequence_count(spark, sf):
    return sequence_counts(split_documents(spark, sf), LENGTH)


def q_batches_per_epoch(spark, sf):
    per_rank = ceil_div(F.col("sequences"), WORLD)
    counts = sequence_counts(split_documents(spark, sf), LENGTH)
    return counts.select("split", "sequences", batches_per_epoch(per_rank, BATCH).alias("batches"))


def q_bigram_counts(spark, sf):
    return bigram_counts(token_pairs(packed(spark, sf).where(F.col("split") == "train")))


def _predictions(spark, sf):
    """Validation pairs in file order of sequences, scored under the training counts."""
    sequences = stage(packed(spark, sf), "sequences", ("split",))
    counts = bigram_counts(token_pairs(sequences.where(F.col("split") == "train")))
    val = sequences.where(F.col("split") == "val")
    batched = val.select(div(F.col("seq_id"), BATCH).alias("batch_id"), "x", "y")
    # A batch's pairs are counted in one place, and by many tasks: a split of the compressed table holds so many
    # sequences that the counts of its pairs would fill a task's memory.
    dealt = batched.repartition(default_buckets(spark, 4), "batch_id")
    pairs = batch_pairs(token_pairs(dealt, "batch_id"))
    return score_pairs(pairs, counts, IDS)


def q_score_pairs(spark, sf):
    scored = _predictions(spark, sf)
    return scored.groupBy("batch_id", "target", "pred").agg(
        F.sum("m").alias("m"), F.round(F.sum(F.col("nll") * F.col("m")), 5).alias("nll")
    )


def q_match_targets(spark, sf):
    hits = match_targets(_predictions(spark, sf))
    return hits.groupBy("batch_id").agg(
        F.sum("m").alias("pairs"), F.sum(F.col("hit") * F.col("m")).cast("long").alias("hits")
    )


def q_eval_metrics(spark, sf):
    result = eval_metrics(_predictions(spark, sf))
    return result.select("n_batches", *[F.round(c, 6).alias(c) for c in ("loss", "acc", "perplexity")])


def q_drop_ignored_targets(spark, sf):
    ignored = F.when(F.col("target") == 0, -1).otherwise(F.col("target"))
    scored = batch_metrics(_predictions(spark, sf).withColumn("target", ignored))
    return scored.select("batch_id", F.round("loss", 6).alias("loss"), F.round("acc", 6).alias("acc"))


def q_next_token_candidates(spark, sf):
    kept = next_token_candidates(q_bigram_counts(spark, sf), temperature=0.9, top_k=5)
    return kept.select("x", "y", "c", F.round("prob", 6).alias("prob"))


# --- permutations, batches, schedules ------------------------------------------------


def q_epoch_permutation(spark, sf):
    return epoch_order(sequence_ids(spark, sf)).select("seq_id", "pos")


def q_reshuffle(spark, sf):
    return epoch_order(sequence_ids(spark, sf), EPOCHS).select("epoch", "seq_id", "pos")


def q_rank_shard(spark, sf):
    return rank_shard(epoch_order(sequence_ids(spark, sf), EPOCHS), WORLD).select("epoch", "rank", "i", "seq_id")


def _batches(sequences: DataFrame) -> DataFrame:
    size, _ = rank_batch_plan(BATCH, ACC, WORLD)
    return batch_assign(rank_shard(epoch_order(sequences, EPOCHS), WORLD), size)


def q_batch_assign(spark, sf):
    return _batches(sequence_ids(spark, sf)).select("epoch", "rank", "batch_id", "slot", "seq_id")


def _schedule(spark, sf) -> tuple[DataFrame, int, int]:
    """The schedule of a run that ends a third of the way through its last epoch."""
    sequences = sequence_total(spark, sf)
    iterations = (3 * EPOCHS - 2) * sequences // (3 * BATCH * WORLD)
    _, acc = rank_batch_plan(BATCH, ACC, WORLD)
    batches = _batches(spark.range(sequences).withColumnRenamed("id", "seq_id"))
    return step_schedule(batches, iterations, acc), iterations, acc


def q_step_schedule(spark, sf):
    schedule, _, _ = _schedule(spark, sf)
    return schedule.select("itr", "micro", "substep", "epoch", "batch_id", "rank", "slot", "seq_id")


def q_resume_from(spark, sf):
    schedule, iterations, acc = _schedule(spark, sf)
    left = resume_from(schedule, iterations // 2, acc)
    return left.select("itr", "epoch", "batch_id", "rank", "slot", "seq_id")


def q_eval_window(spark, sf):
    val = batch_assign(rank_shard(epoch_order(sequence_ids(spark, sf, "val"))), BATCH)
    return eval_window(val, 450, 100, 5).select("eval_id", "eval_itr", "t", "batch_id", "slot", "seq_id")


def q_fetch_batches(spark, sf):
    schedule, _, _ = _schedule(spark, sf)
    # Inputs and targets are the same ids but one: they meet the schedule as one window, in the two bytes an id needs.
    train = windows(spark, sf).where(F.col("split") == "train").select("seq_id", F.col("t").cast("array<smallint>").alias("t"))
    batches = shift_targets(fetch_batches(schedule.select("itr", "micro", "rank", "slot", "seq_id"), train), LENGTH)
    return batches.select(
        "itr", "micro", "rank", "slot", F.md5(joined("x")).alias("x_md5"), F.md5(joined("y")).alias("y_md5")
    )


def q_sequence_at(spark, sf):
    """The inverse of the permutation, for every place of every epoch."""
    n = sequence_total(spark, sf)
    places = spark.range(n).withColumnRenamed("id", "pos")
    return sequence_at(places, n, EPOCHS).select("epoch", "pos", "seq_id")


def q_fetch_from_shards(spark, sf):
    """The scheduled sequences by their places in token files."""
    schedule, _, _ = _schedule(spark, sf)
    wanted = schedule.select("itr", "micro", "rank", "slot", "seq_id")
    batches = fetch_sequences(wanted, _shards(spark, sf), "train", LENGTH)
    return batches.select(
        "itr", "micro", "rank", "slot", F.md5(joined("x")).alias("x_md5"), F.md5(joined("y")).alias("y_md5")
    )


# --- concatenation, sinks ------------------------------------------------------------


def q_mix_corpora(spark, sf):
    first = documents(spark, sf).select(F.col("doc_key").alias("key"), F.lit(0).cast("long").alias("turn"), "text")
    second = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("key"), "turn", "text")
    third = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("key"), F.lit(0).cast("long").alias("turn"), "text"
    )
    mixed = mix_corpora([first, second, third]).withColumn("n", char_len("text")).drop("text")
    return token_offsets(mixed, ["corpus", "key", "turn"], ()).select("corpus", "key", "turn", "n", "start")


def q_concat_years(spark, sf):
    docs = documents(spark, sf).withColumnRenamed("source", "year").withColumn("n", char_len("text")).drop("text")
    placed = concat_years(docs, YEARS)
    return token_offsets(placed, ["part", "doc_key"], ()).select("part", "year", "doc_key", "n", "start")


def _shards(spark, sf) -> str:
    tokens = split_documents(spark, sf).withColumn("ids", char_ids()).select("split", *HASHED, "ids", "n")
    out = scratch_path(spark, "shards")
    write_token_shards(tokens, out, HASHED, SHARDS, hashed=True)
    return out


def q_token_shards(spark, sf):
    chunks = read_token_shards(spark, _shards(spark, sf), CHUNK)
    return chunks.select(
        "split", "start", F.size("ids").cast("long").alias("n"), F.md5(joined("ids")).alias("ids_md5")
    )


def q_shard_sequences(spark, sf):
    sequences = read_sequences(spark, _shards(spark, sf), LENGTH)
    return sequences.select("split", "seq_id", joined("x").alias("x"), joined("y").alias("y"))


def q_bpe_shard_documents(spark, sf):
    """Documents got back from their token files: the whole path, forth and back."""
    coder = BytePairCoder(spark)
    docs = spread(random_split(documents(spark, sf), fraction=FRACTION), "doc_key")
    ids = append_eot(coder.encode("text"), coder.eot)
    tokens = stage(docs.select("split", *HASHED, ids.alias("ids")).withColumn("n", token_len("ids")), "bpe-tokens")
    out = scratch_path(spark, "bpe-shards")
    write_token_shards(tokens, out, HASHED, SHARDS, hashed=True)
    chunks = read_token_shards(spark, out, CHUNK)
    # A document ends behind its end-of-text id; a chunk holds the ends of some documents.
    ends = F.filter(F.transform("ids", lambda x, i: F.when(x == coder.eot, i + 1)), lambda e: e.isNotNull())
    numbered = ordered_sums(
        chunks.withColumn("ends", ends).withColumn("closed", F.size("ends").cast("long")),
        {"doc": "closed"},
        ["start"],
        ("split",),
    )
    borders = numbered.withColumn("cuts", F.concat(F.array(F.lit(0)), "ends", F.array(F.size("ids"))))
    pieces = borders.select(
        "split",
        "start",
        "doc",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("cuts") - 1),
                lambda j: F.slice("ids", F.get("cuts", j - 1) + 1, F.get("cuts", j) - F.get("cuts", j - 1)),
            )
        ).alias("at", "piece"),
    ).where(F.size("piece") > 0)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"]))
    back = pieces.groupBy("split", (F.col("doc") + F.col("at")).alias("i")).agg(whole.alias("ids"))
    text = coder.decode(F.slice("ids", 1, F.size("ids") - 1))
    return back.select("split", "i", F.md5(text).alias("text_md5"))


def q_materialize_once(spark, sf):
    out = scratch_path(spark, "tokens")

    def build():
        return split_documents(spark, sf).withColumn("ids", char_ids()).select("split", "doc_key", "ids", "n")

    materialize_once(spark, out, build)
    again = materialize_once(spark, out, lambda: spark.createDataFrame([], build().schema))
    return again.groupBy("split").agg(
        F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum(F.size("ids")).cast("long").alias("ids")
    )


def q_pin(spark, sf):
    pinned = pin(split_documents(spark, sf).select("split", "source", "n"))
    return corpus_report(pinned, ("split",)).withColumn("mean_len", F.round("mean_len", 6))


def _labelled(spark, sf):
    return documents(spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "doc_key"), "doc_key", "left"
    )


def q_token_offsets_null_group(spark, sf):
    """Documents without a label are a group of their own."""
    docs = _labelled(spark, sf).withColumn("n", char_len("text")).drop("text")
    return token_offsets(docs, ["doc_key"], ("quality",)).select("quality", "doc_key", "n", "start")


def q_recipe_rejects(spark, sf):
    """A corpus whose toxic documents come without their text."""
    out = scratch_path(spark, "with-nulls")
    text = F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("text")).alias("text")
    _labelled(spark, sf).select("doc_key", "source", text).write.parquet(out)
    return web_rejects(spark, out)


def q_random_split_text_only(spark, sf):
    """A corpus of texts alone: rows are named by where they are stored."""
    out = scratch_path(spark, "text-only")
    documents(spark, sf).select("text").write.parquet(out)
    parts = random_split(read_documents(spark, out), fraction=FRACTION)
    return parts.groupBy("split").agg(F.count("*").alias("docs"), F.countDistinct("doc_key").alias("names"))


# --- files of any kind to streams ----------------------------------------------------


def _write_files(spark, df: DataFrame, folder: str, keep: Callable[[str], tuple[str, int]]) -> str:
    """Writes ``(name, member, text)`` below ``folder``: a file, or an archive of members, by name; one task each.

    ``keep`` gives what a name is, "text", "tar", "tar.gz" or "zip", and the compression of a zip.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(low, ROWS) for batch in batches for low in range(0, batch.num_rows, ROWS))
        rows = (r for part in parts for r in part.to_pylist())
        store, root = filesystem(folder)
        made, files = set(), 0
        for name, members in itertools.groupby(rows, lambda r: r["name"]):
            within = f"{root}/{name}".rpartition("/")[0]
            if within not in made:
                store.create_dir(within, recursive=True)
                made.add(within)
            kind, compression = keep(name)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                if kind == "text":
                    for m in members:
                        out.write(m["text"].encode())
                    files += 1
                    continue
                data = io.BytesIO()  # of one archive
                if kind == "zip":
                    with zipfile.ZipFile(data, "w", compression) as z:
                        for m in members:
                            z.writestr(m["member"], m["text"])
                else:
                    with tarfile.open(fileobj=data, mode="w:gz" if kind == "tar.gz" else "w") as t:
                        for m in members:
                            info, content = tarfile.TarInfo(m["member"]), m["text"].encode()
                            info.size = len(content)
                            t.addfile(info, io.BytesIO(content))
                out.write(data.getbuffer())
                files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    lined = df.select("name", "member", "text").repartition(task_count(spark), "name").sortWithinPartitions("name", "member")
    lined.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()  # one row
    return folder


def _shelved(name: Column) -> Column:
    """A file of that name in a folder for every so many documents, in their order.

    Its size is bounded so, and the files of a corpus are as many as it takes: no task writes or lists the whole.
    """
    shelf = F.lpad(div(F.col("doc_key"), SHELF).cast("string"), 12, "0")
    return F.concat(shelf, F.lit("/"), name)


def _member(name: str) -> Column:
    return F.concat(F.lit(name), F.lpad(F.col("doc_key").cast("string"), 12, "0"))


ARCHIVES = {"en": "en.tar", "de": "de.tar.gz", "fr": "fr-packed.zip"}


def _archives(spark, sf) -> str:
    name = F.lit("other-stored.zip")
    for lang, file in ARCHIVES.items():
        name = F.when(F.col("lang") == lang, file).otherwise(name)
    docs = documents(spark, sf, "lang").select(_shelved(name).alias("name"), _member("docs/").alias("member"), "text")

    def keep(name: str) -> tuple[str, int]:
        return name.partition(".")[2], zipfile.ZIP_DEFLATED if "packed" in name else zipfile.ZIP_STORED

    return _write_files(spark, docs, scratch_path(spark, "archives"), keep)


def q_archive_members(spark, sf):
    """All documents in archives of four kinds, listed."""
    members = archive_members(spark, f"{_archives(spark, sf)}/*/*")
    return members.select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), "member", "kind", "size")


def q_expand_archives(spark, sf):
    """The same, unpacked in small pieces and put together again."""
    docs = decoded_members(expand_archives(spark, f"{_archives(spark, sf)}/*/*", part_bytes=1 << 12))
    return docs.select(
        F.regexp_extract("doc_key", r"(\d+)$", 1).cast("long").alias("doc_key"), F.md5("markup").alias("text_md5")
    )


def _year() -> Column:
    return F.col("doc_key") % 3 + 1999


def _year_folders(spark, sf) -> str:
    name = F.concat(_year().cast("string"), _member("/"), F.lit(".md"))
    docs = documents(spark, sf).select(name.alias("name"), F.lit("").alias("member"), "text")
    return _write_files(spark, docs, scratch_path(spark, "years"), lambda _: ("text", 0))


def q_read_document_files(spark, sf):
    """Every document a file of its own, by year."""
    docs = read_document_files(spark, _year_folders(spark, sf))
    return docs.select("year", "doc_key", F.md5("text").alias("text_md5"))


def _stream_sequences(tokens: DataFrame, order: dict) -> DataFrame:
    """The packed sequences of a corpus of bytes, as digests of their hexadecimal digits."""
    sequences = pack_sequences(token_offsets(tokens, **order), LENGTH)
    digits = F.array_join(F.transform("x", lambda i: F.lower(F.lpad(F.hex(i.cast("long")), 2, "0"))), "")
    return sequences.select("split", "seq_id", F.md5(digits).alias("x_md5"))


def _wiki_files(spark, sf) -> str:
    name = F.when(F.col("lang") == "en", "wiki.train.raw").when(F.col("lang") == "de", "wiki.valid.raw")
    docs = documents(spark, sf, "lang").select(
        _shelved(F.coalesce(name, F.lit("wiki.test.raw"))).alias("name"),
        _member("").alias("member"),
        F.concat("text", F.lit("\n")).alias("text"),
    )
    return _write_files(spark, docs, scratch_path(spark, "wiki"), lambda _: ("text", 0))


def q_recipe_wiki(spark, sf):
    """Text files whose names say their split, encoded as whole files."""
    tokens = corpus("wikitext")(spark, f"{_wiki_files(spark, sf)}/*", byte_coder(spark))
    return _stream_sequences(stage(tokens, "wiki-tokens"), stream_order("wikitext"))


def q_recipe_years(spark, sf):
    """A folder of files a year; the later years come first."""
    tokens = year_corpus(spark, _year_folders(spark, sf), byte_coder(spark), [2001, 1999, 2000])
    return _stream_sequences(stage(tokens, "year-tokens"), stream_order("arxiv"))


def q_recipe_char(spark, sf):
    """One text, cut at four fifths of its characters, as character ids."""
    docs = documents(spark, sf).select(
        _shelved(F.lit("input.txt")).alias("name"), _member("").alias("member"), F.concat("text", F.lit("\n")).alias("text")
    )
    folder = _write_files(spark, docs, scratch_path(spark, "char"), lambda _: ("text", 0))
    tokens = corpus("shakespeare-char")(spark, f"{folder}/*/input.txt")
    sequences = pack_sequences(token_offsets(stage(tokens, "char-tokens"), **stream_order("shakespeare-char")), LENGTH)
    return sequences.select("split", "seq_id", F.md5(char_decode("x")).alias("x_md5"))


def registered() -> dict:
    """All queries of this module by name."""
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}
