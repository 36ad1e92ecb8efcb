"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.llm import (
    alignment,
    decontaminate,
    hard_negatives,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    passage_dedup,
    pii,
    quality_classifier,
    quality_rules,
    repeats,
    secret_scan,
)
from tokenweave.llm.text import covered, span_list


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def kinds(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_near_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = near_dedup.near_copies(docs, words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op2_quality_rules(spark, sf):
    judged = quality_rules.quality_verdicts(table(spark, sf, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op3_secret_scan(spark, sf):
    found = secret_scan.scan_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[kinds("base_spans", k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]],
        sha256(span_list(F.col("base_spans"))).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark, sf):
    pieces = packing.pack_documents(table(spark, sf, "documents"), tokenizer_file())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    weights = quality_classifier.learn_weights(docs, table(spark, sf, "labels"), ~held_out)
    scored = quality_classifier.score_quality(docs, weights)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op6_line_dedup(spark, sf):
    judged = line_dedup.line_verdicts(table(spark, sf, "documents").select("doc_id", "text"), words=True)
    gone = F.array_sort(F.concat("equal", "near"))
    return judged.select(
        F.col("key__").alias("doc_id"),
        "n_lines",
        F.size("equal").cast("long").alias("n_equal"),
        F.size("near").cast("long").alias("n_near"),
        F.array_join(gone.cast("array<string>"), ",").alias("removed_lines"),
    )


def op7_passage_dedup(spark, sf):
    found = passage_dedup.repeated_passages(table(spark, sf, "documents").select("doc_id", "text"))
    words = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select(
        F.col("key__").alias("doc_id"),
        "component_id",
        "n_links",
        F.size("repeats").cast("long").alias("n_repeats"),
        words.alias("n_repeat_words"),
        F.array_join(
            F.transform("repeats", lambda x: F.concat_ws(":", x["start"].cast("string"), (x["start"] + x["words"]).cast("string"))),
            ",",
        ).alias("repeat_spans"),
    )


def op8_personal_data(spark, sf):
    found = pii.scan_personal_data(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        *[kinds("base_spans", k).alias(f"n_{k}") for k in pii.KINDS[:4]],
        sha256(span_list(F.col("base_spans"))).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def op9_decontaminate(spark, sf):
    hits = decontaminate.find_hits(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=("doc_id",)
    )
    n_hit = covered(F.col("hits"))
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_license_scan(spark, sf):
    found = license_scan.scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op11_repeated_bytes(spark, sf):
    found = repeats.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_hard_negatives(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(rows, F.col("vec_id") % 100 == 0, label=label)


def op13_token_alignment(spark, sf):
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return alignment.alignment_measures(docs, tokenizer_file(), public_tokenizers.path("piece_bpe_32k.model"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
