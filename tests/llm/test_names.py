"""Columns of the input that are named like columns of the operators keep their values."""

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from tokenweave.llm import license_scan, line_dedup, near_dedup, passage_dedup, quality_classifier

NAMES = "kept n_shingles component_id score labels repeats row__ gone__ new__ others__ carried__ equal near key__ best node".split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = [prose(1, 60), prose(1, 60), prose(2, 50) + "\n" + prose(3, 12), prose(4, 40) + "\n" + prose(3, 12), None, ""]
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return plain.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in NAMES]).coalesce(2)


@pytest.mark.parametrize("stage", [near_dedup.drop_near_copies, line_dedup.dedup_lines, passage_dedup.remove_passages])
def test_stages_keep_values(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    plain = {(r.doc_id, r.text) for r in stage(docs.select("doc_id", "text")).collect()}
    assert {(r.doc_id, r.text) for r in rows} == plain and len(rows) >= 3
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)


def test_added_columns_replace_their_namesakes(docs):
    scored = quality_classifier.score_quality(docs, np.zeros(quality_classifier.SLOTS + 1, "<f4"))
    assert scored.columns.count("score") == 1 and {r.score for r in scored.collect()} == {0.5}
    scanned = license_scan.scan_licenses(docs)
    assert scanned.columns.count("labels") == 1 and all(r.kept == f"kept{r.doc_id}" and r.labels == [] for r in scanned.collect())
