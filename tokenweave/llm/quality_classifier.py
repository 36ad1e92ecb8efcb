"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

The model is learned in one task from a bounded sample of labelled rows, in an order fixed by
hashed ids; its weights, one number per hash slot, then travel to all tasks, where a
document's score is a sparse dot product.

Edge cases: a null or empty text has no n-gram and gets the score of the intercept; without
usable labels every score is one half; repeated labels of one id count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that the model is learned from, at most.
SAMPLE = 8_000
SLOTS = 1 << 18
EPOCHS = 3
REMEMBERED = 300_000

# Words, numbers, and runs of one other sign.
TOKEN = re.compile(r"[^\W\d_]+|\d+|\n+|([^\w\s]|_)\1*")
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Hashed features of a text: words, word pairs, and runs of three word shapes."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _codes(self, token: str) -> tuple[int, int]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if token.isalpha():
            case = "u" if token.isupper() else "l" if token.islower() else "t" if token[1:].islower() else "m"
            shape = f"w{case}{min(len(token), 12) // 4}"
        else:
            shape = "d" if token.isdigit() else "n" if token[0] == "\n" else f"p{token[:3]}"
        found = xxhash.xxh3_64_intdigest(token.lower()), xxhash.xxh3_64_intdigest(shape)
        self.known[token] = found
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots and weights of a text; the weights have length one."""
        tokens = [m.group() for m in TOKEN.finditer(text)] if text else []
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0)
        known = self.known
        codes = np.array([known.get(t) or self._codes(t) for t in tokens], np.uint64)
        word, shape = codes[:, 0], codes[:, 1]
        grams = [word, shape * MULTIPLY]
        if len(tokens) > 1:
            grams.append((word[:-1] * MULTIPLY + word[1:]) * MULTIPLY)
        if len(tokens) > 2:
            grams.append((shape[:-2] * MULTIPLY + shape[1:-1]) * MULTIPLY + shape[2:])
        mixed = np.concatenate(grams) * MULTIPLY
        slots, counts = np.unique((mixed >> np.uint64(46)).astype(np.int64), return_counts=True)
        weights = np.log1p(counts)
        return slots, weights / np.sqrt((weights * weights).sum())


class Leader:
    """Logistic regression updated by the follow-the-regularised-leader rule, per coordinate."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # The last slot is the intercept.
        self.z = np.zeros(SLOTS + 1)
        self.n = np.zeros(SLOTS + 1)

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        slots, values = np.append(slots, SLOTS), np.append(values, 1.0)
        w = self.weights(slots)
        gradient = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
        squared = gradient * gradient
        sigma = (np.sqrt(self.n[slots] + squared) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += gradient - sigma * w
        self.n[slots] += squared


def learn_weights(docs: DataFrame, labels: DataFrame, allowed, sample: int = SAMPLE) -> np.ndarray:
    """Weights per slot, learned from at most ``sample`` labelled rows for whose ``doc_id`` ``allowed`` holds."""
    order = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
        .withColumn("order", order)
        .orderBy("order", "doc_id")
        .limit(sample)
    )
    # At most `sample` rows of three numbers.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    lined = rows.select("order", "label", "text").repartition(1).sortWithinPartitions("order", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, leader, seen = Grams(), Leader(), []
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                slots, values = grams.of(text)
                seen.append((slots.astype(np.int32), values.astype(np.float32), label))
        for _ in range(EPOCHS):
            for slots, values, label in seen:
                leader.learn(slots, values, label)
        w = leader.weights(np.arange(SLOTS + 1)).astype("<f4") if seen else np.zeros(SLOTS + 1, "<f4")
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    found = lined.mapInArrow(run, "w binary").collect()  # one row of 4 bytes a slot
    return np.frombuffer(found[0].w, "<f4") if found else np.zeros(SLOTS + 1, "<f4")


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds ``score``: the probability of a good text, from its words alone; a column of that name is replaced."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype("<f4").tobytes())
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, grams = np.frombuffer(sent.value, "<f4").astype(float), Grams()
        for batch in batches:
            scores = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                slots, values = grams.of(text)
                scores.append(float(1 / (1 + np.exp(-np.clip(w[slots] @ values + w[SLOTS], -30, 30)))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"]
            )

    return docs.mapInArrow(run, schema)
