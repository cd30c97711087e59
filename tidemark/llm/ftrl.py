"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are word uni- and bigrams hashed to ``2 ** bits`` slots, plus three back-off bigrams that stand for patterns no
table can list: a word after itself, a bigram the text holds again, a mark after a mark. Counts are damped by a square root
and scaled to unit length, so a score is one sparse dot product whatever the length of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import LOWER_ASCII, as_bytes, cut_lineage, mixed, word_hashes

TOKEN = re.compile(rb"[0-9a-z_\x80-\xff]+|[!-/:-@\[-^`{-~]+")
BITS = 18
#: Labelled rows learned from: those with the smallest hash of the id. A documented bound of the sample.
MAX_ROWS = 8_000
EPOCHS = 3
SAME, AGAIN, MARKS = (np.uint64(x) for x in (0x51, 0xA6, 0x3C))


def features(text: bytes | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots (sorted, distinct) and values of unit length; both empty for texts without tokens."""
    tokens = TOKEN.findall(text.translate(LOWER_ASCII)) if text else []
    if not tokens:
        return np.empty(0, np.int64), np.empty(0)
    words = word_hashes(tokens)
    left, right = words[:-1], words[1:]
    pairs = mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)
    same = np.count_nonzero(left == right)
    _, n = np.unique(pairs, return_counts=True)
    again = int(n[n > 1].sum())
    marks = sum(1 for t in tokens if t[0] < 48 and len(t) > 1)
    every = np.concatenate([mixed(words), pairs]) >> np.uint64(64 - bits)
    slots, n = np.unique(every.astype(np.int64), return_counts=True)
    values = np.sqrt(n.astype(float))
    values /= np.sqrt((values * values).sum())
    back_off = [(int(mixed(np.array([k]))[0] >> np.uint64(64 - bits)), c / len(tokens)) for k, c in ((SAME, same), (AGAIN, again), (MARKS, marks)) if c]
    if back_off:
        slots = np.concatenate([slots, np.array([s for s, _ in back_off], np.int64)])
        values = np.concatenate([values, np.array([min(1.0, v) for _, v in back_off])])
    return slots, values


@dataclass
class FtrlProximal:
    """Per-coordinate FTRL-proximal for logistic loss; the last slot is the bias."""

    bits: int = BITS
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02

    def __post_init__(self):
        self.z = np.zeros((1 << self.bits) + 1)
        self.n = np.zeros((1 << self.bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << self.bits, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        at = np.append(slots, 1 << self.bits)
        x = np.append(values, 1.0)
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label
        g = error * x
        n = self.n[at]
        np.add.at(self.z, at, g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w)
        np.add.at(self.n, at, g * g)


def learn_from(batches, bits: int, epochs: int):
    """Arrow batches of (label, slots, values) in a fixed order to one row: the non-zero weights."""
    import pyarrow as pa

    rows = []
    for batch in batches:
        for label, slots, values in zip(batch["label"].to_pylist(), batch["slots"].to_pylist(), batch["shares"].to_pylist(), strict=True):
            rows.append((label, np.frombuffer(slots, np.int32).astype(np.int64), np.frombuffer(values, np.float32).astype(float)))
    model = FtrlProximal(bits)
    for _ in range(epochs):
        for label, slots, values in rows:
            model.learn(slots, values, label)
    every = model.weights(np.arange((1 << bits) + 1))
    at = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([every[at].tobytes()])], ["at", "weights"])


@F.arrow_udf(T.StructType([T.StructField("slots", T.BinaryType()), T.StructField("shares", T.BinaryType())]))
def _feature_column(column):
    import pyarrow as pa

    both = [features(x) for x in as_bytes(column)]
    return pa.StructArray.from_arrays(
        [pa.array([s.astype(np.int32).tobytes() for s, _ in both], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in both], pa.binary())],
        ["slots", "shares"],
    )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) learned from ``labels`` (doc_id, quality) on the texts of ``docs``.

    Rows with a null id, null label or a label other than 0 and 1 are not learned from. The sample is the ``max_rows`` labelled
    ids with the smallest hash, so it does not depend on partitions. FTRL is sequential: features are made on all executors,
    the bounded sample is then learned in one task in hash order. Without labelled rows all weights are 0 and every score 0.5.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max("quality").cast("int").alias("label"))
        .withColumn("__order", F.xxhash64(F.col("__id").cast("string"), F.lit("quality")))
        .orderBy("__order")
        .limit(max_rows)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # at most max_rows ids
        .select("__order", "label", _feature_column(F.col("text")).alias("__f"))
        .select("__order", "label", "__f.slots", "__f.shares")
    )
    rows = cut_lineage(rows)
    found = (
        rows.repartition(1).sortWithinPartitions("__order", "slots")
        .select("label", "slots", "shares")
        .mapInArrow(lambda batches: learn_from(batches, bits, epochs), "at binary, weights binary")
        .collect()
    )
    weights = np.zeros((1 << bits) + 1)
    for row in found:
        weights[np.frombuffer(row.at, np.int32)] = np.frombuffer(row.weights, float)
    return weights


def score_column(text: Column, shared, bits: int = BITS) -> Column:
    """Probability of label 1 for each text, by a broadcast weight vector of fixed size."""

    @F.arrow_udf(T.DoubleType())
    def score(column):
        import pyarrow as pa

        w = shared.value
        out = np.empty(len(column))
        for i, value in enumerate(as_bytes(column)):
            slots, shares = features(value, bits)
            out[i] = w[slots] @ shares + w[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    return score(text)


def held_out(doc_id: Column, parts: int = 5, which: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == which


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """Fit on labelled rows outside the held-out fold; the weights as a broadcast value."""
    weights = fit(docs, labels.where(~held_out(F.col("doc_id"))), max_rows)
    return docs.sparkSession.sparkContext.broadcast(weights)


def classify(docs: DataFrame, shared, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document row. Null and empty texts get the score of the bias alone."""
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), shared).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of at least ``threshold``."""
    shared = train(docs, labels)
    return docs.where(score_column(F.col("text"), shared) >= threshold)
