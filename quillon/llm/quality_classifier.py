"""Quality classifier: supervised subword embeddings (operator 7).

A document is the average of the vectors of its words and of the character n-grams in them, hashed into a table; a softmax
layer over that average gives the classes. Vectors and layer are learned together by numpy stochastic gradient descent on a
bounded sample of labelled rows. Since the layer is linear, scoring folds it into the table: one number for each class and bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_arrow, raw, rows_where, word_hashes

BUCKETS = 1 << 17
GRAMS = (3, 4)
SIZE = 16
#: Labelled rows that training takes at most, those of least hash of their id.
SAMPLE = 4000
THRESHOLD = 0.3


def features(text: bytes | None) -> np.ndarray:
    """The bucket of each word and of each character n-gram (in bytes, with the spaces around its word). None for no words."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    found = [(word_hashes().array(words) % np.uint64(BUCKETS)).astype(np.int64)]
    buffer = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    spaces = np.concatenate([[0], np.cumsum(buffer == 32, dtype=np.int32)])
    wide = buffer.astype(np.uint32)
    for n in GRAMS:
        count = len(buffer) - n + 1
        if count < 1:
            continue
        value = np.full(count, n, np.uint32)
        for k in range(n):
            value = value * np.uint32(0x01000193) ^ wide[k : k + count]
        inside = spaces[n - 1 : n - 1 + count] - spaces[1 : 1 + count]  # spaces strictly within
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        found.append((value[inside == 0] >> np.uint32(15)).astype(np.int64))
    return np.concatenate(found)


@dataclass
class Model:
    """table: what each bucket adds to the log odds of each class; bias: the log odds without features."""

    classes: list[int]
    table: np.ndarray
    bias: np.ndarray

    def probabilities(self, text: bytes | None) -> np.ndarray:
        found = features(text)
        scores = self.bias + (self.table[found].mean(axis=0) if len(found) else 0)
        scores = np.exp(scores - scores.max())
        return scores / scores.sum()


def train(texts: list[bytes | None], labels: list[int], epochs: int = 8, rate: float = 4.0, seed: int = 7) -> Model:
    """Stochastic gradient descent with a linearly falling rate. Without rows both classes 0 and 1 are even; with one class the other is kept possible."""
    classes = sorted({0, 1, *labels})
    y = np.array([classes.index(v) for v in labels], np.int64)
    draw = np.random.default_rng(seed)
    vectors = (draw.random((BUCKETS, SIZE), np.float32) - 0.5) / SIZE
    layer = np.zeros((SIZE, len(classes)), np.float32)
    share = (np.bincount(y, minlength=len(classes)) + 1) / (len(y) + len(classes))
    bias = np.log(share).astype(np.float32)
    rows = [np.unique(features(t), return_counts=True) for t in texts]
    rows = [(i, (c / c.sum()).astype(np.float32)[:, None] if len(c) else None) for i, c in rows]
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            step += 1
            ids, part = rows[k]
            if part is None:
                continue
            mean = (vectors[ids] * part).sum(axis=0)
            scores = mean @ layer + bias
            chance = np.exp(scores - scores.max())
            chance /= chance.sum()
            chance[y[k]] -= 1
            pace = np.float32(rate * (1 - step / steps) * 0.1)
            back = layer @ chance
            layer -= pace * np.outer(mean, chance)
            bias -= pace * 0.1 * chance
            vectors[ids] -= (pace * 10) * part * back
    return Model(classes, vectors @ layer, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[bytes | None, int]]:
    """Texts and labels of at most `most` rows outside the held-out fifth, those of least hash of their id."""
    key = F.col("doc_id").cast("long")
    inside = labels.select(key.alias("doc_id"), F.col(label).cast("int").alias("_label")).filter("doc_id is not null and _label is not null")
    inside = inside.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(most)
    texts = docs.select(key.alias("doc_id"), "text").join(F.broadcast(inside), "doc_id")  # at most `most` ids
    rows = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).collect()
    return [(None if r["text"] is None else r["text"].encode(), r["_label"]) for r in rows]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability of class 1."""
    bias, table, one = model.bias, model.table, model.classes.index(1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Model(model.classes, table, bias)
        return pa.record_batch([batch.column(0), pa.array([float(own.probabilities(t)[one]) for t in raw(batch.column(1))], pa.float64())], ["doc_id", "score"])

    return over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, score double", run)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Null, empty and wordless texts get the score of no features, the classes' shares. A null doc_id is not held out. Labels of ids without a
    document, null labels and other columns are ignored; an empty table gives no rows, and without labels every score is even.
    """
    rows = labelled_sample(docs, labels, "quality", sample)
    model = train([t for t, _ in rows], [v for _, v in rows])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose predicted label is 1."""
    rows = labelled_sample(docs, labels, "quality", sample)
    model = train([t for t, _ in rows], [v for _, v in rows])
    one = model.classes.index(1)
    return rows_where(docs, "text", lambda texts: [bool(model.probabilities(t)[one] >= THRESHOLD) for t in texts])
