"""Language identification with a string kernel (operator 6).

The kernel of two texts is the share of character n-grams (1 to 3) present in both, normalised by their sizes. Nystroem
landmarks, drawn from each language, give each text finite features, and kernel ridge regression, one language against the rest, is solved on a bounded
sample of labelled rows. As the kernel is an inner product of presence vectors, the fitted weights fold into one matrix and whole
batches of texts are scored by a matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_arrow, raw

GRAMS = (1, 2, 3)
DIMENSIONS = 1 << 13
#: Landmarks in all, and of each language at least.
LANDMARKS, EACH = 160, 8
#: Labelled rows of a language that fitting takes at most; what the driver holds grows with the number of languages only.
PER_LANGUAGE = 300
BROADCAST_LANGUAGES = 10_000
RIDGE = 1e-2
SHARPNESS = 6.0
_LETTER = regex.compile(r"\p{L}")
_BLOCK = 256


def grams(text: bytes) -> np.ndarray:
    """The hashed character n-grams of a lower-cased text, with repeats."""
    buffer = np.frombuffer(f" {' '.join(text.decode('utf-8', 'replace').lower().split())} ".encode("utf-32-le", "replace"), np.uint32)
    found = []
    for n in GRAMS:
        count = len(buffer) - n + 1
        value = np.full(max(count, 0), n, np.uint32)
        for k in range(n):
            value = value * np.uint32(0x01000193) ^ buffer[k : k + count]
        value *= np.uint32(0x9E3779B1)
        found.append(value >> np.uint32(32 - 13))
    return np.concatenate(found)


def presence(texts: list[bytes]) -> np.ndarray:
    """One row of 0 and 1 for each text, divided by its norm."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        row[grams(text)] = 1
    return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))


def fit(texts: list[bytes], languages: list[str], seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the folded weights (n-gram, language) and intercepts of the one-versus-rest ridge regressions."""
    known = sorted(set(languages))
    if not known:
        return [], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0, np.float32)
    x = presence(texts)
    y = np.where(np.array(languages)[:, None] == np.array(known)[None, :], 1.0, -1.0)
    order = np.random.default_rng(seed).permutation(len(x))
    share = max(EACH, LANDMARKS // len(known))
    own = [order[np.array(languages)[order] == name][:share] for name in known]
    landmarks = x[np.concatenate(own)]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ landmarks.T) @ root
    centre = y.mean(axis=0)
    weights = np.linalg.solve(phi.T @ phi + RIDGE * len(x) / len(known) * np.eye(phi.shape[1]), phi.T @ (y - centre))
    return known, (landmarks.T @ (root @ weights)).astype(np.float32), centre.astype(np.float32)


def labelled_sample(docs: DataFrame, per_language: int) -> list[tuple[bytes, str]]:
    """Texts and languages outside the held-out fifth, about 1.5 * per_language of each language by hash of the id, cut to per_language on the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    if counts.count() <= BROADCAST_LANGUAGES:  # else texts would be dealt out by language, a few huge tasks
        counts = F.broadcast(counts)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = rows.join(counts, "lang").filter(place < F.lit(1.5 * per_language * (1 << 30)) / F.col("_n")).withColumn("_place", place)
    taken: dict[str, int] = {}
    out = []
    for r in sorted(chosen.select("text", "lang", "_place").collect(), key=lambda r: (r["_place"], r["text"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language and _LETTER.search(r["text"]):
            out.append((r["text"].encode(), r["lang"]))
    return out


def identify(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score (0 to 1).

    lang_pred is `und`, with score 0, if the text is null or has no letter, and for every text if no row has a language to learn. A null
    doc_id is not held out and not learned from. An empty table gives no rows. Other columns are ignored.
    """
    sample = labelled_sample(docs, per_language)
    known, weights, centre = fit([t for t, _ in sample], [v for _, v in sample])
    names = np.array([*known, "und"], object)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw(batch.column(1))
        best, score = np.full(len(texts), len(known)), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and known and _LETTER.search(t.decode("utf-8", "replace"))]
        for at in range(0, len(rows), _BLOCK):
            part = rows[at : at + _BLOCK]
            values = (presence([texts[i] for i in part]) @ weights + centre).astype(np.float64) * SHARPNESS
            values = np.exp(values - values.max(axis=1, keepdims=True))
            values /= values.sum(axis=1, keepdims=True)
            best[part], score[part] = values.argmax(axis=1), values.max(axis=1)
        return pa.record_batch([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, lang_pred string, score double", run)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
