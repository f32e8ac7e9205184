"""Language-model scoring with a hidden Markov model (operator 9).

Every training word counts. The most frequent words are classes of their own, the others share classes by their shape, and latent
states emit classes. Every round of Baum-Welch goes over the whole training part: each partition's expected counts are summed
by Spark; the first rounds take longer steps. A text's probability is the exact likelihood of its class sequence, by the scaled forward
recursion over the whole text, times each word's share of its class.

Words meet their counts bucket by bucket: texts are dealt into buckets of bounded size, each bucket asks the count table for its
own words, and is scored with them; no vocabulary is ever broadcast. Splitting, counting and looking up words is left to Arrow.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_rest, forget, over_arrow, pieces, written

FREQUENT, SHAPES = 4096, 1024
STATES = 8
#: Rounds over the whole training part, how many of them, the first, step further than maximisation does, and how much further (in logarithms).
ROUNDS, LONG, STEP = 6, 4, 1.5
#: Tokens of a training sequence; a longer text is several sequences, each of which begins with the last token of the one before, so that
#: every move between neighbours is counted. Scoring never cuts.
STRETCH = 400
#: Bytes of words that are counted at once.
COUNTED = 48 << 20
#: Characters of text in a scoring bucket, about.
BUCKET = 20 << 20
END = FREQUENT + SHAPES
CLASSES = END + 1
_HELD = 1


def training(docs: DataFrame) -> DataFrame:
    return docs.filter((F.col("doc_id").isNotNull()) & (F.crc32(F.col("doc_id").cast("string")) % 5 != _HELD))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after another, and how many each text has; a null has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = split.flatten().cast(pa.binary()), split.value_lengths().fill_null(0).to_numpy()
    filled = pc.greater(pc.binary_length(words), 0)
    if not pc.all(filled).as_py():  # space before the first word or behind the last
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[filled.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        words = words.filter(filled)
    return words, sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each lower-cased word occurs; counted in each task before it moves."""

    def table(found: list[pa.Array]) -> pa.RecordBatch:
        counts = pa.chunked_array(found, pa.binary()).value_counts()
        return pa.record_batch([counts.field("values"), counts.field("counts")], ["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Array] = []
        for batch in batches:
            for piece in pieces(batch):
                found.append(words_of(piece.column(0))[0])
                if sum(words.nbytes for words in found) > COUNTED:
                    yield table(found)
                    found = []
        if found:
            yield table(found)
        batch = piece = found = None
        at_rest()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def shape(word: bytes) -> int:
    """The class, from FREQUENT on, of a word that isn't frequent: by its ending and length."""
    return FREQUENT + zlib.crc32(word[-2:] + bytes([min(len(word) // 2, 7)])) % SHAPES


def classes_of(words: pa.Array, frequent: pa.Array) -> np.ndarray:
    """The class of each word (binary, none empty), given the frequent words in the order of their classes."""
    out = pc.index_in(words, value_set=frequent).fill_null(END).to_numpy().astype(np.uint16)
    rare = np.flatnonzero(out == END)
    if len(rare):
        _, offsets, data = words.buffers()
        bounds, letters = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(data, np.uint8)
        end = bounds[1:][rare]
        size = end - bounds[:-1][rare]
        # what shape() looks at: the last letter, the one before if there is one, the halved length
        key = letters[end - 1] + (np.where(size > 1, letters[end - 2], 0).astype(np.int32) << 8) + (np.minimum(size // 2, 7) << 16)
        shapes = np.zeros(8 << 16, np.uint16)
        for x in np.flatnonzero(np.bincount(key)).tolist():
            half, before, last = x >> 16, x >> 8 & 255, x & 255
            shapes[x] = shape(bytes([before, last]).rjust(2 * half) if half else bytes([last]))
        out[rare] = shapes[key]
    return out


@dataclass
class Vocabulary:
    """What the whole count table comes to: totals, frequent words, and each class's tokens and distinct words."""

    tokens: int
    distinct: int
    ends: int
    frequent: dict[bytes, int]
    class_tokens: np.ndarray
    class_words: np.ndarray

    def words(self) -> pa.Array:
        """The frequent words in the order of their classes."""
        return pa.array(list(self.frequent), pa.binary())


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    levels = {r["level"]: r["n"] for r in counts.groupBy(F.floor(F.log2("c")).alias("level")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    least, found = 0, 0
    for level in sorted(levels, reverse=True):  # only words of the highest magnitudes are sorted, so each task sends few
        least, found = level, found + levels[level]
        if found >= FREQUENT:
            break
    top = counts.filter(F.col("c") >= 2**least).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    frequent = {bytes(r["word"]): i for i, r in enumerate(top)}
    known = pa.array(list(frequent), pa.binary())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(classes_of(batch.column(0), known), pa.int32()), batch.column(1)], ["class", "c"])

    rows = over_arrow(counts, ["word", "c"], "class int, c long", run).groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # CLASSES at most
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rows:
        tokens[r["class"]], words[r["class"]] = r["n"], r["v"]
    tokens[END], words[END] = ends, int(ends > 0)
    return Vocabulary((totals["n"] or 0) + ends, totals["v"] + int(ends > 0), ends, frequent, tokens, words)


def sequences(docs: DataFrame, frequent: pa.Array) -> DataFrame:
    """(doc_id, part, first, classes): the training sequences as packed 16-bit classes; `first` marks a text's beginning, others repeat a token."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, sizes = words_of(batch.column(1))
        row, part, out = [], [], []
        for i, values in enumerate(with_ends(classes_of(words, frequent), sizes)):
            for k, at in enumerate(range(0, len(values), STRETCH)):
                row.append(i)
                part.append(k)
                out.append(values[max(at - 1, 0) : at + STRETCH].tobytes())
        return pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(part, pa.int32()), pa.array([not p for p in part]), pa.array(out, pa.binary())], ["doc_id", "part", "first", "classes"])

    return over_arrow(docs, ["doc_id", "text"], "doc_id long, part int, first boolean, classes binary", run)


def with_ends(classes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Each text's classes, its end among them, given all texts' one after another and how many each text has."""
    ends = np.cumsum(sizes)
    values, bounds = np.insert(classes, ends, END), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).tolist()
    return [values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class, state

    def stationary(self) -> np.ndarray:
        share = np.full(len(self.start), 1 / len(self.start))
        for _ in range(200):
            share = share @ self.move
        return share / share.sum()


def packed(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: (order, tokens laid out step by step, where each step begins, sequences at each step)."""
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    tokens = np.concatenate(values) if len(values) else np.zeros(0, np.int64)
    active = len(sizes) - np.cumsum(np.bincount(sizes))[:-1] if len(tokens) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    laid = np.empty_like(tokens)
    laid[begin[at] + np.repeat(rank, sizes)] = tokens
    return order, laid, begin, active


def forward(values: list[np.ndarray], model: Model) -> np.ndarray:
    """The natural log-likelihood of each sequence, by the scaled forward recursion; states are rows, so that every operation runs along the sequences."""
    order, tokens, begin, active = packed(values)
    emit, move, ones = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T), np.ones(len(model.start))
    total = np.zeros(len(values))
    state = None
    for t, n in enumerate(active):
        seen = emit.take(tokens[begin[t] : begin[t + 1]], axis=1)
        seen *= model.start[:, None] if t == 0 else move @ state[:, :n]
        scale = ones @ seen
        seen /= scale
        state = seen
        total[:n] += np.log(scale)
    out = np.zeros(len(values))
    out[order] = total
    return out


def expected(values: list[np.ndarray], first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected counts of starts, moves and emissions (class, state), and the log-likelihood.

    A sequence that isn't `first` opens with the token before it, which counts for the move from it only. States are rows, as in forward().
    """
    k = len(model.start)
    order, tokens, begin, active = packed(values)
    tokens = tokens.astype(np.int64)
    opening = np.where(first[order], model.start[:, None], model.stationary()[:, None]).astype(np.float32)
    move, ones = model.move.astype(np.float32), np.ones(k, np.float32)
    along = np.ascontiguousarray(move.T)
    seen = np.ascontiguousarray(model.emit.T, np.float32).take(tokens, axis=1)
    ahead = np.empty((k, len(tokens)), np.float32)
    scales = np.empty(len(tokens), np.float32)
    for t, n in enumerate(active):
        a, b = begin[t], begin[t + 1]
        state = (opening if t == 0 else along @ ahead[:, begin[t - 1] : begin[t - 1] + n]) * seen[:, a:b]
        scales[a:b] = ones @ state
        np.divide(state, scales[a:b], out=ahead[:, a:b])
    seen /= scales
    moves = np.zeros((k, k))
    after = None
    for t in range(len(active) - 1, -1, -1):
        a, b = begin[t], begin[t + 1]
        now = seen[:, a:b]
        if after is not None:
            m = after.shape[1]
            moves += ahead[:, a : a + m] @ after.T
            back = move @ after
            ahead[:, a : a + m] *= back
            now[:, :m] *= back
        after = now
    ahead /= ones @ ahead
    ahead[:, : len(values)] *= first[order]
    emissions = np.stack([np.bincount(tokens, row, CLASSES) for row in ahead], axis=1)
    return ahead[:, : len(values)].sum(axis=1, dtype=float), moves * model.move, emissions, float(np.log(scales.astype(float)).sum())


def improved(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, background: np.ndarray) -> Model:
    """Maximisation, with pseudo-counts that follow the corpus's class shares, so every class stays possible in every state."""
    start = (starts + 1) / (starts.sum() + len(starts))
    move = moves + 1
    emit = emissions + 20 * background[:, None]
    return Model(start, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))


def further(old: Model, new: Model, step: float) -> Model:
    """Past the new model by `step` times the way from the old one, in logarithms (over-relaxed expectation-maximisation)."""

    def along(a: np.ndarray, b: np.ndarray, axis: int) -> np.ndarray:
        x = step * np.log(b) + (1 - step) * np.log(a)
        x = np.exp(x - x.max(axis=axis, keepdims=True))
        x = np.maximum(x, 1e-30)
        return x / x.sum(axis=axis, keepdims=True)

    return Model(along(old.start, new.start, 0), along(old.move, new.move, 1), along(old.emit, new.emit, 0))


def fitted(model: Model, background: np.ndarray, counts: Callable[[Model], tuple[np.ndarray, np.ndarray, np.ndarray, float]]) -> Model:
    """The model after ROUNDS of Baum-Welch, given what a model comes to over all training sequences. A long step that lost likelihood is taken back to a plain one."""
    plain, best = model, -np.inf
    for done in range(ROUNDS):
        starts, moves, emissions, likelihood = counts(model)
        if not starts.sum():
            break
        if not likelihood >= best and model is not plain:  # NaN too
            model = plain
            continue
        best, plain = likelihood, improved(starts, moves, emissions, background)
        model = further(model, plain, STEP) if done < LONG else plain
    return model


def train(table: DataFrame, vocab: Vocabulary, seed: int = 3) -> Model:
    background = (vocab.class_tokens + 0.5) / (vocab.class_tokens + 0.5).sum()
    draw = np.random.default_rng(seed)
    noise = np.exp(0.7 * draw.standard_normal((CLASSES, STATES)))
    model = improved(np.ones(STATES), np.full((STATES, STATES), 1.0) + 60 * np.eye(STATES), 1000 * background[:, None] * noise, background)
    return fitted(model, background, lambda now: corpus_counts(table, now))


def corpus_counts(table: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts and log-likelihood over all training sequences: each task sums its own, Spark sums the tasks', cell by cell."""
    k = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + CLASSES * k + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1500):
                part = batch.slice(at, 1500)
                values = [np.frombuffer(c, np.uint16) for c in part.column(1).to_pylist()]
                starts, moves, emissions, likelihood = expected(values, part.column(0).to_numpy(zero_copy_only=False).astype(bool), model)
                total += np.concatenate([starts, moves.ravel(), emissions.ravel(), [likelihood]])
        cells = np.flatnonzero(total)
        if len(cells):
            yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "value"])

    rows = table.select("first", "classes").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(k + k * k + CLASSES * k + 1)
    for r in rows:
        total[r["cell"]] = r["value"]
    return total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : -1].reshape(CLASSES, k), float(total[-1])


def score_texts(texts: pa.Array, words: pa.Array, counts: np.ndarray, vocab: Vocabulary, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, known tokens, base score, score) of each text, given the counts of the words that have any."""
    found, sizes = words_of(texts)
    at = pc.index_in(found, value_set=words).fill_null(len(words)).to_numpy()
    kind = classes_of(found, vocab.words())
    c, whole = np.append(counts, 0), vocab.tokens + 0.5 * (vocab.distinct + 1)
    base = np.log10((c + 0.5) / whole)[at]
    share = np.log10((vocab.class_tokens + 0.5 * (vocab.class_words + 1)) / whole)
    inner = np.where(kind < FREQUENT, 0.0, base - share[kind])
    end = np.log10((vocab.ends + 0.5) / whole)
    row = np.repeat(np.arange(len(sizes)), sizes)
    summed = lambda values: np.bincount(row, values, len(sizes))
    likelihood = forward(with_ends(kind, sizes), model) / np.log(10)
    known = summed(c[at] > 0).astype(np.int64) + int(vocab.ends > 0)
    return sizes.astype(np.int64) + 1, known, summed(base) + end, summed(inner) + likelihood


def language_model_scores(spark: SparkSession, docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null or empty text is its end alone. A row with a null doc_id is scored, not held out, and not learned from. With nothing to learn from, every
    word is unknown. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = training(rows)
    counts = written(word_counts(learn), "lm-counts")
    sizes = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")).first()
    vocab = vocabulary(counts, learn.count())
    table = written(sequences(learn, vocab.words()), "lm-sequences")
    model = train(table, vocab)
    forget(table)
    buckets = max(1, -(-int(sizes["chars"] or 0) // bucket))
    texts = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets))).repartition(buckets, "bucket")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[pa.Array]] = {}
        for batch in batches:
            for piece in pieces(batch):
                buckets = piece.column(2)
                for own in buckets.unique().to_pylist():
                    seen.setdefault(own, []).append(words_of(piece.column(1).filter(pc.equal(buckets, own)))[0].unique())
        for own, found in seen.items():
            words = pa.chunked_array(found, pa.binary()).unique()
            yield pa.record_batch([pa.array(np.full(len(words), own, np.int64)), words], ["bucket", "word"])
        batch = piece = words = found = None
        seen.clear()
        at_rest()

    asked = texts.mapInArrow(ask, "bucket long, word binary").join(counts, "word").select("bucket", "word", "c")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        words, c = right.column("word").combine_chunks(), right.column("c").to_numpy()
        n, known, plain, full = score_texts(left.column("text").combine_chunks(), words, c, vocab, model)
        return pa.table({"doc_id": left.column("doc_id"), "n_tokens": n, "n_known": known, "base_score": plain, "score": full})

    out = texts.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == _HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
