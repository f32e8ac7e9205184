"""Quality rules by weak supervision (operator 2).

Rules vote good (2), abstain (1) or bad (0) on each text. A generative label model explains the votes: a text is good or has one of a few
kinds of defect, and each rule votes by rates of its own under each of these. Expectation-maximisation over the counts of vote patterns
estimates the rates without labels, and a document is kept when its posterior probability of good quality reaches a threshold. A bad vote that
the other rules for the same kind of defect don't second is outvoted if the corpus shows the rule to err that often. The patterns number
3^rules at most, whatever the corpus, so the driver fits on a table of bounded size.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, over_arrow, raw, written

WINDOW = 8
SYMBOLS = re.compile(rb"[#*$%&|<>]")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_CAPITALS = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))
_AROUND = "".join(set(string.punctuation) - set("#*$%&|<>")) + "«»“”„‘’…–—"
_CLOSING = b".!?\"'"

#: (name, measure, bad below, good from, good to, bad above, kind of defect); None leaves a side open, between a good and a bad bound a rule
#: abstains. The bounds are those of published web-text filters where there are such.
RULES = (
    ("symbols", "symbols_per_word", None, None, 0.02, 0.1, 0),
    ("plain_words", "plain_share", 0.7, 0.9, None, None, 0),
    ("capitals", "capital_share", None, None, 0.1, 0.3, 1),
    ("shouted", "shouted_share", None, None, 0.1, 0.3, 1),
    ("exclaims", "exclaims_per_word", None, None, 0.02, 0.1, 1),
    ("dup_lines", "dup_line_share", None, None, 0.1, 0.3, 2),
    ("repeats", "repeat_share", None, None, 0.05, 0.2, 2),
    ("variety", "distinct_share", 0.15, 0.3, None, None, 2),
    ("lettered", "lettered_share", 0.8, 0.95, None, None, 3),
    ("function_words", "short_share", 0.05, 0.15, None, None, 3),
    ("word_length", "mean_word", 3.0, 3.5, 8.0, 10.0, 3),
    ("line_ends", "ended_share", 0.12, 0.8, None, None, 3),
)
#: Shares of a text's few words say little: the rules abstain on shorter texts, which fail the base rule anyway.
ENOUGH = 20
#: What is believed before any vote is seen, as rates of (bad, abstain, good): of a rule on the defect it looks for, and on any other text;
#: the share of good texts; and the pseudo-votes that this weighs, however many texts there are.
ON_OWN, ELSEWHERE, GOOD, PSEUDO = (0.7, 0.15, 0.15), (0.05, 0.15, 0.8), 0.9, 5.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "capitals", "letters", "exclaims", "n_distinct", "n_ended", "n_lettered", "n_plain", "n_short", "n_shouted")


class WordMarks(dict):
    """Word bytes to marks (1 has a letter, 2 letters but for punctuation around them, 4 so and three letters at most, 8 two capitals and no small letter), remembered up to `most` words."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.strip(_AROUND)
        plain = core.isalpha()
        value = 7 if plain and len(core) <= 3 else 3 if plain else int(any(map(str.isalpha, core)))
        value = self[word] = value + 8 * (core.isupper() and sum(map(str.isalpha, core)) > 1)
        return value


def measures(text: bytes | None, hashes: WordHashes, marks: WordMarks) -> tuple[int, ...]:
    """The counts of one text, in the order of MEASURES. A null text counts as empty."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(SYMBOLS.findall(text)), *[0] * (len(MEASURES) - 3))
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUATION))
    lines = [x for x in text.split(b"\n") if x.split()]
    values = hashes.array(words)
    repeated = 0
    if n >= WINDOW:
        windows = Rolling(values).windows(WINDOW)
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(len(windows) + 1, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            step = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            repeated = int((np.cumsum(step[:n]) > 0).sum())
    letters = len(joined) - len(joined.translate(None, _LETTERS))
    capitals = len(joined) - len(joined.translate(None, _CAPITALS))
    ended = sum(x.rstrip()[-1] in _CLOSING for x in lines)
    of = np.bincount(np.fromiter(map(marks.__getitem__, words), np.uint8, n), minlength=16).reshape(2, 8)
    own = (ended, n - int(of[:, 0].sum()), int(of[:, 3].sum() + of[:, 7].sum()), int(of[:, 7].sum()), int(of[1].sum()))
    return (n, chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), capitals, letters, joined.count(b"!"), len(np.unique(values)), *own)


_HASHES: WordHashes | None = None
_MARKS = WordMarks()


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        global _HASHES
        _HASHES = _HASHES or WordHashes()
        rows = [measures(t, _HASHES, _MARKS) for t in raw(batch.column(1))]
        return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", *MEASURES])

    return over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES), run)


def votes(rows: DataFrame) -> DataFrame:
    """rows with a column `votes`: one digit for each rule, 0 bad, 1 abstains, 2 good."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    value = {
        "symbols_per_word": F.col("n_symbols") / words, "mean_word": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words, "capital_share": F.col("capitals") / F.greatest("letters", F.lit(1)),
        "exclaims_per_word": F.col("exclaims") / words, "distinct_share": F.col("n_distinct") / words, "ended_share": F.col("n_ended") / lines,
        "lettered_share": F.col("n_lettered") / words, "plain_share": F.col("n_plain") / words, "short_share": F.col("n_short") / words,
        "shouted_share": F.col("n_shouted") / words,
    }
    digits = []
    for _, name, low, fine_from, fine_to, high, _ in RULES:
        x = value[name]
        bad = F.lit(False) if low is None else x < low
        if high is not None:
            bad = bad | (x > high)
        good = F.lit(True) if fine_from is None else x >= fine_from
        if fine_to is not None:
            good = good & (x <= fine_to)
        vote = F.when(bad, "0").when(good, "2").otherwise("1")
        digits.append(F.when(F.col("n_words") < ENOUGH, "1").otherwise(vote))
    return rows.withColumn("votes", F.concat(*digits))


@dataclass
class LabelModel:
    """shares: of good texts and of each kind of defect; rates: of each of these (first axis), each rule's rates of bad, abstained and good votes."""

    shares: np.ndarray
    rates: np.ndarray

    def joint(self, table: np.ndarray) -> np.ndarray:
        """log P(class, votes) of each row of votes."""
        logs = np.log(self.rates)
        return np.log(self.shares) + sum(logs[:, r, table[:, r]].T for r in range(table.shape[1]))

    def posterior(self, table: np.ndarray) -> np.ndarray:
        """P(class | votes) of each row of votes, good first; a row without a vote has the shares of all texts."""
        joint = self.joint(table)
        share = np.exp(joint - joint.max(axis=1, keepdims=True))
        return np.where((table != 1).any(axis=1, keepdims=True), share / share.sum(axis=1, keepdims=True), self.shares)

    def accuracies(self) -> tuple[np.ndarray, np.ndarray]:
        """Each rule's share of right votes among its bad votes, and among its good ones."""
        weighed = self.shares[:, None, None] * self.rates
        return 1 - weighed[0, :, 0] / weighed[:, :, 0].sum(axis=0), weighed[0, :, 2] / weighed[:, :, 2].sum(axis=0)


def digits(patterns: list[str], rules: int = len(RULES)) -> np.ndarray:
    return np.frombuffer("".join(patterns).encode(), np.uint8).reshape(-1, rules).astype(np.int64) - 48


def fit(table: np.ndarray, counts: np.ndarray, kinds: tuple[int, ...] = tuple(r[-1] for r in RULES), rounds: int = 500) -> LabelModel:
    """Expectation-maximisation over distinct rows of votes and how often each occurs; no labels are used, rows without a vote say nothing.

    Rules agree on a text because of its class alone. The prior only says which class is which: that a rule votes bad on its own
    kind of defect more often than elsewhere. It weighs PSEUDO votes for each class, so agreement in the corpus decides.
    """
    kinds = np.array(kinds)
    own = np.arange(kinds.max() + 1)[:, None] == kinds[None, :]
    belief = np.concatenate([np.tile(ELSEWHERE, (1, len(kinds), 1)), np.where(own[:, :, None], ON_OWN, ELSEWHERE)])
    shares = np.array([GOOD, *[(1 - GOOD) / len(own)] * len(own)])
    model = LabelModel(shares, belief)
    voted = (table != 1).any(axis=1)
    table, counts = table[voted], counts[voted]
    cast = [(table == v).astype(float) for v in range(3)]
    for _ in range(rounds):
        weight = model.posterior(table) * counts[:, None]
        found = np.stack([weight.T @ c for c in cast], axis=2) + PSEUDO * belief
        new = LabelModel((weight.sum(axis=0) + PSEUDO * shares) / (counts.sum() + PSEUDO), found / found.sum(axis=2, keepdims=True))
        change = np.abs(new.rates - model.rates).max()
        model = new
        if change < 1e-9:
            break
    return model


def quality_rules(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, kept, votes, posterior.

    Null and empty texts have zero counts and fail the base rule on length. Repeated rows and null ids are judged like any other, each for
    itself. An empty table gives no rows. Other columns are ignored.
    """
    rows = written(votes(measured(docs)), "quality-rules")
    found = sorted((r["votes"], r["n"]) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect())  # 3^rules rows at most
    patterns, table, counts = [p for p, _ in found], digits([p for p, _ in found]), np.array([n for _, n in found], float)
    known = spark.createDataFrame(list(zip(patterns, fit(table, counts).posterior(table)[:, 0].tolist(), strict=True)), "votes string, posterior double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        rows.join(F.broadcast(known), "votes")
        .withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", ((~F.col("base_failed")) & (F.col("posterior") >= threshold)).alias("kept"), "votes", "posterior")
    )
