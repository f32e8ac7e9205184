"""Edit-aware token counts (operator 4).

A text's pre-tokens (stretches without ASCII white space, which the word-end vocabulary never merges across) stand in the leaves of a
segment tree over their token counts and bytes. An edit of a span of bytes re-encodes only the leaves that it touches and those into which a
pre-token at its border runs, and updates the sums on their paths to the root; the rest of the text is never encoded again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_arrow
from .tokens import BATCH, Encoded, WordIds, default_vocabulary, word_ids

#: Pre-tokens of a leaf when a tree is built, and how many an edit may leave in one before the tree is dealt out anew.
LEAF, FULL = 32, 256
_SPACE = frozenset(b" \t\n\r\x0b\x0c")


class CountTree:
    """Token counts and byte lengths of a text's leaves, with their sums over pairs of leaves, pairs of pairs, and so on to the root.

    counts, cuts: the token count of each leaf and where it ends in the text, if they are known already; leaves begin at pre-token borders.
    """

    def __init__(self, text: bytes, known: WordIds, counts: list[int] | None = None, cuts: list[int] | None = None) -> None:
        self.known, self.encoded = known, 0
        if counts is None:
            self.leaves, counts = self._read(text)
        else:
            self.leaves = [text[a:b] for a, b in zip([0, *cuts], cuts)]
        self._build(counts)

    def _read(self, text: bytes) -> tuple[list[bytes], list[int]]:
        """A stretch of text as leaves of LEAF pre-tokens and their counts; there is one leaf at least."""
        words = text.split()
        self.encoded += len(words)
        leaves, counts, start, at = [], [], 0, 0
        for i in range(0, len(words), LEAF):
            part = words[i : i + LEAF]
            for w in part:
                at = text.index(w, at) + len(w)
            end = at if i + LEAF < len(words) else len(text)
            leaves.append(text[start:end])
            counts.append(sum(len(self.known.of(w)) for w in part) // 4)
            start = end
        return (leaves, counts) if leaves else ([text], [0])

    def _build(self, counts: list[int]) -> None:
        self.count, self.bytes = _levels(counts), _levels(list(map(len, self.leaves)))

    @property
    def total(self) -> int:
        return self.count[-1][0]

    @property
    def size(self) -> int:
        return self.bytes[-1][0]

    def text(self) -> bytes:
        return b"".join(self.leaves)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes [start, end) by new; the token count afterwards."""
        first, before = self._find(start)
        last, past = (first, before) if end - 1 <= start else self._find(end - 1)
        text = b"".join(self.leaves[first : last + 1])
        text = text[: start - before] + new + text[end - before :]
        while first and not (text and text[0] in _SPACE) and self.leaves[first - 1][-1:] not in _BLANKS:
            first -= 1
            text = self.leaves[first] + text
        while last + 1 < len(self.leaves) and not (text and text[-1] in _SPACE) and self.leaves[last + 1][:1] not in _BLANKS:
            last += 1
            text = text + self.leaves[last]
        leaves, counts = self._read(text)
        slots = last + 1 - first
        if len(leaves) > slots:  # what has no slot of its own joins the last one
            if (len(leaves) - slots + 1) * LEAF > FULL:
                self._deal(first, last, leaves, counts)
                return self.total
            leaves[slots - 1 :] = [b"".join(leaves[slots - 1 :])]
            counts[slots - 1 :] = [sum(counts[slots - 1 :])]
        empty = slots - len(leaves)
        for i, (leaf, n) in enumerate(zip(leaves + [b""] * empty, counts + [0] * empty, strict=True), first):
            _add(self.count, i, n - self.count[0][i])
            _add(self.bytes, i, len(leaf) - self.bytes[0][i])
            self.leaves[i] = leaf
        return self.total

    def _deal(self, first: int, last: int, leaves: list[bytes], counts: list[int]) -> None:
        """Put leaves in the place of others and build the sums anew; takes FULL new pre-tokens, so it is paid for by what was inserted."""
        counts = [*self.count[0][:first], *counts, *self.count[0][last + 1 : len(self.leaves)]]
        self.leaves[first : last + 1] = leaves
        self._build(counts)

    def _find(self, offset: int) -> tuple[int, int]:
        """(leaf that holds the byte offset, bytes before it); the last leaf for the text's end."""
        if offset >= self.size:
            return len(self.leaves) - 1, self.size - len(self.leaves[-1])
        at, before = 0, 0
        for level in reversed(self.bytes[:-1]):
            at *= 2
            if before + level[at] <= offset:
                before += level[at]
                at += 1
        return at, before


_BLANKS = {bytes([c]) for c in _SPACE}


def _levels(values: list[int]) -> list[list[int]]:
    """The values, the sums of their pairs, and so on up to one."""
    out = [values]
    while len(values) > 1:
        if len(values) % 2:
            values.append(0)
        values = [a + b for a, b in zip(values[::2], values[1::2])]
        out.append(values)
    return out


def _add(levels: list[list[int]], i: int, by: int) -> None:
    if by:
        for level in levels:
            level[i] += by
            i //= 2


def _trees(column: pa.Array, known: WordIds):
    """(tree, words) of each text: counts and leaf borders of a whole batch come from arrays."""
    found = Encoded(column, known)
    tokens = np.append(0, np.cumsum(found.n_ids[found.kind]))  # before each stretch
    first = np.append(np.flatnonzero(found.word), len(found.word))  # the stretch that begins each word
    at, word_at = np.append(found.starts, len(found.data))[first], np.searchsorted(first, found.stretch_at)
    data = memoryview(found.data)
    for i in range(len(column)):
        a, b = found.text_at[i], found.text_at[i + 1]
        words = int(word_at[i + 1] - word_at[i])
        begin = np.arange(word_at[i], word_at[i + 1], LEAF)
        before = tokens[first[np.append(begin, word_at[i + 1])]]
        cuts = [*(at[begin[1:]] - a).tolist(), int(b - a)]
        yield CountTree(bytes(data[a:b]), known, np.diff(before).tolist() or [0], cuts), words


def counts_after_edits(docs: DataFrame, edits: str = "edits", path: str | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_tokens before, n_edited after the row's edits, n_words encoded at first, n_reencoded for the edits, and edited_text if `texts`.

    edits: an array of (start, end, new) over UTF-8 byte offsets of the text as the edits before leave it; offsets beyond the text are cut to it.
    Null texts count as empty, a null array, edit or replacement as none or empty.
    """
    where = path or default_vocabulary()
    names = ["doc_id", "n_tokens", "n_edited", "n_words", "n_reencoded", *(["edited_text"] if texts else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, out = word_ids(where), []
        for (tree, words), own in zip(_trees(batch.column(1), known), batch.column(2).to_pylist(), strict=True):
            n = tree.total
            for e in own or []:
                if e is None:
                    continue
                start = min(max(e["start"] or 0, 0), tree.size)
                end = min(max(start if e["end"] is None else e["end"], start), tree.size)
                tree.edit(start, end, (e["new"] or "").encode())
            out.append((n, tree.total, words, tree.encoded, *([tree.text().decode("utf-8", "replace")] if texts else [])))
        columns = [pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))]
        return pa.record_batch([batch.column(0), *columns], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(edits).alias("edits"))
    schema = "doc_id long, n_tokens long, n_edited long, n_words long, n_reencoded long" + (", edited_text string" if texts else "")
    return over_arrow(rows, ["doc_id", "text", "edits"], schema, run, BATCH)


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts of every document before and after a standard revision: a heading put in front, a word put into the middle, a note added at the end.

    One row for each row of docs: doc_id, n_tokens, n_edited, n_words, n_reencoded. Null texts count as empty; an empty table gives no rows; other columns are ignored.
    Repeated rows and null ids are counted like any other.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    head, note = "Revised. ", " end of note"
    half = F.substring(F.coalesce("text", F.lit("")), F.lit(1), (F.length(F.coalesce("text", F.lit(""))) / 2).cast("int"))
    middle = F.octet_length(half) + len(head)  # at a character's border
    edit = lambda a, b, new: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(new).alias("new"))
    plan = F.array(edit(F.lit(0), F.lit(0), head), edit(middle, middle, " struck "), edit(size + len(head) + 8, size + len(head) + 8, note))
    rows = docs.select("doc_id", "text", plan.alias("revision"))
    return counts_after_edits(rows, "revision", path, texts=False).select("doc_id", "n_tokens", "n_edited", "n_words", "n_reencoded")
