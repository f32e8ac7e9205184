"""Token ids of words, shared by packing and token counting."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from .common import kept

#: ASCII punctuation: the vocabulary's splitter always parts it from letters and digits before it.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Kinds of bytes: ASCII white space as bytes.split takes it, ASCII punctuation, ASCII capitals, other ASCII letters and digits, the rest.
BLANK, PUNCTUATION, CAPITAL, PLAIN, OTHER = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = BLANK
_KIND[list(_PUNCTUATION)] = PUNCTUATION
_KIND[65:91] = CAPITAL
_KIND[[*range(48, 58), *range(97, 123)]] = PLAIN
#: Fewer new stretches than this are merged one at a time, and longer ones always.
FEW, LONG = 64, 48
#: Bytes of text that are encoded together; at work, about twenty times as much memory is used. Ids don't depend on it.
BATCH = 2 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Merges:
    """A byte-level word-end BPE's merges over many stretches at once."""

    def __init__(self, tokenizer) -> None:
        import json

        model = json.loads(tokenizer.to_str())["model"]
        vocabulary, letters, end = model["vocab"], _byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(vocabulary)
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)  # the rank of a pair that never merges
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, self.none)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        place = np.searchsorted(self.keys, key)
        return np.where(self.keys[place] == key, self.ranks[place], self.none)

    def encode(self, stretches: list[bytes]) -> list[bytes]:
        """The packed ids of each stretch: in every round each one merges its leftmost pair of least rank, till none is left."""
        out: list[bytes] = [b""] * len(stretches)
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            raw = np.frombuffer(b"".join([stretches[i] for i in rows.tolist()]), np.uint8).reshape(-1, length)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            ranks = self.rank(ids[:, :-1], ids[:, 1:])
            while len(rows):
                if ids.shape[1] > 1:
                    at = ranks.argmin(axis=1)
                    best = ranks[np.arange(len(rows)), at]
                    done = best == self.none
                else:
                    done = np.ones(len(rows), bool)
                if done.any():
                    packed, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                    for n, i in enumerate(rows[done].tolist()):
                        out[i] = packed[n * step : (n + 1) * step]
                    if done.all():
                        break
                    rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                every = np.arange(len(rows))
                ids[every, at] = self.merged[best]
                keep = np.ones(ids.shape, bool)
                keep[every, at + 1] = False
                ids = ids[keep].reshape(len(rows), -1)
                ranks = ranks[keep[:, 1:]].reshape(len(rows), -1)
                for side in (at - 1, at):
                    on = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                    ranks[on, side[on]] = self.rank(ids[on, side[on]], ids[on, side[on] + 1])
        return out


class WordIds(dict):
    """Stretches of text without ASCII white space to the packed ids (little-endian uint32) of a word-end BPE.

    The vocabulary lower-cases, drops white space and splits between words before merging, and its normaliser works within a word, so the
    ids of a text are those of its words in turn. A word's ids are those of its core and of the punctuation at its end. A stretch of letters
    alone goes straight to the merges; anything else takes the whole tokenizer. At most `most` stretches are remembered beyond those in use.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(self.tokenizer)
        self.most = most

    def learn(self, stretches: list[bytes]) -> None:
        """Encode the distinct stretches that aren't known yet; where they are too many, only those of this list stay."""
        new = [w for w in stretches if w not in self]
        if len(self) + len(new) > self.most:
            kept = {w: self[w] for w in stretches if w in self}
            self.clear()
            self.update(kept)
        names = [w for w in new if w.isalpha() and len(w) <= LONG]  # ASCII letters
        letters = [w.lower() for w in names]
        for word in new:
            if word.isalpha() and len(word) <= LONG:
                continue
            plain = (word.lower() if word.isalpha() else None) if word.isascii() else self._letters(word)
            if plain is None:
                self[word] = self._whole(word)
            elif len(plain) > LONG:
                self[word] = self._single(plain)
            else:
                names.append(word)
                letters.append(plain)
        if len(names) < FEW:
            self.update(zip(names, map(self._single, letters), strict=True))
        else:
            self.update(zip(names, self.merges.encode(letters), strict=True))

    def of(self, word: bytes) -> bytes:
        """The ids of one word."""
        core, tail = word, b""
        if word.isascii() and b"<|" not in word:
            core = word = word.lower()
            if word.rstrip(_PUNCTUATION)[-1:].isalnum():
                core = word.rstrip(_PUNCTUATION)
                tail = word[len(core) :]
        if core not in self:
            self.learn([core])
        out = self[core]
        if tail:
            if tail not in self:
                self.learn([tail])
            out += self[tail]
        return out

    def _letters(self, word: bytes) -> bytes | None:
        """The word as its letters reach the merges, None if it isn't letters alone."""
        text = word.decode("utf-8", "replace")
        if "Σ" in text:  # the tokenizer lower-cases each character by itself, Python a final sigma by its place
            return None
        text = unicodedata.normalize("NFC", text).lower()
        return text.encode() if text.isalpha() else None

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _single(self, letters: bytes) -> bytes:
        return np.array([x.id for x in self.tokenizer.model.tokenize(letters.decode("latin-1").translate(_LETTERS))], "<u4").tobytes()


_LETTERS = _byte_letters()


def word_ids(path: str) -> WordIds:
    """This worker's ids of a vocabulary, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(f"ids {path}", lambda: WordIds(path))


class Encoded:
    """The words of a column of texts and their ids, without a Python object for each word. A null text counts as empty.

    text_at: where each text begins in `data`, and the end; starts: where each stretch (a word, or the punctuation at its end) begins in
    `data`; stretch_at: the first stretch of each text, and their number; word: whether a word begins there; kind: each stretch's number
    among the distinct ones; n_ids, first_id: of each distinct stretch, in `flat`.
    """

    def __init__(self, column: pa.Array, known: WordIds) -> None:
        texts = column.cast(pa.binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        self.text_at = at - at[0] if len(at) else np.zeros(1, np.int64)
        kinds = _KIND[data]
        filled = kinds != BLANK
        begins = self.text_at[:-1]
        edge = np.zeros(len(data) + 1, bool)  # between two texts
        edge[begins] = True
        first = filled & edge[:-1]
        first[1:] |= filled[1:] & ~filled[:-1]
        words = np.flatnonzero(first)
        special = np.searchsorted(words, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1  # words with "<|"
        # ASCII capitals become small, but not before a combining mark, which may compose with the capital alone
        capital = kinds == CAPITAL
        capital[:-1] &= (data[1:] & 0xFE) != 0xCC
        small = data + np.uint8(32) * capital
        # punctuation at a word's end parts from the ASCII letter or digit before it
        tail = np.flatnonzero((kinds[1:] == PUNCTUATION) & ((kinds[:-1] == PLAIN) | (kinds[:-1] == CAPITAL)) & ~edge[1:-1]) + 1
        stops = np.flatnonzero((kinds != PUNCTUATION) | edge[:-1])
        after = np.append(stops, len(data))[np.searchsorted(stops, tail, "right")]  # where the run of punctuation ends
        tail = tail[(np.append(kinds, BLANK)[after] == BLANK) | edge[after]]
        for w in np.unique(special):
            a = words[w]
            b = a + np.flatnonzero(np.append(~filled[a:], True) | edge[a:] & (np.arange(len(edge) - a) > 0))[0]
            small[a:b] = data[a:b]
            tail = tail[(tail < a) | (tail >= b)]
        first[tail] = True
        self.starts = np.flatnonzero(first)
        self.word = np.ones(len(self.starts), bool)
        self.word[np.searchsorted(self.starts, tail)] = False
        self.stretch_at = np.searchsorted(self.starts, self.text_at)
        before = np.cumsum(filled, dtype=np.int32)
        ends = np.append(before[self.starts] - 1, before[-1] if len(before) else 0).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(small[filled])]).dictionary_encode()
        _, cuts, letters = found.dictionary.buffers()
        cuts = np.frombuffer(cuts, np.int32)[: len(found.dictionary) + 1].tolist() if len(found.dictionary) else [0]
        letters = letters.to_pybytes() if letters is not None else b""
        distinct = [letters[a:b] for a, b in zip(cuts, cuts[1:])]
        known.learn(distinct)
        ids = [known[w] for w in distinct]
        self.kind = found.indices.to_numpy()
        self.n_ids = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        self.flat = np.frombuffer(b"".join(ids), "<u4")

    def ids(self, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in turn, each closed by one more; where each text's ids begin, and the end)."""
        n = self.n_ids[self.kind]
        ends = np.append(0, np.cumsum(n))
        bounds = ends[self.stretch_at] + np.arange(len(self.stretch_at))
        out = np.full(bounds[-1], closing, "<u4")
        place = np.ones(len(out), bool)
        place[bounds[1:] - 1] = False
        out[place] = self.flat[np.repeat(self.first_id[self.kind] - ends[:-1], n) + np.arange(ends[-1])]
        return out, bounds
