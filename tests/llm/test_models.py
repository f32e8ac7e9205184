import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import edit_counts, hmm_lm, language_id, quality_classifier, quality_rules
from quillon.llm.tokens import WordIds, default_vocabulary


def held(i, k=0):
    return zlib.crc32(str(i).encode()) % 5 == k


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(8)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randint(2, 9)))
    docs, labels = [], []
    for i in range(400):
        lang, letters = draw.choice([("aa", "abcdei"), ("bb", "uoxyzk"), ("cc", "éèàçeu")])
        words = [word(letters) for _ in range(draw.randint(20, 120))]
        good = draw.random() < 0.8
        docs.append((i, " ".join(w if good else w + draw.choice(["%%%", "$$$", "!!"]) for w in words), lang, "s", 0))
        labels.append((i, int(good), 0))
    docs += [(400, None, "aa", "s", 0), (401, "123 --", "aa", "s", 0), (402, "", None, "s", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_language(spark, table, labelled):
    docs, _ = labelled
    rows = {r["doc_id"]: r for r in language_id.identify(spark, docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [i for i in range(400) if held(i)]
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in out]) > 0.97
    assert all(rows[i]["lang_pred"] == "und" for i in (400, 401, 402)) and all(rows[i]["held_out"] == held(i) for i in rows)
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert language_id.identify(spark, table([])).count() == 0


def test_classifier(spark, table, labelled):
    docs, labels = labelled
    rows = {r["doc_id"]: r for r in quality_classifier.quality_scores(spark, docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [i for i in range(400) if held(i)]
    assert np.mean([rows[i]["predicted"] == truth[i] for i in out]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values()) and len(rows) == 403
    assert quality_classifier.quality_scores(spark, docs, labels.limit(0)).count() == 403
    assert quality_classifier.quality_scores(spark, table([]), labels).count() == 0


def test_rules(spark, table):
    draw = random.Random(3)
    words = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(n))
    texts = [words(80) for _ in range(80)] + [" ".join(w + "$$$" for w in words(60).split()) for _ in range(8)] + [words(80).upper() for _ in range(6)] + ["short text", None, "", ("same words again and again here now " * 20)]
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(spark, table(texts)).collect()}
    assert all(rows[i]["kept"] for i in range(80)) and not any(rows[i]["kept"] for i in range(80, 98))
    assert rows[97]["base_failed"] and rows[97]["n_repeat_words"] == 140 and rows[95]["n_words"] == 0
    assert quality_rules.quality_rules(spark, table([])).count() == 0


def test_rule_counts():
    from quillon.llm.common import WordHashes

    text = "é b#\nb c\n\nb c\n*".encode()
    n, chars, symbols, lines, repeat = quality_rules.measures(text, WordHashes(), quality_rules.WordMarks())[:5]
    assert (n, chars, symbols, lines, repeat) == (7, 8, 2, 1, 0)
    text = " ".join("abcdefgh" * 2).encode()
    assert quality_rules.measures(text, WordHashes(), quality_rules.WordMarks())[4] == 16


def brute_counts(text):
    """The base counts by their definitions, one word at a time."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_counts_against_brute_force(spark):
    draw = random.Random(6)
    piece = lambda: draw.choice(["a ", "bc ", "é# ", "\n", "x|y ", "same line here\n", "\t", "\x1f", "\x85", "\u3000z ", "<b> ", "a b c d e f g h i "])
    texts = ["".join(piece() for _ in range(draw.randint(0, 60))) for _ in range(80)] + [None, "", " \n ", "a " * 3000]
    rows = [(i, t, "en", 7, 1) for i, t in enumerate(texts)] + [(3, texts[3], None, 7, 1), (None, texts[4], None, 7, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string, n_words long, posterior int")  # extra columns with names of its own
    got = quality_rules.quality_rules(spark, docs).collect()
    key = lambda r: (str(r[0]), r[1:])
    short = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((tuple(r[c] for c in short) for r in got), key=key) == sorted(((i, *brute_counts(t)) for i, t, *_ in rows), key=key)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert all(r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5) for r in got)


def planted_votes(rates, shares, n, seed):
    """Votes drawn from a label model: rates[class][rule] are those of (bad, abstain, good)."""
    draw = np.random.default_rng(seed)
    truth = draw.choice(len(shares), n, p=shares)
    steps = np.cumsum(np.array(rates), axis=2)
    return truth, (draw.random((n, len(rates[0]), 1)) > steps[truth][:, :, :2]).sum(axis=2)


def test_rates_are_recovered_without_labels():
    kinds = (0, 0, 0, 1, 1, 1)
    good = [(0.02, 0.08, 0.9), (0.15, 0.05, 0.8), (0.05, 0.25, 0.7)] * 2  # the second and fifth rule are noisy
    own, other = [(0.9, 0.05, 0.05), (0.6, 0.2, 0.2), (0.75, 0.15, 0.1)], [(0.05, 0.1, 0.85), (0.2, 0.1, 0.7), (0.1, 0.2, 0.7)]
    rates, shares = np.array([good, own + other, other + own]), np.array([0.8, 0.12, 0.08])
    truth, votes = planted_votes(rates, shares, 40_000, 1)
    table, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(table, counts.astype(float), kinds)
    assert np.abs(model.shares - shares).max() < 0.02 and np.abs(model.rates - rates).max() < 0.05
    planted = quality_rules.LabelModel(shares, rates)
    for got, expected in zip(model.accuracies(), planted.accuracies(), strict=True):
        assert np.abs(got - expected).max() < 0.04
    right = (model.posterior(votes)[:, 0] >= 0.5) == (truth == 0)
    assert right.mean() > ((votes != 0).all(axis=1) == (truth == 0)).mean() + 0.1  # all-must-pass filtering drops a third of the good ones


def test_two_noisy_rules_are_outvoted():
    kinds = (0, 0, 0, 1, 1, 1)
    noisy, sound = (0.2, 0.1, 0.7), (0.01, 0.04, 0.95)
    rates = [[noisy, sound, sound] * 2, [(0.9, 0.05, 0.05)] * 3 + [noisy, sound, sound], [noisy, sound, sound] + [(0.9, 0.05, 0.05)] * 3]
    _, votes = planted_votes(rates, [0.9, 0.05, 0.05], 20_000, 2)
    table, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(table, counts.astype(float), kinds)
    keeps = lambda *v: model.posterior(np.array([v]))[0, 0] >= 0.5
    assert keeps(0, 2, 2, 0, 2, 2) and not keeps(0, 0, 2, 2, 2, 2) and not keeps(2, 2, 2, 2, 0, 0)


def test_verdict_is_not_all_must_pass(spark, table):
    draw = random.Random(5)
    words = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(n)]
    plain = [" ".join(words(80)) + "." for _ in range(150)]
    lists = ["\n".join(" ".join(words(4)) for _ in range(25)) for _ in range(12)]  # lines that end in no full stop: one rule alone votes bad
    junk = [" ".join(w + "$$$" for w in words(60)) for _ in range(12)] + [" ".join(w.upper() + "!!" for w in words(60)) for _ in range(12)]
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(spark, table(plain + lists + junk)).collect()}
    kept = [rows[i]["kept"] for i in range(len(rows))]
    assert all(kept[:162]) and not any(kept[162:]) and all(rows[i]["votes"].count("0") == 1 for i in range(150, 162))


def test_forward_is_the_sum_over_paths():
    from itertools import product

    draw = np.random.default_rng(0)
    k, c = 3, hmm_lm.CLASSES
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm_lm.Model(norm(draw.random(k), 0), norm(draw.random((k, k)), 1), norm(draw.random((c, k)), 0))
    seqs = [np.array([5, 9, 700, hmm_lm.END]), np.array([hmm_lm.END]), np.array([1, 1])]
    for got, s in zip(hmm_lm.forward(seqs, model), seqs, strict=True):
        total = sum(model.start[p[0]] * model.emit[s[0], p[0]] * np.prod([model.move[p[i - 1], p[i]] * model.emit[s[i], p[i]] for i in range(1, len(s))]) for p in product(range(k), repeat=len(s)))
        assert got == pytest.approx(np.log(total))
    starts, moves, emissions, likelihood = hmm_lm.expected(seqs, np.array([True] * 3), model)
    assert likelihood == pytest.approx(hmm_lm.forward(seqs, model).sum(), rel=1e-4)
    assert starts.sum() == pytest.approx(3, rel=1e-4) and moves.sum() == pytest.approx(4, rel=1e-4) and emissions.sum() == pytest.approx(7, rel=1e-4)


def test_language_model(spark, table, labelled):
    docs, _ = labelled
    rows = {r["doc_id"]: r for r in hmm_lm.language_model_scores(spark, docs, bucket=8000).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    counts, ends = {}, 0
    for i, words in texts.items():
        if not held(i, 1):
            ends += 1
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, words in texts.items():
        base = sum(np.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [counts.get(w, 0) for w in words] + [ends])
        r = rows[i]
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(words) + 1 and r["n_known"] == sum(w in counts for w in words) + 1
        assert r["train_tokens"] == n and r["held_out"] == held(i, 1)
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert hmm_lm.language_model_scores(spark, table([])).count() == 0


def test_edits_count_like_encoding_again():
    draw = random.Random(4)
    known = WordIds(default_vocabulary())
    piece = lambda: draw.choice(["word ", "don't", " ", "é", "x" * 30, "\n", "12 a ", ""])
    for _ in range(25):
        text = "".join(piece() for _ in range(draw.randint(0, 300))).encode()
        tree = edit_counts.CountTree(text, known)
        for _ in range(12):
            at = sorted(draw.randint(0, len(text)) for _ in range(2))
            while any(0 < a < len(text) and 0x80 <= text[a] < 0xC0 for a in at):
                at = sorted(draw.randint(0, len(text)) for _ in range(2))
            new = "".join(piece() for _ in range(draw.randint(0, 4))).encode()
            text = text[: at[0]] + new + text[at[1] :]
            got = tree.edit(at[0], at[1], new)
            assert tree.text() == text
            assert got == len(known.tokenizer.encode(text.decode(), add_special_tokens=False).ids)


def test_token_counts(spark, table, odd_texts):
    whole = WordIds(default_vocabulary()).tokenizer
    count = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    rows = {r["doc_id"]: r for r in edit_counts.token_counts(spark, table(odd_texts)).collect()}
    for i, t in enumerate(odd_texts):
        t = t or ""
        half = len(t) // 2
        assert rows[i]["n_tokens"] == count(t) and rows[i]["n_edited"] == count("Revised. " + t[:half] + " struck " + t[half:] + " end of note")
    assert rows[len(odd_texts) - 3]["n_reencoded"] < 400 < rows[len(odd_texts) - 3]["n_words"]
    assert edit_counts.token_counts(spark, table([])).count() == 0


def test_training_takes_every_sequence_in_every_round(spark):
    draw = np.random.default_rng(2)
    values = [draw.integers(0, 40, 12) + 40 * (i % 2) for i in range(2100)]
    rows = [(i, 0, i % 3 > 0, v.astype(np.uint16).tobytes()) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "doc_id long, part int, first boolean, classes binary").repartition(3)
    tokens = np.bincount(np.concatenate(values), minlength=hmm_lm.CLASSES).astype(float)
    vocab = hmm_lm.Vocabulary(int(tokens.sum()), 80, 0, {}, tokens, np.ones(hmm_lm.CLASSES))
    seen = []

    def counts(model):  # all of them at once
        found = hmm_lm.expected(values, np.array([i % 3 > 0 for i in range(len(values))]), model)
        seen.append(found[3])
        return found

    background = (tokens + 0.5) / (tokens + 0.5).sum()
    noise = np.exp(0.7 * np.random.default_rng(3).standard_normal((hmm_lm.CLASSES, hmm_lm.STATES)))
    first = hmm_lm.improved(np.ones(hmm_lm.STATES), np.full((hmm_lm.STATES, hmm_lm.STATES), 1.0) + 60 * np.eye(hmm_lm.STATES), 1000 * background[:, None] * noise, background)
    model, whole = hmm_lm.train(table, vocab), hmm_lm.fitted(first, background, counts)
    assert np.allclose(model.move, whole.move, rtol=1e-2, atol=1e-4) and np.allclose(model.emit, whole.emit, rtol=1e-2, atol=1e-5)
    assert len(seen) == hmm_lm.ROUNDS and seen[-1] > seen[0]


def test_long_steps_that_lose_are_taken_back():
    k, draw = hmm_lm.STATES, np.random.default_rng(1)
    background = np.full(hmm_lm.CLASSES, 1 / hmm_lm.CLASSES)
    start = hmm_lm.improved(np.ones(k), np.ones((k, k)), draw.random((hmm_lm.CLASSES, k)), background)
    likelihoods, asked = iter([-5.0, -9.0, -4.0, -3.0, -2.0, -1.0]), []

    def counts(model):
        asked.append(model)
        return np.ones(k), np.full((k, k), 5.0), draw.random((hmm_lm.CLASSES, k)), next(likelihoods)

    hmm_lm.fitted(start, background, counts)
    assert not np.allclose(asked[1].emit, asked[2].emit) and np.allclose(asked[2].start, np.full(k, 1 / k))


def test_words_are_split_and_classed_as_python_does_for_less(odd_texts):
    draw = random.Random(6)
    texts = [*odd_texts, "  A bÉ\x0b\x0cC\x1fd\x85E  x y\r\n", *["q" * n for n in range(1, 20)], *("é" * n for n in range(1, 9))]
    texts += [" ".join(f"w{draw.randrange(200_000)}" for _ in range(500)) for _ in range(600)]
    frequent = {b"word": 0, b"one": 1, "é".encode(): 2, b"qqq": 3}
    least = {}
    for _ in range(3):
        began = time.process_time()
        plain = [text.encode().lower().split() if text else [] for text in texts]
        classes = [[frequent[w] if w in frequent else hmm_lm.shape(w) for w in words] for words in plain]
        done = time.process_time()
        words, sizes = hmm_lm.words_of(pa.array(texts))
        found = hmm_lm.classes_of(words, pa.array(list(frequent), pa.binary()))
        took = {"plain": done - began, "arrow": time.process_time() - done}
        least = {name: min(seconds, least.get(name, seconds)) for name, seconds in took.items()}
    assert words.to_pylist() == [w for words in plain for w in words] and sizes.tolist() == list(map(len, plain))
    assert [values.tolist() for values in hmm_lm.with_ends(found, sizes)] == [[*values, hmm_lm.END] for values in classes]
    part = words.slice(3, 400)  # an array that begins inside its buffers
    assert hmm_lm.classes_of(part, pa.array(list(frequent), pa.binary())).tolist() == [c for values in classes for c in values][3:403]
    assert least["arrow"] < 0.5 * least["plain"]


def test_scores_of_words_with_and_without_counts():
    draw = np.random.default_rng(7)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    k = hmm_lm.STATES
    model = hmm_lm.Model(norm(draw.random(k), 0), norm(draw.random((k, k)), 1), norm(draw.random((hmm_lm.CLASSES, k)), 0))
    vocab = hmm_lm.Vocabulary(900, 30, 40, {b"a": 0, b"b": 1}, draw.integers(1, 50, hmm_lm.CLASSES).astype(float), draw.integers(1, 9, hmm_lm.CLASSES).astype(float))
    counts = {b"a": 300, b"b": 200, b"rare": 3}
    texts = [" A b  rare b", None, "", "new words", "rare"]
    n, known, base, score = hmm_lm.score_texts(pa.array(texts), pa.array(list(counts), pa.binary()), np.array(list(counts.values())), vocab, model)
    whole = 900 + 0.5 * 31
    for i, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        c = np.array([counts.get(w, 0) for w in words])
        kind = np.array([vocab.frequent.get(w, hmm_lm.shape(w)) for w in words], int)
        inside = sum(np.log10((m + 0.5) / (vocab.class_tokens[j] + 0.5 * (vocab.class_words[j] + 1))) for m, j in zip(c, kind, strict=True) if j >= hmm_lm.FREQUENT)
        assert n[i] == len(words) + 1 and known[i] == (c > 0).sum() + 1
        assert base[i] == pytest.approx(np.log10((np.append(c, 40) + 0.5) / whole).sum())
        assert score[i] == pytest.approx(inside + hmm_lm.forward([np.append(kind, hmm_lm.END)], model)[0] / np.log(10))
