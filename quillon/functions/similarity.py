"""Similarity of strings and of sets (ARRAY columns), and edit distance tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col


def _both(a: ColumnLike, b: ColumnLike) -> tuple[Column, Column, Column]:
    a, b = F.array_distinct(col(a)), F.array_distinct(col(b))
    return F.size(a), F.size(b), F.size(F.array_intersect(a, b))


def dice(a: ColumnLike, b: ColumnLike) -> Column:
    """2 |a & b| / (|a| + |b|); null for two empty sets."""
    x, y, m = _both(a, b)
    return F.when(x + y > 0, 2 * m / (x + y))


def jaccard(a: ColumnLike, b: ColumnLike) -> Column:
    x, y, m = _both(a, b)
    return F.when(x + y > 0, m / (x + y - m))


def jaccard_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return 1 - jaccard(a, b)


def tversky(a: ColumnLike, b: ColumnLike, alpha: float, beta: float) -> Column:
    x, y, m = _both(a, b)
    return F.when(m + alpha * (x - m) + beta * (y - m) > 0, m / (m + alpha * (x - m) + beta * (y - m)))


def frequency_jaccard(a: ColumnLike, b: ColumnLike) -> Column:
    """Sum of the common elements over the sum of all, of numeric sets."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return add(F.array_intersect(col(a), col(b))) / add(F.array_union(col(a), col(b)))


def ngrams(s: ColumnLike, n: int) -> Column:
    """Every n-gram of a string in order; none for null and shorter strings. One scan: each match is a character that n - 1 others follow, so time is linear in the length."""
    return F.coalesce(F.regexp_extract_all(col(s), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), F.array().cast("array<string>"))


def letter_pairs(s: ColumnLike, n: int = 2) -> Column:
    return F.array_distinct(ngrams(s, n))


def word_letter_pairs(s: ColumnLike, n: int = 2) -> Column:
    """Distinct n-grams of the words between spaces."""
    return F.array_distinct(F.flatten(F.transform(F.split(col(s), " "), lambda w: ngrams(w, n))))


def bi_tri_grams(s: ColumnLike) -> Column:
    return F.array_union(letter_pairs(s, 2), letter_pairs(s, 3))


def all_grams(s: ColumnLike) -> Column:
    """Distinct n-grams for n from 1 to one less than the length."""
    n = F.length(col(s))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(col(s), i, k))))
    return F.when(n > 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def ngram_compare(a: ColumnLike, b: ColumnLike, n: int = 2, uppercase: bool = False) -> Column:
    """Dice over the n-grams of words."""
    a, b = (F.upper(col(a)), F.upper(col(b))) if uppercase else (col(a), col(b))
    return dice(word_letter_pairs(a, n), word_letter_pairs(b, n))


def normed_codepoints(s: ColumnLike) -> Column:
    """a to 0 ... z to 25, space 27, others 28."""
    code = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).when(c == " ", 27).otherwise(28)
    return F.when(F.length(col(s)) > 0, F.transform(F.split(col(s), ""), lambda c: code(c))).otherwise(F.array().cast("array<int>"))


def ngram_vector(s: ColumnLike) -> Column:
    """The 0/1 vector of bigrams over 28 codes, 784 places, as its sorted list of set places (codes of 28 count as 27)."""
    codes = F.transform(normed_codepoints(s), lambda c: F.least(c, F.lit(27)))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(codes) - 1, F.lit(1))), lambda i: F.get(codes, i - 1) * 28 + F.get(codes, i))
    return F.when(F.size(codes) > 1, F.array_sort(F.array_distinct(pairs))).otherwise(F.array().cast("array<int>"))


def levenshtein(a: ColumnLike, b: ColumnLike, most: int | None = None) -> Column:
    """Unit-cost edit distance; null above `most` if given."""
    if most is None:
        return F.levenshtein(col(a), col(b))
    d = F.levenshtein(col(a), col(b), most)
    return F.when(d >= 0, d)


def redundant(kept: ColumnLike, s: ColumnLike, shorter: float = 0.7, identity: float = 0.9) -> Column:
    """Whether s repeats a kept sequence: long enough beside it, and the identity from their edit distance at or above the cut."""
    k, n = F.length(col(kept)), F.length(col(s))
    return (n > shorter * k) & (F.abs(F.levenshtein(col(kept), col(s)) - k) / k >= identity)


def redundant_by_grams(kept: ColumnLike, s: ColumnLike, n: int = 4, cut: float = 0.85, shorter: float = 0.7) -> Column:
    return (F.length(col(s)) > shorter * F.length(col(kept))) & (F.coalesce(ngram_compare(kept, s, n), F.lit(0.0)) >= cut)
