"""Biological sequences as strings: gaps, complements, translation, chunks, random sequences."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col

# Alphabets, ambiguity codes, the standard genetic code and base-pair weights.
GAPS = ".-"
ALPHABETS = {"dna": "ATGC", "rna": "AUGC", "amino": "ACDEFGHIKLMNPQRSTVWY"}
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "U", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT_FROM, COMPLEMENT_RNA, COMPLEMENT_DNA = "ACGTURYKMBVDHSWN", "UGCAAYRMKVBHDSWN", "TGCAAYRMKVBHDSWN"
RY = ("AGCUT", "RRYYY")
BASES = "UCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = {"UAA": "", "UAG": "PY", "UGA": "SE"}
AMINO_NAMES = {
    "A": "alanine", "C": "cysteine", "D": "aspartic acid", "E": "glutamic acid", "F": "phenylalanine", "G": "glycine", "H": "histidine", "I": "isoleucine", "K": "lysine",
    "L": "leucine", "M": "methionine", "N": "asparagine", "P": "proline", "Q": "glutamine", "R": "arginine", "S": "serine", "T": "threonine", "V": "valine", "W": "tryptophan", "Y": "tyrosine",
}
PAIR_SCORES = {"GC": 1.0, "CG": 1.0, "AU": 0.95, "UA": 0.95, "GU": 0.80, "UG": 0.80}


def codon_map(rna: bool = True) -> dict[str, str]:
    """The 64 codons, from the order of bases; stop codons have the codes of STOPS."""
    codons = ["".join(c) for c in product(BASES, repeat=3)]
    out = {c: STOPS.get(c, a) for c, a in zip(codons, AMINO, strict=True)}
    return out if rna else {c.replace("U", "T"): a for c, a in out.items()}


def reverse_codon_map() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for codon, amino in codon_map().items():
        out.setdefault(amino, []).append(codon)
    return out


def normed(s: ColumnLike) -> Column:
    return F.upper(col(s))


def gap_count(s: ColumnLike, gaps: str = GAPS) -> Column:
    return (F.length(col(s)) - F.length(F.translate(col(s), gaps, ""))).cast("long")


def gap_fraction(s: ColumnLike, gaps: str = GAPS) -> Column:
    """Share of gap characters; null for the empty string."""
    return F.when(F.length(col(s)) > 0, gap_count(s, gaps) / F.length(col(s)))


def has_gap(s: ColumnLike, gaps: str = GAPS) -> Column:
    return gap_count(s, gaps) > 0


def degap(s: ColumnLike, gaps: str = GAPS) -> Column:
    return F.translate(col(s), gaps, "")


def reverse_complement(s: ColumnLike) -> Column:
    """RNA complements where the sequence has a U, else DNA; characters without a complement vanish."""
    known = F.regexp_replace(F.reverse(col(s)), f"[^{COMPLEMENT_FROM}]", "")
    return F.when(F.contains(col(s), F.lit("U")), F.translate(known, COMPLEMENT_FROM, COMPLEMENT_RNA)).otherwise(F.translate(known, COMPLEMENT_FROM, COMPLEMENT_DNA))


def translated(s: ColumnLike, mapping: tuple[str, str] = RY) -> Column:
    """Degapped, then mapped character by character; others stay."""
    return F.translate(degap(s), *mapping)


def amino_acids(s: ColumnLike, stop: bool = True, rna: bool = True) -> Column:
    """Codon translation; null where the length is no multiple of 3. With stop, the last codon is dropped."""
    table = F.create_map(*[F.lit(x) for pair in codon_map(rna).items() for x in pair])
    codons = F.regexp_extract_all(col(s), F.lit("(?s)..."), F.lit(0))
    if stop:
        codons = F.slice(codons, F.lit(1), F.greatest(F.size(codons) - 1, F.lit(0)))
    return F.when(F.length(col(s)) % 3 == 0, F.array_join(F.transform(codons, lambda c: table[c]), ""))


def chunks(s: ColumnLike, n: int, step: int | None = None, pad: str | None = None) -> Column:
    """Substrings of n characters every step; the last may be short unless pad supplies characters."""
    every = F.transform(F.sequence(F.lit(1), F.length(col(s)), F.lit(step or n)), lambda i: F.substring(col(s), i, F.lit(n)))
    if pad is not None:
        every = F.transform(every, lambda c: F.substring(F.concat(c, F.lit(pad)), 1, n))
    return F.when(F.length(col(s)) > 0, every).otherwise(F.array().cast("array<string>"))


def is_digits(s: ColumnLike) -> Column:
    return col(s).rlike("^[0-9]+$")


def less_ignoring_case(a: ColumnLike, b: ColumnLike) -> Column:
    return F.lower(col(a)) < F.lower(col(b))


def greater_ignoring_case(a: ColumnLike, b: ColumnLike) -> Column:
    return F.lower(col(a)) > F.lower(col(b))


def equal_ignoring_case(a: ColumnLike, b: ColumnLike) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def random_sequence(alphabet: str, size: ColumnLike, seed: int, key: ColumnLike = "id") -> Column:
    """A uniform random sequence that depends on the seed and the row's key only, so a task that runs again draws the same."""
    pick = lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64(F.lit(seed), col(key), i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), col(size).cast("int")), pick), "")


def skewed_sequence(size: ColumnLike, gc_at: float, at: float, gc: float, seed: int, key: ColumnLike = "id") -> Column:
    """A random sequence with P(G or C) = gc_at, P(A | A or T) = at and P(G | G or C) = gc."""
    uniform = lambda i, salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), col(key), i), F.lit(1 << 30)) / float(1 << 30)
    base = lambda i: F.when(uniform(i, 1) < gc_at, F.when(uniform(i, 2) < gc, "G").otherwise("C")).otherwise(F.when(uniform(i, 2) < at, "A").otherwise("T"))
    return F.array_join(F.transform(F.sequence(F.lit(1), col(size).cast("int")), base), "")


def pairings(s: ColumnLike, min_distance: int = 4) -> Column:
    """[{i, j, score}, ...]: positions (0-based) more than min_distance apart that pair; score = distance / length * pair weight."""
    table = F.create_map(*[F.lit(x) for pair in PAIR_SCORES.items() for x in pair])
    n = F.length(col(s))
    pair = lambda i, j: table[F.concat(F.substring(col(s), i, F.lit(1)), F.substring(col(s), j, F.lit(1)))]
    every = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n), lambda j: F.when(j - i > min_distance, F.struct((i - 1).alias("i"), (j - 1).alias("j"), ((j - i) / n * pair(i, j)).alias("score"))))))
    return F.filter(every, lambda x: x.isNotNull() & x["score"].isNotNull())


def skew_ratios(a: ColumnLike, c: ColumnLike, g: ColumnLike, t: ColumnLike) -> Column:
    """Struct of GC content and the A and G shares of their pairs, from base counts."""
    at, gc = col(a) + col(t), col(g) + col(c)
    return F.struct((gc / (at + gc)).alias("gc_at"), (col(a) / at).alias("at"), (col(g) / gc).alias("gc"))
