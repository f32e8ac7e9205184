"""Genome coordinates: entries `name/start-end/strand`, relative positions, context windows, interval tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col

OPEN_END = 9223372036854775807


def entry_parts(entry: ColumnLike, left: int = 0, right: int = 0) -> Column:
    """Struct (name, start, end, strand) of an entry; separators `/`, `:` or a space, an optional leading c.

    Without a strand, start > end means -1; start < end is then enforced. Deltas widen, and a start below 1 becomes 1. Without a
    range: 1 to the largest long, strand 1.
    """
    e = col(entry)
    name = F.regexp_extract(e, r"^([^/: ]+)", 1)
    pattern = r"[/: ]c?([0-9]+)-([0-9]+)"
    ranged = e.rlike(pattern)
    s, t = F.regexp_extract(e, pattern, 1).try_cast("long"), F.regexp_extract(e, pattern, 2).try_cast("long")
    given = F.regexp_extract(e, r"[0-9]+-[0-9]+[/: ](-?1)\s*$", 1)
    strand = F.when(given != "", given).when(s > t, "-1").otherwise("1")
    start = F.least(s, t) - left
    return F.when(ranged, F.struct(name.alias("name"), F.when(start <= 0, 1).otherwise(start).alias("start"), (F.greatest(s, t) + right).alias("end"), strand.alias("strand"))).otherwise(
        F.struct(name.alias("name"), F.lit(1).cast("long").alias("start"), F.lit(OPEN_END).cast("long").alias("end"), F.lit("1").alias("strand"))
    )


def make_entry(name: ColumnLike, start: ColumnLike, end: ColumnLike, strand: ColumnLike) -> Column:
    return F.concat(col(name), F.lit("/"), col(start).cast("string"), F.lit("-"), col(end).cast("string"), F.lit("/"), col(strand).cast("string"))


def has_location(entry: ColumnLike) -> Column:
    return col(entry).rlike("[0-9]+-[0-9]+")


def entry_location(entry: ColumnLike) -> Column:
    """`s-e` of an entry, swapped for strand -1; the whole sequence where none is given."""
    p = entry_parts(entry)
    return F.when(p["strand"] == "-1", F.concat_ws("-", p["end"].cast("string"), p["start"].cast("string"))).otherwise(F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string")))


def without_locations(s: ColumnLike) -> Column:
    """Leading and trailing coordinates stripped."""
    return F.regexp_replace(F.regexp_replace(col(s), r"^\s*[0-9]+\s*", ""), r"\s*[0-9]+\s*$", "")


def slice_of(seq: ColumnLike, start: ColumnLike, end: ColumnLike, strand: ColumnLike, rna: bool = False) -> Column:
    """1-based inclusive slice, reverse-complemented on strand -1, T as U if asked."""
    from .sequences import reverse_complement

    part = F.substring(col(seq), col(start).cast("int"), (col(end) - col(start) + 1).cast("int"))
    turned = F.when(col(strand).cast("string") == "-1", reverse_complement(part)).otherwise(part)
    return F.translate(turned, "Tt", "Uu") if rna else turned


def hit_location(seq_start: ColumnLike, seq_end: ColumnLike, hit_start: ColumnLike, hit_end: ColumnLike, strand: ColumnLike) -> Column:
    """Relative hit to absolute [start, end]: forward ss + hs - 1 to ss + he; backward ss - hs to ss - he + 1."""
    ss, hs, he = col(seq_start), col(hit_start), col(hit_end)
    return F.when(col(strand) >= 0, F.array(ss + hs - 1, ss + he)).otherwise(F.array(ss - hs, ss - he + 1))


def context_window(start: ColumnLike, end: ColumnLike, strand: ColumnLike, delta: ColumnLike) -> Column:
    """Struct (start, end): delta added on the 3' side and a quarter of the length (rounded up) on the other; at least 1."""
    s, e, d = col(start), col(end), col(delta)
    quarter = F.ceil((e - s + 1) / 4)
    back = col(strand).cast("string") == "-1"
    return F.struct(F.greatest(F.when(back, s - d).otherwise(s - quarter), F.lit(1)).cast("long").alias("start"), F.when(back, e + quarter).otherwise(e + d).cast("long").alias("end"))


def open_closed(a: ColumnLike, b: ColumnLike, c: ColumnLike) -> Column:
    """a < b <= c."""
    return (col(a) < col(b)) & (col(b) <= col(c))


def closed_open(a: ColumnLike, b: ColumnLike, c: ColumnLike) -> Column:
    return (col(a) <= col(b)) & (col(b) < col(c))


def between(x: ColumnLike, y: ColumnLike, z: ColumnLike) -> Column:
    """x < y <= z or z <= y < x."""
    return open_closed(x, y, z) | closed_open(z, y, x)


def closer(x: ColumnLike, y: ColumnLike, z: ColumnLike) -> Column:
    """Whichever of y and z is nearer x; the smaller of a tie."""
    low, high = F.least(col(y), col(z)), F.greatest(col(y), col(z))
    return F.when(F.abs(col(x) - low) <= F.abs(col(x) - high), low).otherwise(high)


def hit_between(strand: ColumnLike, low: ColumnLike, at: ColumnLike, high: ColumnLike) -> Column:
    """(low, high] on the forward strand, [low, high) on the other."""
    return F.when(col(strand) >= 0, open_closed(low, at, high)).otherwise(closed_open(low, at, high))


def overlap(s1: ColumnLike, e1: ColumnLike, s2: ColumnLike, e2: ColumnLike) -> Column:
    """Positions that two closed intervals share, 0 if apart."""
    return F.greatest(F.least(col(e1), col(e2)) - F.greatest(col(s1), col(s2)) + 1, F.lit(0))


def duplicate_location(s1: ColumnLike, e1: ColumnLike, s2: ColumnLike, e2: ColumnLike, cutoff: float = 0.8) -> Column:
    """Whether one interval contains the other, or their overlap is at least cutoff of their mean length."""
    s1, e1, s2, e2 = (col(x) for x in (s1, e1, s2, e2))
    inside = ((s1 <= s2) & (e2 <= e1)) | ((s2 <= s1) & (e1 <= e2))
    return inside | (overlap(s1, e1, s2, e2) / ((e1 - s1 + e2 - s2 + 2) / 2) >= cutoff)


def trimmed_alignment(seq: ColumnLike, start: ColumnLike, end: ColumnLike, strand: ColumnLike, left: int, right: int) -> Column:
    """Struct (seq, start, end) of an aligned sequence without its first `left` and last `right` columns: coordinates move by its residues only, by strand."""
    from .sequences import gap_count

    s = col(seq)
    n = F.length(s)
    head, tail = F.substring(s, 1, left), F.substring(s, n - right + 1, F.lit(right))
    a, b = left - gap_count(head), right - gap_count(tail)
    back = col(strand).cast("string") == "-1"
    kept = F.substring(s, F.lit(left + 1), n - left - right)
    return F.struct(kept.alias("seq"), (col(start) + F.when(back, b).otherwise(a)).alias("start"), (col(end) - F.when(back, a).otherwise(b)).alias("end"))


def sto_version(name: ColumnLike) -> Column:
    """N of `-N.sto`, 0 without."""
    return F.coalesce(F.regexp_extract(col(name), r"-([0-9]+)\.sto$", 1).try_cast("int"), F.lit(0))


def next_sto_name(name: ColumnLike) -> Column:
    return F.concat(F.regexp_replace(col(name), r"(-[0-9]+)?\.sto$", ""), F.lit("-"), (sto_version(name) + 1).cast("string"), F.lit(".sto"))
