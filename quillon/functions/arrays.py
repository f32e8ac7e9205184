"""Collections as ARRAY and MAP columns: positions, cuts, combinations, merges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col


def third(c: ColumnLike) -> Column:
    return F.get(col(c), 2)


def drop_until(c: ColumnLike, test: Callable[[Column], Column]) -> Column:
    """What is left from the first element that passes on."""
    first = F.array_position(F.transform(col(c), lambda x: test(x)), True)
    return F.when(first > 0, F.slice(col(c), first.cast("int"), F.size(col(c)))).otherwise(F.slice(col(c), 1, 0))


def take_until(c: ColumnLike, test: Callable[[Column], Column]) -> Column:
    """The elements before the first that passes."""
    first = F.array_position(F.transform(col(c), lambda x: test(x)), True)
    return F.when(first > 0, F.slice(col(c), F.lit(1), (first - 1).cast("int"))).otherwise(col(c))


def take_until_nochange(c: ColumnLike) -> Column:
    """The elements up to and with the first of two equal neighbours."""
    n = F.size(col(c))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(col(c), i) == F.get(col(c), i - 1))
    first = F.array_position(same, True)
    return F.when((n > 1) & (first > 0), F.slice(col(c), F.lit(1), first.cast("int"))).otherwise(col(c))


def contains(c: ColumnLike, x: ColumnLike) -> Column:
    return F.array_contains(col(c), col(x) if not isinstance(x, str) else F.lit(x))


def positions(c: ColumnLike, x: ColumnLike) -> Column:
    """0-based positions of x."""
    return positions_where(c, lambda v: v == (F.lit(x) if not isinstance(x, Column) else x))


def positions_any(c: ColumnLike, xs: ColumnLike) -> Column:
    return positions_where(c, lambda v: F.array_contains(col(xs), v))


def positions_where(c: ColumnLike, test: Callable[[Column], Column]) -> Column:
    marks = F.transform(col(c), lambda v, i: F.when(test(v), i))
    return F.filter(marks, lambda i: i.isNotNull())


def merge_with(f: Callable[[Column, Column, Column], Column], a: ColumnLike, b: ColumnLike) -> Column:
    """Maps merged; where both have a key, f(key, left, right)."""
    both = lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(f(k, x, y))
    return F.map_zip_with(col(a), col(b), both)


def transpose(rows: ColumnLike) -> Column:
    """Rows to columns of an array of arrays, cut to the shortest row."""
    width = F.array_min(F.transform(col(rows), lambda r: F.size(r)))
    turned = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(col(rows), lambda r: F.get(r, i)))
    return F.when(width > 0, turned)


def combinations(c: ColumnLike, k: int) -> Column:
    """All k-combinations by position, in order; [[]] for k = 0, [] where k is too large."""
    if k == 0:
        return F.array(F.array().cast("array<string>"))
    n = F.size(col(c))
    grow = lambda kept: F.flatten(F.transform(kept, lambda ix: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > F.element_at(ix, -1)), lambda j: F.array_append(ix, j))))
    index = reduce(lambda kept, _: grow(kept), range(k - 1), F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.array(j)))
    return F.when(n >= k, F.transform(index, lambda ix: F.transform(ix, lambda j: F.get(col(c), j)))).otherwise(F.slice(F.array(col(c)), 1, 0))


def subsets(c: ColumnLike) -> Column:
    """The power set, by bit patterns; for up to 16 elements."""
    n = F.size(col(c))
    masks = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), n).cast("long") - 1)
    pick = lambda m: F.filter(F.transform(col(c), lambda x, i: F.when(F.getbit(m, i) == 1, F.struct(x.alias("x")))), lambda s: s.isNotNull())
    return F.when(n <= 16, F.transform(masks, lambda m: F.transform(pick(m), lambda s: s["x"])))


def random_subset(c: ColumnLike, n: int, seed: int) -> Column:
    """n distinct elements, those of least seeded hash; all where there are fewer."""
    order = F.array_sort(F.transform(F.array_distinct(col(c)), lambda x: F.struct(F.xxhash64(F.lit(seed), x).alias("h"), x.alias("x"))))
    return F.transform(F.slice(order, 1, max(n, 0)), lambda s: s["x"]) if n > 0 else F.slice(col(c), 1, 0)


def reversible(k: ColumnLike) -> Column:
    """One name for a key and its reverse: the lesser."""
    return F.least(col(k), F.reverse(col(k)))
