"""Arithmetic, logarithms, factorials, primes and probability mass functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col


def div(n: ColumnLike, d: ColumnLike) -> Column:
    """[floor quotient, truncating remainder]; null where d is 0."""
    n, d = col(n), col(d)
    return F.when(d != 0, F.array(F.floor(n / d).cast("long"), (n % d).cast("long")))


def sqr(x: ColumnLike) -> Column:
    return col(x) * col(x)


def logb(base: float, x: ColumnLike) -> Column:
    """Logarithm to a base; null for x <= 0."""
    return F.when(col(x) > 0, F.log(float(base), col(x)))


def ln(x: ColumnLike) -> Column:
    return F.ln(col(x))


def log2(x: ColumnLike) -> Column:
    return F.log2(col(x))


def log10(x: ColumnLike) -> Column:
    return F.log10(col(x))


def logistic(x: ColumnLike) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def logit(p: ColumnLike, base: float = 2.0) -> Column:
    """Log odds, base 2 unless told otherwise; null outside (0, 1)."""
    p = col(p)
    return F.when((p > 0) & (p < 1), F.log(float(base), p / (1 - p)))


def factorial(n: ColumnLike) -> Column:
    """n! as DECIMAL(38,0), exact to 33!; null below 0 and beyond."""
    n = col(n).cast("int")
    product = F.aggregate(F.sequence(F.lit(1), n), F.lit(1).cast("decimal(38,0)"), lambda a, k: (a * k.cast("decimal(10,0)")).cast("decimal(38,0)"))
    return F.when(n == 0, F.lit(1).cast("decimal(38,0)")).when(n.between(1, 33), product)


def factorial_of_difference(n: ColumnLike, k: ColumnLike) -> Column:
    return factorial(col(n) - col(k))


def choose(n: ColumnLike, k: ColumnLike) -> Column:
    """Binomial coefficient as DECIMAL(38,0), exact while n * result fits; 0 where k > n, null for negatives."""
    n, k = col(n).cast("int"), col(k).cast("int")
    least = F.least(k, n - k)
    step = lambda a, i: (a * (n - least + i).cast("decimal(10,0)") / i.cast("decimal(10,0)")).cast("decimal(38,0)")
    run = F.aggregate(F.sequence(F.lit(1), least), F.lit(1).cast("decimal(38,0)"), step)
    return F.when((n < 0) | (k < 0), None).when(k > n, F.lit(0).cast("decimal(38,0)")).when(least == 0, F.lit(1).cast("decimal(38,0)")).otherwise(run)


def is_prime(n: ColumnLike) -> Column:
    """Trial division up to the root, inside the row."""
    n = col(n).cast("long")
    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return F.when(n < 2, False).when(n < 4, True).otherwise(~F.exists(F.sequence(F.lit(2).cast("long"), F.greatest(root, F.lit(2))), lambda d: n % d == 0))


def prime_factors(n: ColumnLike) -> Column:
    """[{p, n}, ...] in rising order; empty below 2. Each divisor up to the root is divided out in turn."""
    n = col(n).cast("long")
    kind = "struct<left:bigint,found:array<struct<p:bigint,n:bigint>>>"
    start = F.struct(n.alias("left"), F.array().cast("array<struct<p:bigint,n:bigint>>").alias("found")).cast(kind)

    def power(left: Column, d: Column) -> Column:
        most = F.floor(F.log(left.cast("double")) / F.log(d.cast("double")) + 1e-9).cast("int")
        return F.size(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda e: F.coalesce(left % F.pow(d.cast("double"), e).try_cast("long") == 0, F.lit(False))))

    def step(acc: Column, d: Column) -> Column:
        times = power(acc["left"], d)
        hit = F.struct((acc["left"] / F.pow(d.cast("double"), times)).cast("long").alias("left"), F.array_append(acc["found"], F.struct(d.alias("p"), times.cast("long").alias("n"))).alias("found"))
        return F.when(acc["left"] % d == 0, hit).otherwise(acc).cast(kind)

    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    done = F.aggregate(F.sequence(F.lit(2).cast("long"), F.greatest(root, F.lit(2).cast("long"))), start, step)
    rest = F.when(done["left"] > 1, F.array_append(done["found"], F.struct(done["left"].alias("p"), F.lit(1).cast("long").alias("n")))).otherwise(done["found"])
    return F.when(n < 2, F.array().cast("array<struct<p:bigint,n:bigint>>")).otherwise(rest)


def binomial_pdf(k: ColumnLike, n: ColumnLike, p: float) -> Column:
    return choose(n, k).cast("double") * F.pow(F.lit(p), col(k)) * F.pow(F.lit(1 - p), col(n) - col(k))


def poisson_pdf(k: ColumnLike, mu: float) -> Column:
    """Mass at k by a running product, so no factorial overflows."""
    k = col(k).cast("int")
    run = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(math.exp(-mu)), lambda a, i: a * F.lit(mu) / i)
    return F.when(k < 0, 0.0).when(k == 0, math.exp(-mu)).otherwise(run)


def poisson_cdf(low: ColumnLike, high: ColumnLike, mu: float) -> Column:
    """Sum of the mass over [low, high)."""
    low, high = col(low).cast("int"), col(high).cast("int")
    return F.when(high > low, F.aggregate(F.transform(F.sequence(low, high - 1), lambda k: poisson_pdf(k, mu)), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def geometric_pdf(k: ColumnLike, p: float) -> Column:
    return F.pow(F.lit(1 - p), col(k)) * F.lit(p)


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / (a + b); null where both are 0."""
    return F.when(col(a) + col(b) != 0, col(a) / (col(a) + col(b)))


def rounded(x: ColumnLike, places: int) -> Column:
    return F.round(col(x), places)


def half_away(x: ColumnLike, places: int) -> Column:
    """x rounded as the double it is, halves away from zero: the product with 10^places is rounded, as SQL engines with binary doubles do. F.round takes the shortest decimal instead."""
    scaled = F.abs(col(x).cast("double")) * float(10**places)
    whole = F.floor(scaled).cast("double")  # exact below 2^53, beyond which there is nothing to round
    up = F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole)
    return F.when(scaled < float(1 << 53), F.signum(col(x).cast("double")) * up / float(10**places)).otherwise(col(x).cast("double")) + 0.0


def log_odds(a: ColumnLike, b: ColumnLike) -> Column:
    return F.log2(col(a) / col(b))


def lod_score(joint: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    """log2 of a joint probability over the product of its parts."""
    return F.log2(col(joint) / (col(a) * col(b)))


def raw_lod_score(joint: ColumnLike, a: ColumnLike, b: ColumnLike, scaling: float = 1.0) -> Column:
    score = lod_score(joint, a, b) * scaling
    return score if scaling == 1.0 else score.cast("int").cast("double")


def rank_score(species: ColumnLike, num: ColumnLike, cons: ColumnLike, bp: ColumnLike, sid: ColumnLike) -> Column:
    """species * sqrt((cons + 0.2) * bp / max(sid, 1)) * (1 + ln(num / species)), by which motif summaries are ranked."""
    return col(species) * F.sqrt((col(cons) + 0.2) * col(bp) / F.greatest(col(sid), F.lit(1))) * (1 + F.ln(col(num) / col(species)))
