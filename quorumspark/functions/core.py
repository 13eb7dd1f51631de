"""Column builders that give the same values on any engine and with any partitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def u(seed: str, *cols: str) -> Column:
    """A 32-bit hash of (seed, columns) as bigint: the library's only source of randomness."""
    parts = [F.lit(seed), *(F.col(c).cast("string") for c in cols)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def half_up(c: Column) -> Column:
    """floor(x + 0.5) as integer: verdicts and gold labels."""
    return F.floor(c + 0.5).cast("int")


def half_even(c: Column) -> Column:
    """Rounding to the even neighbour at one half: persistence, rounding floor."""
    return F.rint(c)


def six(c: Column) -> Column:
    return F.round(c, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def corr(x: Column, y: Column) -> Column:
    """Correlation of the pairs without a null: NaN where one of the two is constant (as over a single pair), null without pairs. F.corr divides by 0 there, which ANSI mode makes an error."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(constant, F.lit(float("nan"))).otherwise(ratio(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))))


def expectation(dist: Column) -> Column:
    """Mean category sum(i * p) / sum(p) of a ragged array of weights; null for null or empty arrays and sums not above 0."""
    p = F.transform(dist, lambda x: F.coalesce(x, F.lit(0.0)))
    top = F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(dist) > 0) & (total > 0), top / total)


def tempered(dist: Column, t: Column) -> Column:
    """q proportional to p ** (1 / t); t = 0 puts all weight on the first largest category."""
    top = F.array_max(dist)
    first = F.array_position(dist, top)
    q = F.transform(dist, lambda p: F.when(p > 0, F.exp((F.log(p) - F.log(top)) / t)).otherwise(0.0))
    total = F.aggregate(q, F.lit(0.0), lambda s, x: s + x)
    return F.when(t == 0, F.transform(dist, lambda p, i: F.when(i + 1 == first, 1.0).otherwise(0.0))).otherwise(F.transform(q, lambda x: x / total))


def spread_error(dist: Column, target: Column, signed: bool = False) -> Column:
    """Expected |Y - target| (or Y - target) for Y drawn from dist."""
    gap = (lambda i: i - target) if signed else (lambda i: F.abs(i - target))
    return F.aggregate(F.transform(dist, lambda p, i: p * gap(i)), F.lit(0.0), lambda s, x: s + x)
