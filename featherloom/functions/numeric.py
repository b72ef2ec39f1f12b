"""Numbers under one policy: NaN, infinities and divisions by zero are null until the clean stage makes them 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """A double, null instead of NaN and infinities."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def cleaned(c: Column) -> Column:
    """A double, 0 instead of null, NaN and infinities; text that isn't a number counts as null."""
    return F.coalesce(finite(c.try_cast("double")), F.lit(0.0))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _count(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])


def row_sum(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs])


def row_mean(cs: list[Column]) -> Column:
    """The mean of what isn't null."""
    return divide(row_sum(cs), _count(cs))


def row_var(cs: list[Column], ddof: int = 1) -> Column:
    mean = row_mean(cs)
    squares = reduce(lambda a, b: a + b, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cs])
    return F.when(_count(cs) > ddof, divide(squares, _count(cs) - ddof))


def row_std(cs: list[Column], ddof: int = 1) -> Column:
    return F.sqrt(row_var(cs, ddof))


def row_max(cs: list[Column]) -> Column:
    return F.greatest(*cs) if len(cs) > 1 else cs[0]


def row_min(cs: list[Column]) -> Column:
    return F.least(*cs) if len(cs) > 1 else cs[0]


def row_entropy(cs: list[Column]) -> Column:
    """-sum p ln p over the positive ones, p being the share of the row's sum."""
    total = row_sum(cs)
    part = [F.when((c > 0) & (total > 0), -divide(c, total) * F.log(divide(c, total))).otherwise(0.0) for c in cs]
    return reduce(lambda a, b: a + b, part)


def row_product(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, [F.coalesce(c.cast("double"), F.lit(1.0)) for c in cs])


def row_median(cs: list[Column]) -> Column:
    """The median of what isn't null."""
    held = F.sort_array(F.array_compact(F.array(*[c.cast("double") for c in cs])))
    n = F.size(held)
    low, high = (F.get(held, F.floor((n + k) / 2 - 1).cast("int")) for k in (1, 2))
    return (low + high) / 2


def _row_moments(cs: list[Column], power: int) -> Column:
    mean = row_mean(cs)
    return divide(reduce(lambda a, b: a + b, [F.coalesce(F.pow(c - mean, F.lit(float(power))), F.lit(0.0)) for c in cs]), _count(cs))


def row_skew(cs: list[Column], sample: bool = True) -> Column:
    """Skewness of what isn't null, corrected for a sample or of the population; null of fewer than three or of equal values."""
    n = _count(cs).cast("double")
    own = divide(_row_moments(cs, 3), F.nullif(F.pow(_row_moments(cs, 2), F.lit(1.5)), F.lit(0.0)))
    return F.when(n > 2, own * F.sqrt(n * (n - 1)) / (n - 2)) if sample else own


def row_kurtosis(cs: list[Column], sample: bool = True) -> Column:
    """Excess kurtosis of what isn't null, corrected for a sample or of the population; null of fewer than four or of equal values."""
    n = _count(cs).cast("double")
    squares = _row_moments(cs, 2)
    own = divide(_row_moments(cs, 4), F.nullif(squares * squares, F.lit(0.0))) - 3
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * own + 6)) if sample else own
