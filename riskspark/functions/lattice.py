"""The exact distribution of the two-sample Kolmogorov-Smirnov distance, by counting lattice paths in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest product and sum of the samples' sizes that are counted; beyond, the asymptotic tail holds.
MOST, LONGEST = 10_000, 1_000


def distance(x: Column, y: Column) -> Column:
    """The distance of two samples, given as arrays, in units of 1 / (n * m): a whole number."""
    n, m = F.size(x), F.size(y)
    upto = lambda a, v: F.size(F.filter(a, lambda e: e <= v))
    return F.array_max(F.transform(F.concat(x, y), lambda v: F.abs(upto(x, v).cast("long") * m - upto(y, v).cast("long") * n)))


def exact_tail(far: Column, n: Column, m: Column) -> Column:
    """The probability of a distance of at least `far` units for samples of n and m without ties.

    A merged sample is a path from (0, 0) to (n, m) over steps to the right and up; it stays nearer than far where
    |i * m - j * n| < far all along. Row i of the lattice holds the numbers of such paths to (i, 0) ... (i, m); each is the
    sum of those below and to the left. Null beyond MOST and LONGEST.
    """
    inside = lambda i, j: F.abs(i * m - j * n) < far

    def row(below: Column, i: Column) -> Column:
        add = lambda done, j: F.array_append(done, F.when(inside(i, j), F.get(below, j) + F.coalesce(F.get(done, j - 1), F.lit(0.0))).otherwise(0.0))
        return F.aggregate(F.sequence(F.lit(0), m), F.array().cast("array<double>"), add)

    first = F.aggregate(F.sequence(F.lit(0), m), F.array().cast("array<double>"), lambda done, j: F.array_append(done, F.when(inside(F.lit(0), j) & (F.coalesce(F.get(done, j - 1), F.lit(1.0)) > 0), 1.0).otherwise(0.0)))
    stay = F.element_at(F.aggregate(F.sequence(F.lit(1), n), first, row), -1)
    all_ = F.aggregate(F.sequence(F.lit(1), m), F.lit(1.0), lambda p, j: p * (n + j) / j)
    fits = (n * m <= MOST) & (n + m <= LONGEST) & (n > 0) & (m > 0)
    return F.when(fits, F.greatest(F.lit(0.0), 1 - stay / all_))
