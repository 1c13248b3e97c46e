"""Running sums in the order of a value, whose tasks hold one range of values each, as many ranges as the rows ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about.
PER_RANGE = 100_000


def running(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), per_range: int = PER_RANGE) -> DataFrame:
    """Adds upto_<column> for each of sums: its sum over the rows of the group whose value is at most the row's, and next, the next value.

    df is a written table with one row per value of a group, none of them null; it is read a few times. Quantiles of a
    sample sketch cut the values into ranges; sums before a range come from the ranges' totals, a row each.
    """
    by = list(by)
    n = df.count()
    k = max(1, -(-n // per_range))
    if k == 1:
        cut = df.withColumn("_range", F.lit(0))
    else:
        cuts = df.agg(F.percentile_approx(value, [i / k for i in range(1, k)], 10 * k).alias("_cuts"))  # one row of k values
        cut = df.crossJoin(F.broadcast(cuts)).withColumn("_range", place(F.col(value), k)).drop("_cuts")
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    t = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_before_{c}") for c in sums], F.min(value).alias("_first"))
    t = t.select(*by, "_range", *[F.coalesce(F.sum(f"_before_{c}").over(upto), F.lit(0)).alias(f"_before_{c}") for c in sums], F.lead("_first").over(Window.partitionBy(*by).orderBy("_range")).alias("_first"))
    w = Window.partitionBy(*by, "_range").orderBy(value)
    d = cut.join(t, [*by, "_range"])
    added = [(F.col(f"_before_{c}") + F.sum(c).over(w)).alias(f"upto_{c}") for c in sums]
    return d.select(*df.columns, *added, F.coalesce(F.lead(value).over(w), F.col("_first")).alias("next"))


def place(v: F.Column, k: int) -> F.Column:
    """How many of the k - 1 sorted values in the array _cuts are at most v, in log2(k) steps a row."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(k.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(k - 1).alias("hi")), lambda s, _: _halved(s, v), lambda s: s["lo"])


def _halved(s: F.Column, v: F.Column) -> F.Column:
    """One step of a binary search for the number of cuts that are at most v."""
    mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    above = F.coalesce(F.get("_cuts", mid) <= v, F.lit(False))
    stay = s["lo"] >= s["hi"]
    return F.struct(F.when(stay, s["lo"]).when(above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(stay, s["hi"]).when(above, s["hi"]).otherwise(mid).alias("hi"))
