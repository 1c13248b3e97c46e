"""Exact quantiles with linear interpolation, none of whose tasks or rows holds all values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import Store

#: Groups of at most so many distinct values go to Spark's own exact aggregate, whose buffer they bound.
SMALL = 20_000
#: Bits of the value that a round settles.
ROUND = 16


def ordered_bits(v: Column) -> Column:
    """A long that orders as the doubles do, one for each double (0 and -0 share theirs): exponent and mantissa of its size, with its sign."""
    size = F.abs(v)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    # a logarithm may be rounded across a power of two
    e = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(size >= 2 * F.pow(F.lit(2.0), guess), guess + 1).otherwise(guess)
    normal = (e + 1023) * F.lit(1 << 52) + ((size / F.pow(F.lit(2.0), e) - 1) * float(1 << 52)).cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0**-1022, tiny).otherwise(normal)
    return F.when(v < 0, -bits).otherwise(bits)


def value_counts(df: DataFrame, value: Column, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """by, v, c: rows, or the sum of their weights, per distinct value, combined before the shuffle; nulls and NaN are left out."""
    c = F.lit(1).cast("long") if weight is None else weight.cast("long")
    d = df.select(*by, value.cast("double").alias("v"), c.alias("c")).where("v is not null and not isnan(v) and c > 0")
    return d.groupBy(*by, "v").agg(F.sum("c").alias("c"))


def quantiles(df: DataFrame, value: Column, probs: Sequence[float], by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """by and q, an array with one quantile per probability; nulls and NaN are left out. The columns by hold no nulls.

    df is evaluated once, for its value counts, which are written. Where every group has few distinct values Spark's own
    percentile() takes them with their counts; else each round counts the values by the next 16 bits of ordered_bits(), among
    those that share the bits settled so far with a wanted rank, so that four rounds end at the values themselves. A round's
    histogram has at most 65,536 rows for each wanted rank, whatever the number of rows.
    """
    by = list(by)
    store = Store(df.sparkSession)
    counts = store.table("counts", lambda: value_counts(df, value, by, weight))
    most = counts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= SMALL:
        d = counts.groupBy(*by).agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in probs]), F.col("c")).alias("q"))
        return d if by else d.where("q is not null")
    return by_rounds(counts, probs, by, store)


def by_rounds(counts: DataFrame, probs: Sequence[float], by: list[str], store: Store) -> DataFrame:
    """quantiles() of value counts (by, v, c) by rounds of histograms."""
    keyed = counts.withColumn("k", ordered_bits(F.col("v")))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    sizes = store.table("sizes", lambda: counts.groupBy(*by).agg(F.sum("c").alias("n")))
    state = store.table("ranks", lambda: sizes.select(*by, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix")))
    for shift in range(64 - ROUND, -1, -ROUND):
        shared = F.shiftright("k", shift + ROUND) if shift + ROUND < 64 else F.lit(0).cast("long")
        d = keyed.withColumn("prefix", shared)
        if shift + ROUND < 64:  # else all values are in question
            d = d.join(state.select(*by, "prefix").distinct(), [*by, "prefix"])
        hist = d.groupBy(*by, "prefix", F.shiftright("k", shift).alias("next")).agg(F.sum("c").alias("c"), F.min("v").alias("v"))
        upto = F.sum("c").over(Window.partitionBy(*by, "prefix").orderBy("next"))
        hist = hist.withColumn("upto", upto)
        j = state.drop("v").join(hist, [*by, "prefix"]).where((F.col("rank") >= F.col("below") + F.col("upto") - F.col("c")) & (F.col("rank") < F.col("below") + F.col("upto")))
        new = j.select(*by, "rank", (F.col("below") + F.col("upto") - F.col("c")).alias("below"), F.col("next").alias("prefix"), "v")
        state = store.table(f"round{shift}", lambda new=new: new)
    at = state.select(*by, "rank", "v")
    wanted = sizes.select(*by, F.posexplode(F.array(*[place(p) for p in probs])).alias("i", "place"))
    for name, f in (("first", F.floor), ("second", F.ceil)):
        own = at.withColumnsRenamed({"rank": f"_{name}", "v": name})
        wanted = wanted.withColumn(f"_{name}", f("place").cast("long")).join(own, [*by, f"_{name}"])
    q = F.col("first") + (F.col("second") - F.col("first")) * (F.col("place") - F.floor("place"))
    each = wanted.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, q)).alias(f"q{i}") for i in range(len(probs))])
    return each.select(*by, F.array(*[F.col(f"q{i}") for i in range(len(probs))]).alias("q"))
