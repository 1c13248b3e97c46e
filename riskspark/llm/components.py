"""Connected components of a link table by alternating large-star and small-star steps, each one join and one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b), a > b: each node's other ends are linked to the least node beside it instead.

    The join's rows are a few dozen bytes, so a node of millions of links is one that adaptive execution splits.
    """
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    j = both.join(least, "a")
    new = j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    new = new.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return new if large else new.distinct()  # a large step makes no more rows than it has links; the small one that follows clears repeats


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): for every node of links (a, b), the least node that it reaches, in the order of the nodes' type."""
    folder = scratch(links.sparkSession)
    at = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links0", folder)
    for k in range(1, most):
        # done when the links are stars: nobody who is the far end of a link is the near end of another, or has two
        ends = at.select(F.col("a").alias("node"), F.lit(1).alias("far"), F.lit(0).alias("near")).unionByName(at.select(F.col("b").alias("node"), F.lit(0).alias("far"), F.lit(1).alias("near")))
        if ends.groupBy("node").agg(F.sum("far").alias("far"), F.max("near").alias("near")).where("far > 1 or far > 0 and near > 0").isEmpty():
            break
        at = written(_star(_star(at, True), False), f"links{k}", folder)
        discard(links.sparkSession, f"{folder}/links{k - 1}")
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
