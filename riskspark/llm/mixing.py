"""Mixing sources to target weights by subset-sum budget fitting.

A source's documents are counted by exact length (words). Its target is met by whole passes over the source plus a
remaining budget; that is filled by numbers of documents per length: the bulk in proportion to the counts, then the
last words by a bounded-knapsack dynamic program over a bitset of reachable sums. At last as many documents of each
length as were granted are selected in the order of a seeded hash of doc_id.

Nothing grows with the rows in one place: the dynamic program sees one row per distinct length of a source, and the
selection ranks documents through hash ranges (common.ranked), so that a hot source, or a hot length, is split; so are
the rows of a hot length when they learn what it was granted (common.spread_join).

The program keeps its bitsets at every square root of so many steps only and makes the others again on the way back, so
thousands of distinct lengths take a few megabytes.

Defined results: a null text or one of white space only has size 0 and takes 0 words; a very long text counts with all
its words, and the program's window is at least twice the longest; a null source is a source of its own, after all
others; a repeated row counts as a document of its own; rows of null doc_id take part; an empty table gives an empty
result. Columns other than the named ones are carried along unless their names clash with the added ones, which win.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, ordered, ranked, row_hash, spread_join, written

#: Words of a source's budget that the dynamic program, not the proportional bulk, fills; twice its longest document at least.
WINDOW = 16384
MAX_REPEATS = 3
ADDED = ["size", "source_size", "target", "taken"]


def fit(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length to take, at most counts, so that their words come nearest to budget (below, if tied)."""
    total = sum(a * n for a, n in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    longest = max(lengths)
    window = max(window, 2 * longest)
    bulk = max(0, budget - window)
    took = [n * bulk // total for n in counts]
    rest = budget - sum(a * n for a, n in zip(lengths, took, strict=True))
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    for i in order:
        more = min(counts[i] - took[i], max(0, rest - window) // lengths[i])
        took[i] += more
        rest -= more * lengths[i]
    # bounded knapsack: bit s of `sums` is set when s words can be reached; one document may overshoot
    mask = (1 << (rest + longest + 1)) - 1
    items = []  # (length, documents) in powers of two, so that any number up to the count can be put together
    for i in order:
        left, piece = min(counts[i] - took[i], (rest + longest) // lengths[i]), 1
        while left > 0:
            piece = min(piece, left)
            items.append((i, piece))
            left -= piece
            piece *= 2
    unit = math.gcd(*(lengths[i] for i, _ in items)) if items else 1
    best = rest - rest % unit + (unit if 2 * (rest % unit) > unit else 0)  # nothing nearer can be reached
    every = max(1, math.isqrt(len(items)))
    sums, marks, used = 1, [], 0  # marks: the sums before every so many items; those between are made again below
    for at, (i, piece) in enumerate(items):
        if sums >> best & 1:
            break
        if at % every == 0:
            marks.append(sums)
        sums |= sums << piece * lengths[i] & mask
        used = at + 1
    below = (sums & (1 << rest + 1) - 1).bit_length() - 1
    above = sums >> rest
    above = rest + (above & -above).bit_length() - 1 if above else math.inf
    goal = below if rest - below <= above - rest else int(above)
    for k in range(len(marks) - 1, -1, -1):
        block = items[k * every : min(used, (k + 1) * every)]
        before = [marks[k]]
        for i, piece in block[:-1]:
            before.append(before[-1] | before[-1] << piece * lengths[i] & mask)
        for (i, piece), sums in zip(reversed(block), reversed(before), strict=True):
            if not sums >> goal & 1:
                took[i] += piece
                goal -= piece * lengths[i]
    return took


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = MAX_REPEATS) -> DataFrame:
    """Adds target to (skey, source, source_size): the weights repeat in code-point order of the sources, nulls last.

    A target stops at most * source_size; the excess goes to the others by weight, until none is above. Each round is
    one aggregate of a single row; the sources themselves stay distributed.
    """
    s = ordered(sources, F.col("source").asc_nulls_last())
    s = written(s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))))
    level, cap = -1.0, F.col("source_size") * F.lit(float(most))
    while True:
        full = (cap <= F.col("_w") * F.lit(level)) & F.lit(level >= 0)
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("caps"), F.sum(F.when(~full, F.col("_w"))).alias("w")).first()
        new = (float(r["all"] or 0) - (r["caps"] or 0.0)) / r["w"] if r["w"] else level
        if new <= level or not r["w"]:
            break
        level = new
    return s.select("skey", "source_size", F.least(cap, F.col("_w") * F.lit(max(level, 0.0))).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), seed: int = 42, per: int = 4096, size: F.Column | None = None) -> DataFrame:
    """Every row of docs with size, source_size, target and taken: the words that the mix takes of it, repeats counted."""
    kept = [c for c in docs.columns if c not in ADDED]
    n = n_words(F.col(text)) if size is None else size
    d = docs.select(F.struct(*kept).alias("_row"), F.col(doc_id).alias("_id"), F.col(source).alias("_source"), n.alias("_size"))  # a row's own names clash with nothing
    d = d.withColumn("skey", F.when(F.col("_source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("_source"))))
    counts = written(d.groupBy("skey", "_size").agg(F.count("*").alias("n"), F.first("_source").alias("source")), "lengths")
    goals = targets(counts.groupBy("skey").agg(F.first("source").alias("source"), F.sum(F.col("_size") * F.col("n")).alias("source_size")), weights)

    def grant(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_size")
        total, goal = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        passes = min(MAX_REPEATS, int(goal // total)) if total else 0
        extra = [0] * len(pdf) if passes == MAX_REPEATS else fit(pdf["_size"].tolist(), pdf.n.tolist(), round(goal) - passes * total)
        return pdf[["skey", "_size", "n", "source_size", "target"]].assign(passes=passes, extra=extra)

    grants = counts.drop("source").join(goals, "skey").groupBy("skey").applyInPandas(grant, "skey string, _size long, n long, source_size long, target double, passes long, extra long")
    d = spread_join(d, written(grants, "grants"), ["skey", "_size"], "n", salt=["_id"])
    whole = d.where((F.col("extra") == 0) | (F.col("extra") == F.col("n"))).withColumn("_more", (F.col("extra") > 0).cast("long"))
    part = ranked(d.where((F.col("extra") > 0) & (F.col("extra") < F.col("n"))), ["skey", "_size"], F.ceil(F.col("n") / per), row_hash(["_id"], seed), [F.col("_id"), F.xxhash64("_row")], "_rank")
    part = part.withColumn("_more", (F.col("_rank") < F.col("extra")).cast("long")).drop("_rank")
    both = whole.unionByName(part)
    return both.select("_row.*", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * (F.col("passes") + F.col("_more"))).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: rows as often as they are taken; documents without words stay as they are."""
    columns = docs.columns
    safe = docs.select(F.struct(*columns).alias("_row"), *[c for c in ("doc_id", "text", "source")])
    m = mix(safe, **options)
    times = F.when(F.col("size") > 0, F.col("taken") / F.when(F.col("size") > 0, F.col("size"))).otherwise(1).cast("int")
    return m.select("_row", F.explode(F.array_repeat(F.lit(1), times)).alias("_one")).select("_row.*")
