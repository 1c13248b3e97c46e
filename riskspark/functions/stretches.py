"""Windows over long series: drawdowns by doubling, and windows cut into blocks with the rows around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written
from .running import place


def _joined(a: Column, b: Column) -> Column:
    """The stretch a followed by b: sum t, greatest prefix p, least prefix m, drawdown d. Null where either is."""
    both = F.struct(
        (a["t"] + b["t"]).alias("t"), F.greatest(a["p"], a["t"] + b["p"]).alias("p"), F.least(a["m"], a["t"] + b["m"]).alias("m"),
        F.least(a["d"], b["d"], a["t"] + b["m"] - a["p"]).alias("d"),
    )
    return F.when(a.isNotNull() & b.isNotNull(), both)


def sliding_drawdown(df: DataFrame, value: str, columns: dict[str, tuple[int, int]], by: str = "series", order: str = "rn") -> DataFrame:
    """Adds a column per entry: the drawdown over the rows from `first` to `last` beside the row's own (0), null unless all are there.

    The largest fall of the running sum below its running peak, which starts at the first step. Stretches form a semigroup,
    so those of 2, 4, 8, ... rows are each joined from two of half the length, and a window from the powers of two in its
    width: log2(width) steps over one sort, and no row ever holds a list of its window.
    """
    w = Window.partitionBy(by).orderBy(order)
    v = F.col(value)
    d = df.withColumn("_s0", F.when(v.isNotNull(), F.struct(v.alias("t"), v.alias("p"), v.alias("m"), F.lit(0.0).alias("d"))))
    most = max(last - first + 1 for first, last in columns.values())
    for k in range(1, most.bit_length()):
        d = d.withColumn(f"_s{k}", _joined(F.lag(f"_s{k - 1}", 1 << (k - 1)).over(w), F.col(f"_s{k - 1}")))
    ends = []  # stretches that end at a row, by width
    for name, (first, last) in columns.items():
        width, done, parts = last - first + 1, 0, []
        for k in range(width.bit_length()):
            if width >> k & 1:
                parts.append(F.lag(f"_s{k}", done - last).over(w) if done - last >= 0 else F.lead(f"_s{k}", last - done).over(w))
                done += 1 << k
        d = d.withColumns({f"_p{i}_{name}": p for i, p in enumerate(parts)})
        whole = F.col(f"_p{len(parts) - 1}_{name}")
        for i in range(len(parts) - 2, -1, -1):
            d = d.withColumn(f"_w{i}_{name}", _joined(whole, F.col(f"_p{i}_{name}")))
            whole = F.col(f"_w{i}_{name}")
        ends.append(whole["d"].alias(name))
    return d.select(*df.columns, *ends)


def in_blocks(df: DataFrame, f: Callable[[DataFrame], DataFrame], before: int, after: int = 0, size: int = 100_000, by: str = "series", order: str = "rn") -> DataFrame:
    """f(df), where f adds columns by windows that are partitioned by `by`, sorted by `order` and reach so many rows back and ahead.

    The series, whose rows are numbered without gaps, are cut into blocks of `size` rows; a block gets the rows around it that its windows
    reach, f runs over each block as a series of its own, and the rows around it are dropped again. So one series of any
    length is many tasks. before and after are at most size.
    """
    if before > size or after > size:
        raise ValueError("a window reaches beyond the next block: take larger blocks")
    block = F.floor(F.col(order) / size)
    place = F.col(order) - block * size
    beside = F.filter(F.array(block, F.when(place >= size - before, block + 1), F.when(place < after, block - 1)), lambda b: b.isNotNull())
    d = df.withColumn("_own", block).withColumn("_block", F.explode(beside)).withColumn("_by", F.col(by)).withColumn(by, F.concat_ws("#", F.col(by).cast("string"), F.col("_block").cast("string")))
    out = f(d).where("_own = _block")
    return out.withColumn(by, F.col("_by")).drop("_own", "_block", "_by")


def carried(df: DataFrame, values: Sequence[str], by: str, order: str, rows: int | None = None, per_block: int = 100_000) -> DataFrame:
    """df with each of values filled by its last value that is not null, in the order of `order` within `by`, ties included.

    The order is cut into blocks of about per_block rows by quantiles of a sketch. Each block's last values are a row; carried
    over the blocks they begin the next ones. So neither a long series nor a hot key is one task. df is read a few times: write
    it first where it is dear. rows: about how many rows there are.
    """
    n = df.count() if rows is None else rows
    k = max(1, -(-n // per_block))
    number = F.col(order).cast("timestamp").cast("double") if dict(df.dtypes)[order] in ("date", "timestamp") else F.col(order).cast("double")
    if k == 1:
        d = df.withColumn("_block", F.lit(0))
    else:
        cuts = df.agg(F.percentile_approx(number, [i / k for i in range(1, k)], 10 * k).alias("_cuts"))
        d = df.crossJoin(F.broadcast(cuts)).withColumn("_block", place(number, k)).drop("_cuts")  # one row of k values
    w = Window.partitionBy(by, "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = d.groupBy(by, "_block").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))).alias(c) for c in values])
    upto = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(F.col(by).alias("_by"), F.col("_block").alias("_b"), *[F.last(c, ignorenulls=True).over(upto).alias(f"_{c}") for c in values])
    own = [F.last(c, ignorenulls=True).over(w).alias(f"_own_{c}") for c in values]
    j = d.select("*", *own).join(last, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b")))
    return j.select(*[F.coalesce(f"_own_{c}", f"_{c}").alias(c) if c in values else F.col(c) for c in df.columns])


def asof(left: DataFrame, right: DataFrame, by: str, order: str, values: Sequence[str], tolerance: int | None = None, per_block: int = 100_000) -> DataFrame:
    """left with the values of the last row of right at or before its own `order` (a date or a number), null where there is none or it is more than tolerance days or units older.

    The answer depends on key and time alone: left's distinct pairs of both, combined before the shuffle, join right's in a
    tagged union, in which right's rows are carried on (carried()), and left looks its answer up. Rows of left are neither sorted nor
    carried, so many rows of few times cost a scan; left is read twice, and two tables of pairs are written. Where several rows of right share a
    key and a time the greatest in the order of values counts; rows of right with a null key or time join nothing, rows of left with one get nulls.
    """
    known = F.col(by).isNotNull() & F.col(order).isNotNull()
    seen = F.struct(F.col(order).alias("t"), *[F.col(c).alias(c) for c in values])
    r = right.where(known).select(by, order, seen.alias("_seen"), F.lit(False).alias("_asked"))
    asked = left.where(known).select(by, order).distinct().select(by, order, F.lit(None).cast(r.schema["_seen"].dataType).alias("_seen"), F.lit(True).alias("_asked"))
    pairs = written(r.unionByName(asked).groupBy(by, order).agg(F.max("_seen").alias("_seen"), F.max("_asked").alias("_asked")), "pairs")
    u = carried(pairs, ["_seen"], by, order, per_block=per_block).where("_asked and _seen is not null")
    age = F.datediff(F.col(order), F.col("_seen.t")) if dict(left.dtypes)[order] == "date" else F.col(order) - F.col("_seen.t")
    fresh = F.lit(True) if tolerance is None else age <= tolerance
    found = written(u.where(fresh).select(F.col(by).alias("_by"), F.col(order).alias("_at"), *[F.col("_seen")[c].alias(f"_{c}") for c in values]), "found")
    j = left.join(found, (F.col(by) == F.col("_by")) & (F.col(order) == F.col("_at")), "left")
    return j.select(*left.columns, *[F.col(f"_{c}").alias(c) for c in values])


def prefix_ranks(df: DataFrame, columns: Sequence[str], asked: Column, by: str = "series", order: str = "rn") -> DataFrame:
    """by, order and, for the rows where asked holds, per column c lt_c and le_c: how many rows up to it have a smaller, and at most its, value; n: the rows up to it.

    Merge counting: at level k a series is cut into stretches of 2**(k + 1) numbers, and the rows in a stretch's second half count
    those in its first half by one running sum in the order of values. Each earlier row lies across from a later one at exactly
    one level, so rows * log2(rows) rows are sorted once, and no row meets its history.
    """
    i = F.col(order).cast("long")
    levels = F.sequence(F.lit(0), F.lit(41))
    d = df.select(by, i.alias("_i"), F.coalesce(asked, F.lit(False)).alias("_asked"), *columns, F.explode(levels).alias("_k")).withColumn("_late", F.call_function("shiftright", F.col("_i"), F.col("_k")).bitwiseAND(F.lit(1)) == 1)
    most = df.groupBy(by).agg(F.max(i).alias("_most"))
    d = d.join(F.broadcast(most), by).where((F.call_function("shiftright", F.col("_most"), F.col("_k")) > 0) & (~F.col("_late") | F.col("_asked")))  # a row a series
    d = d.withColumn("_s", F.call_function("shiftright", F.col("_i"), F.col("_k") + 1)).unpivot([by, "_i", "_k", "_s", "_late"], list(columns), "_c", "_v")
    stretch = Window.partitionBy(by, "_c", "_k", "_s")
    early = F.when(~F.col("_late"), 1).otherwise(0)
    upto = F.sum(early).over(stretch.orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum(early).over(Window.partitionBy(by, "_c", "_k", "_s", "_v"))
    counted = d.select(by, "_i", "_c", "_late", upto.alias("le"), (upto - ties).alias("lt")).where("_late").groupBy(by, "_i").agg(*[F.sum(F.when(F.col("_c") == c, F.col(x))).alias(f"_{x}_{c}") for c in columns for x in ("lt", "le")])
    numbered = df.select(by, order, i.alias("_i"), F.coalesce(asked, F.lit(False)).alias("_asked"), F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long").alias("n")).where("_asked")
    out = numbered.join(counted, [by, "_i"], "left")
    # a row is itself one of those up to it
    return out.select(by, order, "n", *[(F.coalesce(f"_{x}_{c}", F.lit(0)) + int(x == "le")).cast("long").alias(f"{x}_{c}") for c in columns for x in ("lt", "le")])
