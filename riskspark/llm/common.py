"""What the operators of this subpackage share: tables, scratch folders, row hashes and exact distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it, for regular expressions and for trim().
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch folders of this Python process, by session; clear_scratch() deletes them.
_FOLDERS: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local session (tests) gets a temporary one, and any other an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/riskspark-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared file system that no plan reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what the operators wrote to the shared folder in this session; call it once all results are read or written."""
    folders = _FOLDERS.pop(spark.sparkContext.applicationId, [])
    discard(spark, *folders)
    return len(folders)


def written(df: DataFrame, name: str = "t", folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, safe against lost executors."""
    path = f"{folder or scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_hash(cols: Sequence[str | Column], salt: int = 0) -> Column:
    return F.xxhash64(F.lit(salt), *[F.col(c) if isinstance(c, str) else c for c in cols])


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of maximal runs of other than ASCII white space; 0 for null."""
    trimmed = F.trim(c, F.lit(WHITE_CHARS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WHITE + "+"))).cast("long")


#: A key with more than 1 / HOT of all rows is split; so at most HOT keys are, whatever the table's size.
HOT = 1000


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], size: str, how: str = "inner", salt: Sequence[str | Column] = ()) -> DataFrame:
    """left joined with right, which holds one row per key and, in the column `size`, about how many rows of left have it.

    Rows of a hot key go to several tasks by a hash of salt (columns of left), and the key's row of right to each of
    them. Which keys are hot is read first: by the choice of HOT that is at most HOT rows. No key may be null; right is
    evaluated once more, so it should be a written table.
    """
    known = right.agg(F.sum(size).alias("total"), F.max(size).alias("most")).first()
    share = max(1, -(-(known.total or 0) // HOT))
    if (known.most or 0) <= share:
        return left.join(right, list(keys), how)
    splits = F.ceil(F.col(size) / share).cast("int")
    key = F.xxhash64(*keys)
    hot = {r.k: r.n for r in right.where(F.col(size) > share).select(key.alias("k"), splits.alias("n")).collect()}
    of = F.element_at(F.map_from_arrays(F.lit(list(hot)), F.lit(list(hot.values()))), key)  # a chance collision of hashes only splits another key too
    one = left.withColumn("_salt", F.coalesce(F.pmod(row_hash(salt or left.columns, 77), of), F.lit(0)).cast("int"))
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(of, F.lit(1)) - 1)))
    return one.join(many, [*keys, "_salt"], how).drop("_salt")


def ranked(df: DataFrame, group: list[str], buckets: Column, order: Column, ties: Sequence[Column] = (), name: str = "rank") -> DataFrame:
    """Adds each row's exact rank (from 0) within its group, without ever gathering a group in one task.

    The 64-bit hash ``order`` cuts a group into ``buckets`` equal ranges (ask for one per few thousand rows); rows are
    ranked within a range, and prefix sums over the ranges' counts give its start. df is evaluated twice, so it must be
    deterministic; the group columns must hold no nulls.
    """
    u = F.shiftrightunsigned(order, 1) / F.lit(float(1 << 63))
    d = df.withColumn("_h", order).withColumn("_b", F.least(F.floor(u * buckets), buckets - 1).cast("long"))
    w = Window.partitionBy(*group, "_b").orderBy("_h", *ties)
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(*group, "_b").count().select(*group, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    out = d.withColumn("_rn", F.row_number().over(w)).join(starts, [*group, "_b"])
    return out.select(*df.columns, (F.col("_start") + F.col("_rn") - 1).cast("long").alias(name))


def ordered(df: DataFrame, key: Column, name: str = "ordinal", partitions: int = 32) -> DataFrame:
    """Adds each row's place (from 0) in the order of key, through a range partitioning; one count a partition reaches the driver."""
    spark = df.sparkSession
    d = df.repartitionByRange(partitions, key).sortWithinPartitions(key)
    d = written(d.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")), "ordered")
    starts, at = [], 0
    for p, n in sorted(tuple(r) for r in d.groupBy("_p").count().collect()):
        starts.append((p, at))
        at += n
    offsets = spark.createDataFrame(starts, "_p int, _at long")
    return d.join(F.broadcast(offsets), "_p").select(*df.columns, (F.col("_i") + F.col("_at")).alias(name))
