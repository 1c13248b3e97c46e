"""The monitoring log: rows in Parquet, partitioned by batch and ticker, whose columns may vary by run; its tail; a streaming append.

A batch has a folder of its own, named by its id, which a retry writes anew: what arrives twice is there once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds a batch; one of an id that is there already replaces it. Without an id it is a batch of its own."""
    rows.write.mode("overwrite").partitionBy("ticker").parquet(f"{path}/batch={batch or uuid.uuid4().hex}")


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").option("basePath", path).parquet(path).drop("batch")


def tail(rows: DataFrame, n: int = 10, order: str = "run_timestamp", by: str = "ticker") -> DataFrame:
    """The last n rows of each ticker."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def distinct_runs(rows: DataFrame, at: str, delay: str, keys: Sequence[str] = ("ticker", "run_timestamp")) -> DataFrame:
    """A streaming DataFrame without runs that were sent again within `delay` of event time (column `at`); its state is as long as that."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def stream(rows: DataFrame, path: str, checkpoint: str, name: str = "stream"):
    """Appends a streaming DataFrame batch by batch; available data first, then it ends.

    A batch that failed is given again under its own id and replaces what it had written; name tells streams into one log apart.
    """
    return rows.writeStream.foreachBatch(lambda batch, i: append(batch, path, f"{name}-{i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
