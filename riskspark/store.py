"""Intermediate tables: computed once, kept as Parquet below the shared folder, read by all that ask for them, released at the end.

A Store is the lifetime of such tables: one report, one command or one query has its own, so that nothing is kept from one to the
next. Plans over a store's tables are lazy, so it is released when their results have been read or written: by release(),
by leaving a `with` block, or for all stores of a session by release_all(). A lost executor loses no table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[str, list[Store]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session gets a temporary one, and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


class Store:
    """Tables by name, each made at its first use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, shared_folder(spark), {}
        _OPEN.setdefault(spark.sparkContext.applicationId, []).append(self)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.tables:
            df = make()
            path = f"{self.folder}/{len(self.tables)}-{name}"
            df.write.parquet(path)
            self.tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.tables[name]

    def release(self) -> None:
        """Deletes all tables; plans that read them fail from then on."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = {}
        open_ = _OPEN.get(self.spark.sparkContext.applicationId, [])
        if self in open_:
            open_.remove(self)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table of a store of its own, which release_all() ends."""
    return Store(df.sparkSession).table(name, lambda: df)


def release_all(spark: SparkSession) -> int:
    """Releases every store of the session that is still open; call it once all results are read or written."""
    open_ = list(_OPEN.get(spark.sparkContext.applicationId, []))
    for s in open_:
        s.release()
    return len(open_)
