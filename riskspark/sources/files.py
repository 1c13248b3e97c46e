"""Readers of returns, prices, volatility levels, option chains and scenario paths from CSV, and writers of results."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: A row's place: file, block of the file, then Spark's own count, which rises within a block.
PLACE = ("_metadata.file_path", "_metadata.file_block_start")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def returns_csv(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """series, rn, r: the first column beside the date, numbered by date where there is one, else by place in the file; nulls go."""
    d = _csv(spark, path)
    value = next(c for c in d.columns if c != date)
    order = F.col(date) if date in d.columns else F.struct(*PLACE, F.monotonically_increasing_id())
    d = d.select(F.lit("S").alias("series"), order.alias("_o"), F.col(value).cast("double").alias("r")).where("r is not null")
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("series").orderBy("_o")).cast("long")).select("series", "rn", "r")


def paths_csv(spark: SparkSession, path: str, model: str = "model") -> DataFrame:
    """model, sim_id, step, r from a matrix with a header, a row per simulation and a column per step."""
    d = _csv(spark, path)
    row = F.array(*[F.col(f"`{c}`").cast("double") for c in d.columns])
    numbered = d.select(F.monotonically_increasing_id().alias("sim_id"), row.alias("a"))  # before the steps, or each of them is numbered
    return numbered.select(F.lit(model).alias("model"), "sim_id", F.posexplode("a").alias("step", "r")).withColumn("step", F.col("step").cast("long"))


def panel_of(prices: DataFrame, date: str = "dt", ticker: str | None = None) -> DataFrame:
    """dt, ticker, close from a date and one column a ticker; ticker names the column where there is one series only."""
    names = [c for c in prices.columns if c != date]
    if ticker is not None:
        if len(names) != 1:
            raise ValueError(f"one series wanted, got the columns {names}")
        prices, names = prices.withColumnRenamed(names[0], ticker), [ticker]
    d = prices.select(F.col(date).alias("dt"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return d.unpivot("dt", [F.col(f"`{c}`") for c in names], "ticker", "close")


def prices_csv(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """dt, ticker, close from a date and one column a ticker."""
    return panel_of(_csv(spark, path).withColumn(date, F.to_date(date)), date)


def vix_csv(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """dt, vix_level: the first column beside the date."""
    d = _csv(spark, path)
    value = next(c for c in d.columns if c != date)
    return d.select(F.to_date(date).alias("dt"), F.col(f"`{value}`").cast("double").alias("vix_level"))


def chain_csv(spark: SparkSession, path: str) -> DataFrame:
    """A put chain with the columns of sources.tables.chain; contract_id may be absent and is then the rank of expiry and strike."""
    d = _csv(spark, path)
    if "contract_id" not in d.columns:
        d = d.withColumn("contract_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t_years", "strike")).cast("long"))  # one underlying's puts
    doubles = [c for c in ("spot", "strike", "t_years", "bid", "ask", "last_price") if c in d.columns]
    return d.withColumns({c: F.col(c).cast("double") for c in doubles})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; NaN and infinities become null."""
    safe = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").json(path)


def json_text(value: Any) -> str:
    """JSON of a few values that engine.clean() has made safe."""
    return json.dumps(value, indent=2, default=str)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file on the file system that the path names, as for the tables beside it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
