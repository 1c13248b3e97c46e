"""Adapters from the star-schema tables to the model's inputs. Every table carries explicit order keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES = "S"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, rn, dt, r: a daily log-return sample of 1 % deviation."""
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(F.avg("o_totalprice").alias("px"))
    m = d.agg(F.avg("px").alias("mu"), F.stddev_pop("px").alias("sd"))
    d = d.crossJoin(F.broadcast(m)).select(F.lit(SERIES).alias("series"), "dt", (0.01 * (F.col("px") - F.col("mu")) / F.col("sd")).alias("r"))  # m is one row
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("series").orderBy("dt")).cast("long"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt, ticker, close: prices with gaps."""
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt"), F.col("o_orderpriority").alias("ticker")).agg(F.avg("o_totalprice").alias("px"))
    m = d.groupBy("ticker").agg(F.avg("px").alias("mu"), F.stddev_pop("px").alias("sd"))
    w = Window.partitionBy("ticker").orderBy("dt")
    return d.join(m, "ticker").select("dt", "ticker", (100 * F.exp(F.sum(0.01 * (F.col("px") - F.col("mu")) / F.col("sd")).over(w))).alias("close"))


def vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("dt")).agg((10 + 200 * F.avg("l_discount")).alias("vix_level"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A put chain: contract_id, spot, strike, t_years, bid, ask, open_interest, volume."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        k.alias("contract_id"), F.lit(100.0).alias("spot"), (70 + (k % 121).cast("double") / 2).alias("strike"),
        ((30 * (1 + k % 6)).cast("double") / 365).alias("t_years"), (0.10 + F.col("p_size").cast("double") / 100).alias("s0"),
        (0.01 + (k % 40).cast("double") / 100).alias("sp"), ((k * 37) % 1000).alias("open_interest"), F.when(k % 17 != 0, (k * 53) % 500).alias("volume"),
    )
    root = F.col("s0") * F.sqrt("t_years")
    m0 = F.greatest(F.col("strike") * F.exp(-0.045 * F.col("t_years")) - F.col("spot"), F.lit(0.0)) + 0.4 * F.col("spot") * root * F.exp(-2 * F.abs(F.ln(F.col("strike") / F.col("spot"))) / root)
    p = p.select("*", F.explode(F.array(m0)).alias("m0"))  # a row of one value: filters on prices stay above, where they do not work it out again each time
    return p.select("contract_id", "spot", "strike", "t_years", (F.col("m0") * (1 - F.col("sp") / 2)).alias("bid"), (F.col("m0") * (1 + F.col("sp") / 2)).alias("ask"), "open_interest", "volume")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's calls by put-call parity, at least a cent bid."""
    ahead = F.col("spot") - F.col("strike") * F.exp(-0.045 * F.col("t_years"))
    p = chain(spark, sf_dir).withColumn("half", (F.col("ask") - F.col("bid")) / 2).withColumn("c0", F.greatest((F.col("bid") + F.col("ask")) / 2 + ahead, F.col("half") + 0.01))
    return p.withColumn("bid", F.col("c0") - F.col("half")).withColumn("ask", F.col("c0") + F.col("half")).drop("half", "c0")


#: The panel's tickers.
TICKERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quote_id, ticker, dt: a quote for each shipped line, on days with and without a price."""
    name = F.element_at(F.array(*[F.lit(x) for x in TICKERS]), (1 + F.col("l_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("quote_id"), name.alias("ticker"), F.to_date("l_shipdate").alias("dt"))


def spread(sims: DataFrame, key: str) -> DataFrame:
    """Deals simulations, a few bytes each, to all tasks before each of them becomes a path; a small table may be one file."""
    spark = sims.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return sims.repartition(n, key)


def blocks(ret: DataFrame, horizon: int = 20) -> DataFrame:
    """block_id, a: the series' runs of horizon steps."""
    ahead = Window.partitionBy("series").orderBy("rn").rowsBetween(0, horizon - 1)
    return ret.select(F.col("rn").alias("block_id"), F.collect_list("r").over(ahead).alias("a")).where(F.size("a") == horizon)  # a row a day


def draws(spark: SparkSession, sf_dir: str, ret: DataFrame, horizon: int = 20) -> DataFrame:
    """sim_id, block_id: the block of each simulation, uniformly by a deterministic lattice."""
    n = ret.agg((F.max("rn") - (horizon - 1)).alias("nb"))
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").crossJoin(F.broadcast(n)).select(k.alias("sim_id"), (1 + (k * 1103515245 + 12345) % 2147483648 % F.col("nb")).alias("block_id"))  # n is one row


def path_arrays(spark: SparkSession, sf_dir: str, horizon: int = 20, ret: DataFrame | None = None) -> DataFrame:
    """sim_id, block_id, a: each simulation's path, a block of the series, as an array of steps."""
    ret = returns(spark, sf_dir) if ret is None else ret
    return spread(draws(spark, sf_dir, ret, horizon), "sim_id").join(blocks(ret, horizon), "block_id").select("sim_id", "block_id", "a")


def drawn_blocks(spark: SparkSession, sf_dir: str, ret: DataFrame, horizon: int = 20) -> DataFrame:
    """block_id, a, n: every path that was drawn, once, and by how many simulations; counted before the shuffle."""
    n = draws(spark, sf_dir, ret, horizon).groupBy("block_id").agg(F.count("*").alias("n"))
    return blocks(ret, horizon).join(n, "block_id")


def _steps(arrays: DataFrame) -> DataFrame:
    kept = [c for c in arrays.columns if c != "a"]
    return arrays.select(*kept, F.posexplode("a").alias("step", "r")).withColumn("step", F.col("step").cast("long"))


def paths(spark: SparkSession, sf_dir: str, horizon: int = 20, ret: DataFrame | None = None) -> DataFrame:
    """sim_id, step, block_id, r: the steps of path_arrays()."""
    return _steps(path_arrays(spark, sf_dir, horizon, ret)).select("sim_id", "step", "block_id", "r")


#: Scenario generators for comparisons: name, scale, shift.
MODELS = (("boot", 1.0, 0.0), ("calm", 0.7, 0.0), ("wild", 1.5, 0.0), ("shift", 1.0, -0.002))


def models_of(paths_: DataFrame) -> DataFrame:
    """model and the columns of paths (with array a): every path under every generator."""
    every = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, a, b in MODELS])
    d = paths_.withColumn("m", F.explode(every))
    return d.select("m.model", *[F.transform("a", lambda r: r * F.col("m.a") + F.col("m.b")).alias("a") if c == "a" else F.col(c) for c in paths_.columns])


def model_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, sim_id, a."""
    return models_of(path_arrays(spark, sf_dir).drop("block_id"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, sim_id, step, r."""
    return _steps(model_arrays(spark, sf_dir))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, p, y: forecast probabilities and outcomes."""
    return table(spark, sf_dir, "events").select("event_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("p"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"))
