"""Expanding-window forecasts: every evaluation date sees its own history only, and all dates are one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, RiskConfig
from ..functions.columns import at_least
from ..functions.counter import BLOCKS, uniform
from ..functions.stretches import prefix_ranks
from ..store import written
from . import features as fe
from . import scenarios as sc

NAMES = {"vol_20d": "vol_pct", "vix_level": "vix_pct", "drawdown_20d": "dd_stress", "ret_20d": "ret_stress"}


def eval_rows(ret: DataFrame, least: int = 504, every: int = 21, horizon: int = 20) -> DataFrame:
    n = ret.agg(F.max("rn").alias("n"))
    return ret.crossJoin(F.broadcast(n)).where(((F.col("rn") - 1 - least) % every == 0) & (F.col("rn") > least) & (F.col("rn") <= F.col("n") - horizon)).select("rn")  # one row


def lambda_at(features: DataFrame, rows: DataFrame, least: int = 50, config: RiskConfig = DEFAULT) -> DataFrame:
    """rn, the four percentiles, raw_score, lambda_t, regime at given rows, each against the complete rows up to it (prefix_ranks())."""
    f = features.select("series", "rn", *[F.round(c, 10).alias(c) for c in NAMES])
    f = f.join(rows.select("rn", F.lit(True).alias("asked")), "rn", "left")
    d = prefix_ranks(f, list(NAMES), F.col("asked")).where(F.col("n") >= least)
    pct = {c: (F.col(f"lt_{c}") + F.col(f"le_{c}") + 1) / (2 * F.col("n")) for c in NAMES}
    pct |= {c: 1 - pct[c] for c in ("drawdown_20d", "ret_20d")}
    d = d.select("rn", *[pct[c].alias(name) for c, name in NAMES.items()])
    raw = sum((F.lit(w) * F.col(name) for w, name in zip(config.weights, NAMES.values(), strict=True)), F.lit(0.0))
    d = d.withColumn("raw_score", raw).withColumn("lambda_t", 1 / (1 + F.exp(-config.steepness * (F.col("raw_score") - config.center))))
    return d.withColumn("regime", F.when(F.col("lambda_t") > 0.70, "crisis").when(F.col("lambda_t") > 0.30, "fragile").otherwise("calm"))


def history_rows(features: DataFrame, last: int = 252, step: int = 5) -> DataFrame:
    """Every fifth of the last 252 complete rows, from the first of them."""
    w = Window.partitionBy("series").orderBy(F.col("rn").desc())
    d = features.withColumn("back", F.row_number().over(w)).where(F.col("back") <= last)
    n = d.groupBy("series").agg(F.max("back").alias("first"))
    return d.join(F.broadcast(n), "series").where((F.col("first") - F.col("back")) % step == 0).select("rn")  # a row per series


def forecasts(ret: DataFrame, features: DataFrame, rows: DataFrame, sims: int = 2000, horizon: int = 20, least: int = 100, config: RiskConfig = DEFAULT) -> DataFrame:
    """at, p_drawdown_*, var_*, es_*, median_return: bootstrap by regime and tail correction from the history of each row `at`."""
    regime = sc.REGIME
    e = features.join(rows, "rn").select(F.col("rn").alias("at"), *[F.col(c).alias(f"v_{c}") for c in regime])
    seen = features.select(F.col("rn").alias("at"), F.row_number().over(Window.partitionBy("series").orderBy("rn")).alias("n")).where(F.col("n") >= least)
    e = e.join(seen.select("at"), "at")
    blocks = written(sc.block_library(features, horizon), "blocks")  # a row a day
    # evaluation dates are few: broadcast; the join holds dates * days rows, whatever the number of simulations
    j = blocks.drop("rets").join(F.broadcast(e), F.col("block_id") + (horizon - 1) <= F.col("at"))
    st = j.groupBy("at").agg(*[F.avg(c).alias(f"m_{c}") for c in regime], *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in regime], F.percentile("block_vol_ann", F.lit(0.95)).alias("high"), F.percentile("block_max_dd", F.lit(0.05)).alias("low"))
    j = j.join(F.broadcast(st), "at")
    far = sum((F.pow((F.col(c) - F.col(f"v_{c}")) / F.col(f"s_{c}"), 2) for c in regime), F.lit(0.0))
    crisis = at_least("block_vol_ann", "high") | at_least("low", "block_max_dd")
    j = j.select("at", "block_id", (F.exp(-0.5 * far / config.bandwidth**2) * F.when(crisis, config.crisis_weight).otherwise(1.0)).alias("w"))
    each, run = Window.partitionBy("at"), Window.partitionBy("at").orderBy("block_id")
    share = F.when(F.sum("w").over(each) > 0, F.col("w") / F.sum("w").over(each)).otherwise(1 / F.count("*").over(each))
    j = j.withColumn("share", share).withColumn("hi", F.sum("share").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    j = j.withColumn("lo", F.coalesce(F.lag("hi").over(run), F.lit(0.0))).withColumn("hi", F.when(F.lead("block_id").over(run).isNull(), 1.0).otherwise(F.col("hi")))
    cells = F.sequence(F.floor(F.col("lo") * sc.CELLS), F.least(F.floor(F.col("hi") * sc.CELLS), F.lit(sc.CELLS - 1)))
    j = j.select("at", "block_id", "lo", "hi", F.explode(cells).alias("cell"))
    # a simulation's draw is the same at every date: drawn once, then met with each date's blocks
    u = ret.sparkSession.range(1, sims + 1).select(F.col("id").alias("sim_id"), uniform(BLOCKS, F.col("id"), F.lit(0)).alias("u"))
    u = written(u.withColumn("cell", F.floor(F.col("u") * sc.CELLS)), "draws")
    draws = u.join(j, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("at", "sim_id", "block_id")
    draws = written(draws, "drawn")
    rets = blocks.select("block_id", "rets")
    often = draws.groupBy("at", "block_id").agg(F.count("*").alias("n")).join(rets, "block_id").select("at", "n", F.explode("rets").alias("r"))
    losses = ret.select("rn", (-F.col("r")).alias("loss")).join(F.broadcast(e.select("at")), F.col("rn") <= F.col("at"))
    q = losses.groupBy("at").agg(F.percentile("loss", F.lit(1 - config.evt_threshold)).alias("q1"), F.percentile("loss", F.lit(0.90)).alias("q2"))
    losses = losses.join(F.broadcast(q), "at")
    u2 = losses.groupBy("at").agg(F.when(F.sum((F.col("loss") > F.col("q1")).cast("int")) < 20, F.first("q2")).otherwise(F.first("q1")).alias("threshold"))
    ex = losses.join(F.broadcast(u2), "at").where("loss > threshold").withColumn("y", F.col("loss") - F.col("threshold"))
    i, n = F.row_number().over(Window.partitionBy("at").orderBy("y", "rn")), F.count("*").over(each)
    b = ex.select("at", "threshold", "y", ((1 - (i - 0.35) / n) * F.col("y")).alias("wy")).groupBy("at", "threshold").agg(F.avg("y").alias("b0"), F.avg("wy").alias("b1"))
    gap = F.nullif(F.col("b0") - 2 * F.col("b1"), F.lit(0.0))
    fit = b.select("at", "threshold", (2 - F.col("b0") / gap).alias("xi"), (2 * F.col("b0") * F.col("b1") / gap).alias("sigma"))
    cut = often.groupBy("at").agg(F.percentile(-F.col("r"), F.lit(1 - config.evt_replace), F.col("n")).alias("cut"))
    d = draws.join(rets, "block_id").join(F.broadcast(cut), "at").join(F.broadcast(fit), "at")  # a row a date
    paths = d.select("at", "sim_id", F.transform("rets", lambda r, step: sc.tail_step(r, step)).alias("a"))
    stats = sc.path_stats(written(sc.per_array(paths, ("at", "sim_id")), "figures"), config, ("at",))
    return stats.select("at", *[f"p_drawdown_{round(100 * x)}pct" for x in config.drawdown_levels], "var_5pct", "var_1pct", "es_5pct", "median_return")


def walk_forward(ret: DataFrame, features: DataFrame, sims: int = 2000, least: int = 504, every: int = 21, horizon: int = 20) -> DataFrame:
    """rn, regime score, forecasts (pred_*), realised stress and drawdown, a row per evaluation date."""
    rows = eval_rows(ret, least, every, horizon)
    f = forecasts(ret, features, rows, sims, horizon)
    f = f.select(F.col("at").alias("rn"), *[F.col(c).alias(f"pred_{c}") for c in f.columns if c != "at"])
    lam = lambda_at(features, rows).select("rn", "lambda_t", "regime")
    real = fe.stress_labels(ret, (horizon,)).select("rn", F.col(f"stress_{horizon}d").alias("realised_stress")).join(fe.realised_drawdown(ret, horizon), "rn", "left")
    return f.join(lam, "rn", "left").join(real, "rn").withColumn("regime", F.coalesce("regime", F.lit("unknown")))
