"""One entry per query: (spark, sf_dir) -> DataFrame, doubles rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.columns import bs_put, normal_cdf, over, r6
from ..functions.stretches import sliding_drawdown
from ..operators import features as fe
from ..operators import options as op
from ..operators import scenarios as sc
from ..operators import validation as va
from ..sources import tables as t
from ..streaming import monitor
from .inputs import Inputs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _features(spark, sf):
    """All features, lazily, for queries that read them once."""
    return fe.market_features(fe.with_vix(t.returns(spark, sf), t.vix(spark, sf)))


# Sources, nulls, alignment


@query
def src_price_panel(spark, sf):
    return rounded(t.panel(spark, sf).select("dt", "ticker", "close").withColumn("dt", F.col("dt").cast("string")))


@query
def log_return(spark, sf):
    return rounded(fe.log_returns(t.panel(spark, sf)).select(F.col("dt").cast("string").alias("dt"), "ticker", "r"))


@query
def null_ffill(spark, sf):
    return rounded(fe.with_vix(t.returns(spark, sf), t.vix(spark, sf)).select("rn", "vix_level"))


@query
def null_drop_any(spark, sf):
    """Dates that all tickers have."""
    p = t.panel(spark, sf)
    return p.groupBy("dt").agg(F.count("*").alias("n")).crossJoin(F.broadcast(p.agg(F.count_distinct("ticker").alias("all")))).where("n = all").select(F.col("dt").cast("string").alias("dt"), "n")  # one row


@query
def align_index(spark, sf):
    return rounded(t.returns(spark, sf).join(t.vix(spark, sf), "dt").select("rn", "r", "vix_level"))


@query
def train_test_split(spark, sf):
    d = t.returns(spark, sf)
    n = d.agg(F.floor(F.count("*") * 0.8).alias("k"))
    return d.crossJoin(F.broadcast(n)).groupBy(F.when(F.col("rn") <= F.col("k"), "train").otherwise("test").alias("part")).agg(F.count("*").alias("n"))  # one row


# Windows


@query
def roll_ret(spark, sf):
    return rounded(_features(spark, sf).select("rn", "ret_5d", "ret_10d", "ret_20d", "ret_60d"))


@query
def roll_vol(spark, sf):
    return rounded(_features(spark, sf).select("rn", "vol_5d", "vol_10d", "vol_20d", "vol_60d"))


@query
def roll_drawdown(spark, sf):
    return rounded(_features(spark, sf).select("rn", "drawdown_20d", "drawdown_60d"))


@query
def roll_drawdown_year(spark, sf):
    """Over 252 rows, from the stretches of 4, 8, 16, 32, 64 and 128."""
    d = sliding_drawdown(t.returns(spark, sf), "r", {"drawdown_252d": (-251, 0), "drawdown_next_252d": (1, 252)})
    return rounded(d.select("rn", "drawdown_252d", "drawdown_next_252d"))


@query
def vix_zscore(spark, sf):
    return rounded(_features(spark, sf).select("rn", "vix_change_5d", "vix_change_20d", "vix_z_252d"))


@query
def loss_momentum(spark, sf):
    return rounded(_features(spark, sf).select("rn", "loss_5d", "loss_20d"))


@query
def market_features(spark, sf):
    return rounded(_features(spark, sf).drop("series", "dt").dropna())


@query
def cross_asset_features(spark, sf):
    return rounded(fe.cross_features(fe.log_returns(t.panel(spark, sf))).withColumn("dt", F.col("dt").cast("string")))


@query
def stress_label_matrix(spark, sf):
    return fe.stress_labels(t.returns(spark, sf))


@query
def realised_drawdown(spark, sf):
    return rounded(fe.realised_drawdown(t.returns(spark, sf)))


@query
def window_features(spark, sf):
    return rounded(fe.window_features(t.returns(spark, sf)))


@query
def crisis_windows(spark, sf):
    return rounded(fe.crisis_windows(fe.window_features(t.returns(spark, sf))).select("start", "realised_vol_ann", "max_drawdown"))


@query
def eval_dates(spark, sf):
    d = t.returns(spark, sf)
    n = d.agg(F.max("rn").alias("n"))
    return d.crossJoin(F.broadcast(n)).where("(rn - 1 - 504) % 21 = 0 and rn > 504 and rn <= n - 20").select("rn")  # one row


@query
def acf_returns(spark, sf):
    return rounded(fe.autocorrelation(t.returns(spark, sf)))


# Regime


@query
def regime_lambda(spark, sf):
    return rounded(fe.regime(Inputs(spark, sf).complete))


@query
def regime_drift(spark, sf):
    return rounded(fe.drift(Inputs(spark, sf).complete))


# Scenarios


@query
def block_library(spark, sf):
    return rounded(sc.block_library(Inputs(spark, sf).complete).drop("rets"))


@query
def block_weights(spark, sf):
    return rounded(Inputs(spark, sf).weights.drop("rets").withColumn("final_sample_weight", F.col("final_sample_weight") * 1000))


def _boot(i: Inputs):
    """sim_id, block_id, step, r: weighted draws with their paths."""
    drawn = sc.bootstrap(i.weights.drop("rets"), i.sims)
    steps = drawn.join(i.weights.select("block_id", "rets"), "block_id").select("sim_id", "block_id", F.posexplode("rets").alias("step", "r"))
    return i.store.table("boot", lambda: steps.withColumn("step", F.col("step").cast("long")))


@query
def bootstrap_paths(spark, sf):
    return rounded(_boot(Inputs(spark, sf)))


@query
def evt_exceedances(spark, sf):
    return rounded(sc.evt_exceedances(t.returns(spark, sf)))


@query
def evt_fit_pwm(spark, sf):
    return rounded(sc.evt_fit(sc.evt_exceedances(t.returns(spark, sf))))


@query
def evt_correct_paths(spark, sf):
    i = Inputs(spark, sf)
    fit = sc.evt_fit(sc.evt_exceedances(i.ret))
    return rounded(sc.evt_correct(t.paths(spark, sf, ret=i.ret), fit))


@query
def path_drawdown(spark, sf):
    i = Inputs(spark, sf)
    each = i.own_figures.withColumnRenamed("sim_id", "block_id")
    return rounded(t.draws(spark, sf, i.ret).join(each, "block_id").select("sim_id", "cum", "max_dd"))


@query
def path_stats(spark, sf):
    return rounded(sc.path_stats(Inputs(spark, sf).figures, by=("model",)))


@query
def worst_paths(spark, sf):
    i = Inputs(spark, sf)
    each = i.own_figures.withColumnRenamed("sim_id", "block_id").drop("n")
    drawn = t.draws(spark, sf, i.ret)
    return rounded(sc.worst_paths(drawn.join(each, "block_id").drop("block_id"), drawn))


@query
def path_histogram(spark, sf):
    return sc.histogram(Inputs(spark, sf).own_figures)


# Options


@query
def opt_put_chain(spark, sf):
    return rounded(op.quoted(t.chain(spark, sf)))


@query
def put_liquidity_filter(spark, sf):
    return op.liquid(op.quoted(t.chain(spark, sf))).select("contract_id")


@query
def opt_expiries(spark, sf):
    """Terms, and the default one: the second nearest."""
    from pyspark.sql import Window

    d = t.chain(spark, sf).select("t_years").distinct()
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t_years"))  # a handful of terms
    return rounded(d.select("t_years", (k == 2).alias("is_default")))


@query
def rn_prob(spark, sf):
    d = op.quoted(t.chain(spark, sf)).withColumn("d2", (F.ln(F.col("spot") / F.col("strike")) + (0.045 - 0.02) * F.col("t_years")) / (0.2 * F.sqrt("t_years")))
    return rounded(d.select("contract_id", normal_cdf(-F.col("d2")).alias("rn_prob"), bs_put(F.col("spot"), F.col("strike"), F.col("t_years"), F.lit(DEFAULT.risk_free), F.lit(0.2)).alias("bs_put")))


@query
def solved_puts(spark, sf):
    """All solved contracts, whatever their time value; without SQL, as an engine's rounding moves what little time value leaves open."""
    return Inputs(spark, sf).puts.select("contract_id", "spot", "strike", "t_years", "mid", "implied_vol", "risk_neutral_prob_itm", "delta", "vega_per_1pct", "bs_price_from_iv")


def _settled(spark, sf, least: float, names: tuple[str, ...]):
    """All solved contracts: the price from the volatility, and names at five places, null where the time value is too thin to settle them.

    Where the time value is at most `least`, prices of two engines agree but their volatilities need not; solved_puts has them.
    """
    d = Inputs(spark, sf).puts.withColumn("thin", F.expr("mid - greatest(strike * exp(-0.045 * t_years) - spot, 0)") <= least)
    five = [F.when(~F.col("thin"), F.round(c, 5) + F.lit(0.0)).alias(c) for c in names]
    return d.select("contract_id", *five, (F.round("bs_price_from_iv", 5) + F.lit(0.0)).alias("bs_price_from_iv"))


@query
def implied_vol(spark, sf):
    return _settled(spark, sf, 0.001, ("implied_vol",))


@query
def bs_metrics(spark, sf):
    return _settled(spark, sf, 0.01, ("risk_neutral_prob_itm", "delta", "vega_per_1pct"))


@query
def vol_surface(spark, sf):
    return rounded(op.vol_surface(Inputs(spark, sf).puts))


@query
def physical_prob(spark, sf):
    chain = op.liquid(op.quoted(t.chain(spark, sf)))
    return rounded(op.physical(chain, Inputs(spark, sf).own_figures).select("contract_id", "physical_prob_itm", "physical_expected_payoff"))


@query
def disagreement(spark, sf):
    return rounded(Inputs(spark, sf).scored.select("contract_id", "gap", "liquidity_score", "confidence", "tail_score", "interpretation", "payoff_minus_mid", "payoff_to_mid_ratio"))


@query
def disagreement_summary(spark, sf):
    return rounded(op.summary(Inputs(spark, sf).scored))


@query
def scenario_options(spark, sf):
    """The whole chain of steps: weighted bootstrap, tail correction, path probabilities, implied volatilities, disagreement summary."""
    i = Inputs(spark, sf)
    fit = i.store.table("fit", lambda: sc.evt_fit_ml(i.store.table("exceedances", lambda: sc.evt_exceedances(i.ret))))
    drawn = i.store.table("drawn", lambda: sc.bootstrap(i.weights.drop("rets"), i.sims))
    each = i.store.table("each", lambda: sc.per_array(sc.evt_correct_drawn(drawn, i.weights, fit)).select("cum", "n"))
    return rounded(op.summary(op.scored(i.store.table("priced", lambda: op.physical(i.puts, each)))))


# Validation


@query
def ks_wasserstein(spark, sf):
    i = Inputs(spark, sf)
    return rounded(va.distances(i.real, i.values))


@query
def moments(spark, sf):
    return rounded(va.moments(Inputs(spark, sf).values))


@query
def tail_mass_quantiles(spark, sf):
    i = Inputs(spark, sf)
    return rounded(va.tail_and_quantiles(i.real, i.values))


@query
def var_backtest_multi(spark, sf):
    i = Inputs(spark, sf)
    return rounded(va.var_backtest(i.real, i.values))


@query
def reliability(spark, sf):
    return rounded(va.reliability(t.forecasts(spark, sf)))


@query
def calibration_metrics(spark, sf):
    return rounded(va.calibration(t.forecasts(spark, sf)))


@query
def monitor_tail(spark, sf):
    e = t.table(spark, sf, "events").select(F.col("event_type").alias("ticker"), F.col("event_id").alias("run_timestamp"), "value")
    return rounded(monitor.tail(e, 10))


@query
def json_safe(spark, sf):
    """Values that JSON cannot hold become null, others are rounded."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    d = t.table(spark, sf, "events").select("event_id", v.alias("v"))
    return rounded(d.select("event_id", F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v")).alias("v")))


@query
def breach_transitions(spark, sf):
    d = t.returns(spark, sf)
    q = d.agg(F.percentile(-F.col("r"), F.lit(0.95)).alias("q"))
    d = d.crossJoin(F.broadcast(q)).withColumn("b", (-F.col("r") >= F.col("q")).cast("int"))  # one row
    d = d.withColumn("a", F.lag("b").over(over(0).orderBy("rn").rowsBetween(-1, -1)))
    n = lambda x, y: F.sum(((F.col("a") == x) & (F.col("b") == y)).cast("long"))
    return d.agg(n(0, 0).alias("n00"), n(0, 1).alias("n01"), n(1, 0).alias("n10"), n(1, 1).alias("n11"))
