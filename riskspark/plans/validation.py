"""Registered queries over the validation layers, evaluation dates, the gate and what is left of options and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import lattice
from ..functions.columns import bs_price
from ..functions.stretches import asof
from ..operators import features as fe
from ..operators import gate
from ..operators import health as he
from ..operators import options as op
from ..operators import realism as re_
from ..operators import scenarios as sc
from ..operators import validation as va
from ..operators import walkforward as wf
from ..sources import files
from ..sources import tables as t
from .inputs import Inputs
from .queries import _features, query, rounded


@query
def null_drop_all(spark, sf):
    """Days of the volatility index on which any ticker has a price."""
    p = t.panel(spark, sf)
    wide = p.groupBy("dt").pivot("ticker").agg(F.first("close"))
    names = [c for c in wide.columns if c != "dt"]
    d = t.vix(spark, sf).select("dt").join(wide, "dt", "left").dropna(how="all", subset=names)
    return d.select(F.col("dt").cast("string").alias("dt"), sum((F.col(f"`{c}`").isNotNull().cast("long") for c in names), F.lit(0)).alias("n"))


@query
def opt_spot(spark, sf):
    return rounded(op.spot(t.panel(spark, sf)))


@query
def src_single_series(spark, sf):
    """One ticker's closes, a date and a value, as a panel."""
    one = t.panel(spark, sf).where("ticker = '1-URGENT'").select("dt", "close")
    return rounded(files.panel_of(one, "dt", "1-URGENT").withColumn("dt", F.col("dt").cast("string")))


@query
def opt_spot_fallback(spark, sf):
    """Contracts of three tickers, one of which has no price: its spot is its contracts' median last price."""
    name = F.element_at(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("NO-PRICE")), (1 + F.col("contract_id") % 3).cast("int"))
    d = t.chain(spark, sf).select("contract_id", name.alias("ticker"), ((F.col("bid") + F.col("ask")) / 2).alias("last_price"))
    return rounded(op.with_spot(d, op.spot(t.panel(spark, sf))).select("contract_id", "ticker", "spot"))


@query
def opt_spot_asof(spark, sf):
    """The underlying's price as of each quote's day, at most 30 days old."""
    return rounded(asof(t.quotes(spark, sf), t.panel(spark, sf), "ticker", "dt", ["close"], tolerance=30).select("quote_id", "ticker", F.col("dt").cast("string").alias("dt"), F.col("close").alias("spot")))


@query
def ks_monthly(spark, sf):
    """Each ticker's daily returns of a month against those of the month before that it has: exact p-value where no returns are tied."""
    d = fe.log_returns(t.panel(spark, sf)).groupBy("ticker", F.date_format("dt", "yyyy-MM").alias("month")).agg(F.collect_list("r").alias("x"))  # a month's days
    d = d.withColumn("y", F.lag("x").over(Window.partitionBy("ticker").orderBy("month"))).where("y is not null")
    n, m = F.size("x"), F.size("y")
    d = d.withColumn("far", lattice.distance(F.col("x"), F.col("y")))
    p = F.coalesce(lattice.exact_tail(F.col("far"), n, m), va.ks_tail(F.col("far") / (n * m), n, m))
    return rounded(d.select("ticker", "month", n.cast("long").alias("n"), m.cast("long").alias("m"), (F.col("far") / (n * m)).alias("ks_stat"), p.alias("ks_pval")))


@query
def opt_call_chain(spark, sf):
    return rounded(op.quoted(t.calls(spark, sf)))


@query
def put_ui_filter(spark, sf):
    return op.tighter(op.liquid(op.quoted(t.chain(spark, sf)))).select("contract_id")


@query
def bs_call(spark, sf):
    d = op.quoted(t.chain(spark, sf))
    return rounded(d.select("contract_id", bs_price(F.col("spot"), F.col("strike"), F.col("t_years"), F.lit(DEFAULT.risk_free), F.lit(0.2), call=True).alias("bs_call")))


@query
def historical_context(spark, sf):
    d = op.physical(op.liquid(op.quoted(t.chain(spark, sf))), Inputs(spark, sf).own_figures)
    return rounded(op.historical_context(d, t.returns(spark, sf)).select("contract_id", "physical_prob_itm", "hist_tail_threshold", "hist_crisis_episode_n", "model_exceeds_hist_95pct"))


@query
def prob_by_strike(spark, sf):
    """A chart's two probabilities by strike; the risk-neutral one is null where the time value is too thin to settle it (see _settled)."""
    thin = F.expr("mid - greatest(strike * exp(-0.045 * t_years) - spot, 0)") <= 0.01
    s = Inputs(spark, sf).scored
    d = op.by_strike(s).join(s.select("contract_id", thin.alias("thin")), "contract_id")
    neutral = F.when(~F.col("thin"), F.round("risk_neutral_prob_itm", 5) + F.lit(0.0)).alias("risk_neutral_prob_itm")
    return rounded(d.select("contract_id", "strike", "moneyness", "physical_prob_itm", neutral))


@query
def risk_charts(spark, sf):
    """A chart's histogram of simulated returns, with its bins' bounds."""
    return rounded(sc.return_chart(Inputs(spark, sf).own_figures))


@query
def top_disagreements(spark, sf):
    return rounded(op.top(Inputs(spark, sf).scored).select("contract_id", "tail_score"))


@query
def gate_features(spark, sf):
    """With a column missing, so that its default is seen."""
    return rounded(gate.gate_features(_features(spark, sf).drop("vix_change_5d")))


@query
def gate_ensemble(spark, sf):
    d = t.forecasts(spark, sf).select("event_id", F.col("p").alias("p_logistic"), (F.col("p") * F.col("p")).alias("p_gradient_boosting"), F.when(F.col("event_id") % 5 != 0, F.sqrt("p")).alias("p_calibrated_gb"))
    return rounded(gate.ensemble(d).select("event_id", "p_ensemble_mean", "p_ensemble_range", "confidence"))


@query
def gate_calibration(spark, sf):
    return rounded(gate.calibration(t.forecasts(spark, sf), "p", "y"))


@query
def gate_predict(spark, sf):
    """The forecast for the last row: three models learned from the rows whose labels are known by then."""
    i = Inputs(spark, sf)
    return gate.predict_current(i.complete, i.labels)


@query
def gate_outlook(spark, sf):
    """The forecasts for the last row over the three horizons."""
    i = Inputs(spark, sf)
    return gate.outlook(i.complete, i.labels)


@query
def gate_walk_forward(spark, sf):
    """A forecast for every evaluation date, each from its own models."""
    i = Inputs(spark, sf)
    return gate.walk_forward(i.complete, i.labels)


@query
def evt_fit(spark, sf):
    return rounded(sc.evt_fit_ml(sc.evt_exceedances(t.returns(spark, sf))))


@query
def lambda_history(spark, sf):
    f = Inputs(spark, sf).complete
    return rounded(wf.lambda_at(f, wf.history_rows(f)))


@query
def walk_forward(spark, sf):
    i = Inputs(spark, sf)
    return rounded(wf.walk_forward(i.ret, i.complete))


def _series(real):
    return real.withColumn("series", F.lit(t.SERIES))


@query
def acf_error(spark, sf):
    i = Inputs(spark, sf)
    return rounded(re_.acf_errors(_series(i.real), i.models))


def _body(i: Inputs, real=None):
    return rounded(re_.body_realism(_series(i.real if real is None else real), i.models, i.values))


@query
def body_realism(spark, sf):
    return _body(Inputs(spark, sf))


def _stable(i: Inputs, real=None):
    return rounded(re_.stability(i.real if real is None else real, i.models, values=i.values))


@query
def pathwise_stability(spark, sf):
    return _stable(Inputs(spark, sf))


@query
def crisis_archetypes(spark, sf):
    c = fe.crisis_windows(fe.window_features(Inputs(spark, sf).ret))
    return rounded(re_.archetypes(c))


@query
def coverage_at_eps(spark, sf):
    i = Inputs(spark, sf)
    return rounded(re_.coverage(re_.nearest_path(i.crisis, i.windows)))


@query
def precision_at_eps(spark, sf):
    i = Inputs(spark, sf)
    return rounded(re_.precision(i.crisis, i.windows))


@query
def archetype_coverage(spark, sf):
    i = Inputs(spark, sf)
    return rounded(re_.archetype_coverage(i.crisis, i.windows))


@query
def crisis_report(spark, sf):
    i = Inputs(spark, sf)
    return rounded(re_.crisis_report(i.crisis, i.windows))


def _checks(spark, sf):
    """One store for all layers: the source tables are scanned for the series, the draws, the volatility index and the chain."""
    i = Inputs(spark, sf)
    options = i.store.table("summary", lambda: rounded(op.summary(i.scored)))
    backtest, tail = rounded(va.var_backtest(i.real, i.values)), rounded(va.tail_and_quantiles(i.real, i.values))
    layers = he.layers(backtest, tail, rounded(re_.crisis_report(i.crisis, i.windows)), _stable(i), rounded(fe.drift(i.complete)), options)
    return i.store.table("checks", lambda: he.checks(layers))


@query
def health_checks(spark, sf):
    return rounded(_checks(spark, sf))


@query
def model_health(spark, sf):
    return rounded(he.health(_checks(spark, sf)))


@query
def health_table(spark, sf):
    return rounded(he.health_table(rounded(_checks(spark, sf))))


def _brier(spark, sf):
    return rounded(va.calibration(t.forecasts(spark, sf))).select(F.lit("boot").alias("model"), "brier")


@query
def leaderboard(spark, sf):
    i = Inputs(spark, sf)
    crisis = rounded(re_.crisis_report(i.crisis, i.windows))
    d = he.scored_models(_body(i), rounded(va.var_backtest(i.real, i.values)), _stable(i), crisis, _brier(spark, sf))
    return rounded(he.leaderboard(d))


@query
def leaderboard_split(spark, sf):
    """As leaderboard, but backtests read the last fifth of the series and crises the first four fifths."""
    i = Inputs(spark, sf)
    train, test = (i.store.table(k, lambda d=d: d) for k, d in zip(("train", "test"), fe.split(i.real), strict=True))
    typed = re_.by_rule(fe.crisis_windows(fe.window_features(_series(train))))
    crisis = rounded(re_.crisis_report(typed, re_.path_windows(train, i.models)))
    d = he.scored_models(_body(i, test), rounded(va.var_backtest(test, i.values)), _stable(i, test), crisis, _brier(spark, sf))
    return rounded(he.leaderboard(d))
