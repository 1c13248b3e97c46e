"""Verdicts over the validation layers: health checks, their composite, the risk-validity score and the leaderboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHECKS = ("calibration", "tail_mass", "crisis_coverage", "pathwise_stability", "regime_drift", "options_disagreement")


def layers(backtest: DataFrame, body: DataFrame, crisis: DataFrame, stable: DataFrame, drift: DataFrame, options: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row per model with what the checks read; drift and options are one row each."""
    b = backtest.where(F.round("alpha", 6) == alpha).select("model", "kupiec_verdict", "conditional_cov_verdict", "es_verdict", "obs_exp_ratio")
    usable = F.col("verdict") != "INSUFFICIENT_DATA"
    s = stable.groupBy("model").agg(F.max("aggregation_sensitive").alias("sensitive"), F.sum((F.col("verdict") == "PASS").cast("long")).alias("modes_pass"), F.sum(usable.cast("long")).alias("modes"))
    parts = [b, body.select("model", "tail_mass_ratio"), crisis.select("model", "coverage_at_eps", "precision_trap", "n_archetypes_fail"), s]
    d = reduce(lambda x, y: x.join(y, "model", "full"), parts)
    return d.crossJoin(F.broadcast(drift.select(F.col("drift"), F.col("status").alias("drift_status")))).crossJoin(F.broadcast(options.select("mean_gap")))  # one row each


# Fixed values in the rules and scores below: limits and weights that verdicts depend on.
def _rules() -> dict[str, list[tuple[Column | None, str, float]]]:
    """Per check: conditions in order, each with its status and weight; the last has no condition."""
    c = F.col
    t, cov, gap = c("tail_mass_ratio"), c("coverage_at_eps"), F.abs("mean_gap")
    kup, cc = c("kupiec_verdict") == "PASS", c("conditional_cov_verdict") == "PASS"
    steady = ~c("sensitive")
    return {
        "calibration": [(c("kupiec_verdict").isNull(), "UNKNOWN", 0.0), (c("es_verdict") == "FAIL", "FAIL", 0.0), (kup & cc, "PASS", 1.0), (kup, "WARNING", 0.5), (None, "FAIL", 0.0)],
        "tail_mass": [(t.isNull(), "UNKNOWN", 0.5), (t.between(0.60, 2.00), "PASS", 1.0), ((t >= 0.30) & (t < 0.60), "WARNING", 0.4), (t > 2.00, "WARNING", 0.5), (None, "FAIL", 0.0)],
        "crisis_coverage": [(cov.isNull(), "UNKNOWN", 0.5), ((cov >= 0.70) & ~c("precision_trap") & (c("n_archetypes_fail") == 0), "PASS", 1.0), (cov >= 0.55, "WARNING", 0.5), (None, "FAIL", 0.0)],
        "pathwise_stability": [(F.coalesce(c("modes"), F.lit(0)) == 0, "UNKNOWN", 0.5), (steady & (c("modes_pass") == c("modes")), "PASS", 1.0), (steady, "WARNING", 0.6), (None, "WARNING", 0.3)],
        "regime_drift": [(c("drift_status") == "LOW", "LOW", 1.0), (c("drift_status") == "MODERATE", "MODERATE", 0.6), (c("drift_status") == "HIGH", "HIGH", 0.2), (None, "UNKNOWN", 0.5)],
        "options_disagreement": [(gap.isNull(), "UNKNOWN", 0.5), (gap < 0.03, "NARROW", 0.9), (gap < 0.08, "MODERATE", 0.6), (None, "WIDE", 0.3)],
    }


def _pick(rules: list[tuple[Column | None, str, float]], what: int) -> Column:
    *conditions, last = rules
    out = F.lit(last[what])
    for rule in reversed(conditions):
        out = F.when(rule[0], rule[what]).otherwise(out)
    return out


def checks(layer: DataFrame) -> DataFrame:
    """model, check, status, confidence_weight, figure: six rows a model; figure is what the check reads, in percent for shares."""
    figure = {"calibration": F.col("obs_exp_ratio"), "tail_mass": F.col("tail_mass_ratio"), "crisis_coverage": 100 * F.col("coverage_at_eps"), "pathwise_stability": F.col("modes_pass").cast("double"), "regime_drift": F.col("drift"), "options_disagreement": 100 * F.col("mean_gap")}
    rows = [F.struct(F.lit(k).alias("check"), _pick(r, 1).alias("status"), _pick(r, 2).alias("confidence_weight"), figure[k].alias("figure")) for k, r in _rules().items()]
    return layer.select("model", F.explode(F.array(*rows)).alias("x")).select("model", "x.*")


def health(c: DataFrame) -> DataFrame:
    """One row per model: mean weight, confidence, counts by kind of status, headline."""
    n = lambda *s: F.sum(F.col("status").isin(*s).cast("long"))
    d = c.groupBy("model").agg(F.avg("confidence_weight").alias("confidence_score"), n("PASS", "LOW", "NARROW").alias("n_pass"), n("WARNING", "MODERATE", "HIGH").alias("n_warning"), n("FAIL").alias("n_fail"))
    s = F.round("confidence_score", 9)
    d = d.withColumn("confidence", F.when(s >= 0.75, "HIGH").when(s >= 0.45, "MEDIUM").otherwise("LOW"))
    line = F.when(F.col("n_fail") > 0, F.concat(F.col("n_fail").cast("string"), F.lit(" validation layers fail: do not rely on this model without a closer look")))
    line = line.when(F.col("n_warning") > 1, F.concat(F.col("n_warning").cast("string"), F.lit(" validation warnings: read beside other indicators"))).when(F.col("n_warning") == 1, "One validation warning: look at the flagged layer")
    return d.withColumn("headline", line.otherwise("All validation layers pass"))


def health_table(c: DataFrame) -> DataFrame:
    """The checks as text rows, then an OVERALL row per model."""
    text = F.concat(F.col("status"), F.lit(" at "), F.coalesce(F.format_string("%.2f", "figure"), F.lit("no figure")))
    rows = c.select("model", "check", "status", "confidence_weight", text.alias("detail"))
    return rows.unionByName(health(c).select("model", F.lit("OVERALL").alias("check"), F.col("confidence").alias("status"), F.col("confidence_score").alias("confidence_weight"), F.col("headline").alias("detail")))


def validity_score(d: DataFrame) -> DataFrame:
    """Adds risk_validity_score, 0 to 100: body 20, value at risk and shortfall 35, coverage 30, stability 15, forecasts up to 10 more; and tail_pts, which are shown but not in it."""
    c, zero = F.col, F.lit(0.0)
    body = F.least(F.greatest(zero, 10 - c("ks_stat") * 200) + F.greatest(zero, 5 - c("wasserstein") * 2000) + F.greatest(zero, 5 - c("acf_sq_error") * 50), F.lit(20.0))
    risk = F.when(c("var_5pct_verdict") == "PASS", 12.0).otherwise(0.0) + F.when(c("var_1pct_verdict") == "PASS", 12.0).otherwise(0.0)
    risk = risk + F.coalesce(F.least(F.greatest(zero, 11 - 11 * F.abs(F.ln(F.greatest(c("es_severity_ratio"), F.lit(0.01))))), F.lit(11.0)), zero)
    cover = F.least(F.least(F.coalesce(c("crisis_coverage"), zero) * 30, F.lit(20.0)) + F.least(F.coalesce(c("crisis_precision"), zero) * 10, F.lit(10.0)), F.lit(30.0))
    steady = F.when(c("aggregation_sensitive"), 5.0).otherwise(15.0)
    bonus = F.coalesce(F.least(F.greatest(zero, 10 - c("brier") * 100), F.lit(10.0)), zero)
    tail = F.coalesce(F.greatest(zero, 10 - 10 * F.abs(F.ln(F.greatest(c("tail_mass_ratio"), F.lit(0.01))))), zero)
    tail = F.when(c("tail_mass_ratio").isNull(), zero).otherwise(tail)
    return d.withColumn("tail_pts", tail).withColumn("risk_validity_score", F.round(F.least(body + risk + cover + steady + bonus, F.lit(100.0)), 1))


def scored_models(body: DataFrame, backtest: DataFrame, stable: DataFrame, crisis: DataFrame, brier: DataFrame) -> DataFrame:
    """One row per model with the parts of its score; brier (model, brier) and crisis, which a series without crisis windows leaves empty, may lack models."""
    at = lambda a, name: F.max(F.when(F.round("alpha", 6) == a, F.col(name)))
    passed = lambda a: F.when(at(a, "overall_verdict") == "PASS", "PASS").otherwise("FAIL")
    b = backtest.groupBy("model").agg(passed(0.05).alias("var_5pct_verdict"), passed(0.01).alias("var_1pct_verdict"), at(0.05, "es_severity_ratio").alias("es_severity_ratio"))
    s = stable.groupBy("model").agg(F.max("aggregation_sensitive").alias("aggregation_sensitive"))
    k = crisis.select("model", F.col("coverage_at_eps").alias("crisis_coverage"), F.col("precision_at_eps").alias("crisis_precision"), "precision_trap", "n_archetypes_pass", "n_archetypes_fail")
    d = reduce(lambda x, y: x.join(y, "model"), [body.select("model", "ks_stat", "wasserstein", "acf_sq_error", "tail_mass_ratio"), b, s])
    return validity_score(d.join(k, "model", "left").join(brier, "model", "left"))


def leaderboard(scored: DataFrame) -> DataFrame:
    """rank from 1, best score first, ties by name. A row per model: one task is enough."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("risk_validity_score").desc(), "model")
    band = F.when(F.col("risk_validity_score") >= 70, "HIGH").when(F.col("risk_validity_score") >= 50, "MEDIUM").otherwise("LOW")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("band", band)
