"""Model validation: distances between samples, value-at-risk backtests, calibration of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.columns import chi2_tail, log_likelihood
from ..functions.quantiles import quantiles, value_counts
from ..functions.running import running
from ..store import written
from .scenarios import weight


def step_values(models: DataFrame) -> DataFrame:
    """model, v, c: how often each value of a step occurs in a model's paths, given as arrays a (of n simulations) or by steps r; such counts as they are."""
    if "c" in models.columns:
        return models
    if "a" in models.columns:
        models = models.select("model", weight(models).alias("n"), F.explode("a").alias("r"))
    return value_counts(models, F.col("r"), ("model",), weight(models))


def distances(real: DataFrame, models: DataFrame) -> DataFrame:
    """Per model against real (r): Kolmogorov-Smirnov statistic and asymptotic p, Wasserstein-1, from step_values()."""
    counts = step_values(models).withColumnsRenamed({"v": "r", "c": "b"})
    names = counts.select("model").distinct()
    own = names.crossJoin(real.groupBy("r").agg(F.count("*").alias("a"))).select("model", "r", "a", F.lit(0).cast("long").alias("b"))  # a copy of the one real series per model
    h = own.unionByName(counts.select("model", "r", F.lit(0).cast("long").alias("a"), "b"))
    h = written(h.groupBy("model", "r").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "merged")
    totals = h.groupBy("model").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    h = running(h, "r", ("a", "b"), ("model",)).join(F.broadcast(totals), "model")  # a row per model
    gap = F.abs(F.col("upto_a") / F.col("na") - F.col("upto_b") / F.col("nb"))
    d = h.groupBy("model").agg(F.max(gap).alias("ks_stat"), F.sum(gap * (F.col("next") - F.col("r"))).alias("wasserstein"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return d.select("model", "ks_stat", ks_tail(F.col("ks_stat"), F.col("na"), F.col("nb")).alias("ks_pval"), "wasserstein")


def ks_tail(stat: F.Column, n: F.Column, m: F.Column) -> F.Column:
    """The asymptotic probability of a distance of at least stat between samples of n and m."""
    x = F.sqrt(n * m / (n + m)) * stat
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series))


def moments(sample: DataFrame) -> DataFrame:
    """Mean, deviation, skewness and excess kurtosis of all steps of each model, from step_values(): its rows are read twice."""
    counts = step_values(sample)
    mean = counts.groupBy("model").agg(F.sum("c").alias("all"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    d = counts.join(F.broadcast(mean), "model").withColumn("x", F.col("v") - F.col("mean"))  # a row per model
    part = lambda k: (F.sum(F.pow("x", F.lit(k)) * F.col("c")) / F.first("all")).alias(f"m{k}")
    d = d.groupBy("model").agg(F.first("mean").alias("mean"), part(2), part(3), part(4))
    spread = F.nullif(F.col("m2"), F.lit(0.0))
    return d.select("model", "mean", F.sqrt("m2").alias("sd"), (F.col("m3") / F.pow(spread, F.lit(1.5))).alias("skew"), (F.col("m4") / (spread * spread) - 3).alias("excess_kurtosis"))


# The probabilities whose quantiles are compared.
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def tail_and_quantiles(real: DataFrame, models: DataFrame) -> DataFrame:
    """Per model: mass up to the real 0.5 % quantile against the real one's, and the mean absolute quantile error."""
    q = real.agg(F.percentile("r", F.array(F.lit(0.005), *[F.lit(p) for p in QUANTILES])).alias("own"))  # one series
    mass = real.crossJoin(F.broadcast(q)).agg(F.avg((F.col("r") <= F.col("own")[0]).cast("double")).alias("real_mass"))
    one = q.crossJoin(F.broadcast(mass))
    counts = step_values(models)
    m = counts.crossJoin(F.broadcast(one)).groupBy("model").agg((F.sum(F.when(F.col("v") <= F.col("own")[0], F.col("c")).otherwise(0)) / F.sum("c")).alias("mass"))  # one row
    d = m.join(quantiles(counts, F.col("v"), QUANTILES, ("model",), F.col("c")), "model").crossJoin(F.broadcast(one))
    mean = sum((F.abs(F.col("q")[i] - F.col("own")[i + 1]) for i in range(len(QUANTILES))), F.lit(0.0)) / len(QUANTILES)
    return d.select("model", (F.col("mass") / F.nullif(F.col("real_mass"), F.lit(0.0))).alias("tail_mass_ratio"), mean.alias("mean_quantile_error"))


def _verdict(p: F.Column, n: F.Column) -> F.Column:
    return F.when(n < 30, "INSUFFICIENT_DATA").when(p >= 0.05, "PASS").otherwise("FAIL")


def var_backtest(real: DataFrame, models: DataFrame, alphas: tuple[float, ...] = DEFAULT.alphas, legacy_cc: bool = False) -> DataFrame:
    """One row per model and alpha: value at risk and expected shortfall of the model against the realised losses (rn, r).

    The conditional-coverage statistic is the sum of the two likelihood ratios; with legacy_cc that of the two p-values.
    """
    loss = -F.col("r")
    counts = step_values(models).withColumn("v", -F.col("v"))
    at = lambda i: F.col("q")[i]
    part = lambda i, x: F.sum(F.when(F.col("v") >= at(i), x))
    es = counts.join(F.broadcast(quantiles(counts, F.col("v"), [1 - a for a in alphas], ("model",), F.col("c"))), "model")  # a row per model
    es = es.groupBy("model").agg(F.first("q").alias("q"), *[(part(i, F.col("v") * F.col("c")) / part(i, F.col("c"))).alias(f"e{i}") for i in range(len(alphas))])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), at(i).alias("var_model"), F.col(f"e{i}").alias("es_model")) for i, a in enumerate(alphas)]))
    both = es.select("model", each.alias("x")).select("model", "x.*")
    var, es = both.drop("es_model"), both.drop("var_model")
    w = Window.partitionBy("model", "alpha").orderBy("rn")
    b = real.select("rn", loss.alias("loss")).crossJoin(F.broadcast(var)).withColumn("b", (F.col("loss") >= F.col("var_model")).cast("int")).withColumn("before", F.lag("b").over(w))
    pair = lambda x, y: F.sum(((F.col("before") == x) & (F.col("b") == y)).cast("int"))
    d = b.groupBy("model", "alpha").agg(F.first("var_model").alias("var_model"), F.count("*").alias("n_obs"), F.sum("b").alias("n_breaches"), F.avg(F.when(F.col("b") == 1, F.col("loss"))).alias("realised_es"), pair(0, 0).alias("n00"), pair(0, 1).alias("n01"), pair(1, 0).alias("n10"), pair(1, 1).alias("n11"))
    d = d.join(es, ["model", "alpha"])
    n, x, c = F.col("n_obs"), F.col("n_breaches"), F.col
    ratio = lambda a, b: a / F.greatest(b, F.lit(1e-12))
    d = d.withColumn("kupiec_lr", -2 * (log_likelihood(n - x, x, c("alpha")) - log_likelihood(n - x, x, x / n)))
    null = log_likelihood(c("n00") + c("n10"), c("n01") + c("n11"), ratio(c("n01") + c("n11"), c("n00") + c("n01") + c("n10") + c("n11")))
    alt = log_likelihood(c("n00"), c("n01"), ratio(c("n01"), c("n00") + c("n01"))) + log_likelihood(c("n10"), c("n11"), ratio(c("n11"), c("n10") + c("n11")))
    d = d.withColumn("independence_lr", -2 * (null - alt)).withColumn("kupiec_pval", chi2_tail(c("kupiec_lr"), 1)).withColumn("independence_pval", chi2_tail(c("independence_lr"), 1))
    d = d.withColumn("conditional_cov_pval", chi2_tail(c("kupiec_pval") + c("independence_pval") if legacy_cc else c("kupiec_lr") + c("independence_lr"), 2))
    d = d.withColumn("es_severity_ratio", F.when(x >= 5, ratio(c("realised_es"), c("es_model"))))
    s = c("es_severity_ratio")
    d = d.withColumn("es_verdict", F.when(x < 5, "INSUFFICIENT_DATA").when(s.between(0.7, 1.5), "PASS").when(s.between(0.5, 2.0), "WARNING_MILD").otherwise("FAIL"))
    for name in ("kupiec", "independence", "conditional_cov"):
        d = d.withColumn(f"{name}_verdict", _verdict(c(f"{name}_pval"), n))
    passed = sum(((c(f"{k}_verdict") == "PASS").cast("int") for k in ("kupiec", "independence", "conditional_cov", "es")), F.lit(0))
    return d.withColumn("obs_exp_ratio", x / (n * c("alpha"))).withColumn("overall_verdict", F.when(passed >= 3, "PASS").when(passed == 2, "WARNING").otherwise("FAIL"))


def reliability(f: DataFrame, bins: int = 10, closed_last: bool = False) -> DataFrame:
    """bin, mean_predicted, mean_realised, n_obs; p = 1 belongs to no bin unless closed_last."""
    b = F.floor(F.col("p") * bins)
    d = f.withColumn("bin", F.when((F.col("p") == 1.0) & F.lit(closed_last), bins - 1).otherwise(b)).where(F.col("bin").between(0, bins - 1))
    return d.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.avg("p").alias("mean_predicted"), F.avg("y").alias("mean_realised"), F.count("*").alias("n_obs"))


def calibration(f: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Brier score and skill, calibration error, detection at a threshold, verdict."""
    hit = F.col("p") >= threshold
    n = lambda c: F.sum(c.cast("long"))
    y = F.col("y") == 1
    one = f.agg(F.count("*").alias("n_eval"), F.avg("y").alias("base_rate"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & ~y).alias("tn"), n(~hit & y).alias("fn"))
    ece = reliability(f).agg(F.sum(F.col("n_obs") * F.abs(F.col("mean_predicted") - F.col("mean_realised"))).alias("gaps"))
    d = one.crossJoin(F.broadcast(ece)).withColumn("ece", F.col("gaps") / F.col("n_eval")).drop("gaps")  # one row each
    c, base = F.col, F.col("base_rate")
    d = d.withColumn("brier_skill", 1 - c("brier") / F.nullif(base * (1 - base), F.lit(0.0))).withColumn("recall", c("tp") / F.greatest(c("tp") + c("fn"), F.lit(1))).withColumn("precision", c("tp") / F.greatest(c("tp") + c("fp"), F.lit(1))).withColumn("false_alarm_rate", c("fp") / F.greatest(c("fp") + c("tn"), F.lit(1)))
    d = d.withColumn("f1", 2 * c("recall") * c("precision") / F.greatest(c("recall") + c("precision"), F.lit(1e-12)))
    return d.withColumn("verdict", F.when(c("ece") < 0.05, "WELL_CALIBRATED").when(c("ece") < 0.10, "MODERATE_CALIBRATION").otherwise("POORLY_CALIBRATED"))
