"""How far scenario models (model, sim_id, step, r) resemble a return series (rn, r): body, serial dependence, crises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at_least, chi2_tail, log_likelihood
from ..functions.quantiles import quantiles
from ..store import written
from . import features as fe
from . import validation as va
from .nearest import Near, search
from .scenarios import as_arrays, weight

# The features of a window, in their order.
FEATURES = ("cum_return", "realised_vol_ann", "max_drawdown", "worst_1d", "worst_5d", "negative_days", "tail_days", "vol_of_abs_returns")
# The radii at which coverage is measured.
EPSILONS = tuple(k / 2 for k in range(1, 11))
# Names of archetypes by number.
ARCHETYPES = ("Fast crash", "Slow bleed", "Volatility spike", "Rate-shock selloff", "Liquidity freeze", "Bear-market grind", "Rebound volatility")


def acf_errors(real: DataFrame, models: DataFrame, lags: int = 5) -> DataFrame:
    """model, acf_error, acf_sq_error: mean absolute difference of autocorrelations. A model's pairs lie within a path.

    Pairs are made from a path's array and summed before the shuffle; no step is shuffled but those of paths given by steps.
    """
    paths = as_arrays(models)
    d = paths.select("model", "n", "a", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag")).where(F.size("a") > F.col("lag"))
    k, m = F.col("lag"), F.size("a")
    pairs = F.zip_with(F.slice("a", F.lit(1), m - k), F.slice("a", k + 1, m - k), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    d = d.select("model", "n", "lag", F.explode(pairs).alias("p")).select("model", "n", "lag", "p.x", "p.y")
    n = F.col("n")

    def corr(x: Column, y: Column) -> Column:
        mean = lambda c: F.sum(n * c) / F.sum(n)
        sd = F.sqrt((mean(x * x) - mean(x) * mean(x)) * (mean(y * y) - mean(y) * mean(y)))
        return F.coalesce((mean(x * y) - mean(x) * mean(y)) / F.nullif(sd, F.lit(0.0)), F.lit(0.0))

    x, y = F.col("x"), F.col("y")
    each = d.groupBy("model", "lag").agg(corr(x, y).alias("m1"), corr(x * x, y * y).alias("m2"))
    own = fe.autocorrelation(real, lags)
    j = each.join(F.broadcast(own), "lag")  # a row a lag
    gap = lambda a, b: (F.sum(F.abs(F.col(a) - F.col(b))) / lags)
    return j.groupBy("model").agg(gap("acf", "m1").alias("acf_error"), gap("acf_sq", "m2").alias("acf_sq_error"))


def quantile_errors(real: DataFrame, models: DataFrame) -> DataFrame:
    names = [f"q{round(100 * p):02d}" for p in va.QUANTILES]
    own = real.agg(F.percentile("r", F.array(*[F.lit(p) for p in va.QUANTILES])).alias("own"))  # one series
    m = quantiles(va.step_values(models), F.col("v"), va.QUANTILES, ("model",), F.col("c"))
    return m.crossJoin(F.broadcast(own)).select("model", *[F.abs(F.col("q")[i] - F.col("own")[i]).alias(f"{n}_error") for i, n in enumerate(names)])  # one row


def body_realism(real: DataFrame, models: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One row per model: distances, dependence, tail mass, quantile errors, moments of both. Says nothing of risk validity.

    values: step_values() of the models where they are there already; else they are written here, once.
    """
    values = written(va.step_values(models), "values") if values is None else values
    own = va.moments(real.select(F.lit("real").alias("model"), "r")).select(*[F.col(c).alias(f"real_{c}") for c in ("mean", "sd", "skew", "excess_kurtosis")])
    syn = va.moments(values).select("model", *[F.col(c).alias(f"synth_{c}") for c in ("mean", "sd", "skew", "excess_kurtosis")])
    parts = [va.distances(real, values), acf_errors(real, models), va.tail_and_quantiles(real, values), quantile_errors(real, values), syn]
    return reduce(lambda a, b: a.join(F.broadcast(b), "model"), parts).crossJoin(F.broadcast(own))  # a row per model


def stability(real: DataFrame, models: DataFrame, alpha: float = 0.05, values: DataFrame | None = None) -> DataFrame:
    """One row per model and mode of aggregation: value at risk, breaches, Kupiec test; sensitive where verdicts differ.

    The modes beside the pooled one set a path's whole return against daily losses, as the model defines them.
    """
    values = va.step_values(models) if values is None else values
    pooled = quantiles(values, -F.col("v"), (1 - alpha,), ("model",), F.col("c")).select("model", F.col("q")[0].alias("pooled"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    cum = as_arrays(models).select("model", "n", total.alias("cum"))
    modes = {"pathwise_median": 0.5, "pathwise_q25": 0.25, "pathwise_q75": 0.75}
    each = quantiles(cum, F.col("cum"), tuple(modes.values()), ("model",), F.col("n"))
    one = pooled.join(each.select("model", *[(-F.col("q")[i]).alias(m) for i, m in enumerate(modes)]), "model")
    var = one.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("var")) for m in ("pooled", *modes)])).alias("x")).select("model", "x.*")
    d = real.select((-F.col("r")).alias("loss")).crossJoin(F.broadcast(var)).groupBy("model", "mode").agg(F.first("var").alias("var"), F.count("*").alias("n_obs"), F.sum((F.col("loss") >= F.col("var")).cast("long")).alias("n_breach"))  # four rows a model
    n, x = F.col("n_obs"), F.col("n_breach")
    d = d.withColumn("kupiec_pval", chi2_tail(-2 * (log_likelihood(n - x, x, F.lit(alpha)) - log_likelihood(n - x, x, x / n)), 1))
    d = d.withColumn("verdict", F.when(n < 30, "INSUFFICIENT_DATA").when(F.col("kupiec_pval") >= 0.05, "PASS").otherwise("FAIL"))
    kinds = F.size(F.collect_set(F.when(F.col("verdict") != "INSUFFICIENT_DATA", F.col("verdict"))).over(Window.partitionBy("model")))
    return d.withColumn("aggregation_sensitive", kinds > 1).withColumn("flag", F.when(F.col("aggregation_sensitive"), "WARNING").otherwise("OK"))


def path_windows(real: DataFrame, models: DataFrame, width: int = 20) -> DataFrame:
    """model, sim_id, at, n and the features of every full window inside a path, with the real series' tail threshold.

    at counts a path's windows from 0; a path of fewer steps than the width has none. models holds steps (step, r), or
    whole paths as arrays a, which spares their shuffle.
    """
    q = real.agg(F.percentile("r", F.lit(0.05)).alias("q"))
    d = as_arrays(models)
    starts = F.when(F.size("a") >= width, F.sequence(F.lit(0), F.size("a") - width))
    d = d.select("model", "sim_id", "n", "a", F.explode(starts).alias("at")).withColumn("a", F.slice("a", F.col("at") + 1, width))
    return fe.of_windows(d.crossJoin(F.broadcast(q)), width, F.col("model"), F.col("sim_id"), F.col("at"), F.col("n"))  # one row


def by_rule(crisis: DataFrame) -> DataFrame:
    """archetype 0: both the volatility and the drawdown are extreme among crisis windows, 1: the drawdown, 2: the others."""
    cut = crisis.agg(F.percentile("realised_vol_ann", F.lit(0.5)).alias("v"), F.percentile("max_drawdown", F.lit(0.5)).alias("d"))
    deep, wild = at_least("d", "max_drawdown"), at_least("realised_vol_ann", "v")  # windows that share a fall are ties
    return crisis.crossJoin(F.broadcast(cut)).withColumn("archetype", F.when(deep & wild, 0).when(deep, 1).otherwise(2).cast("long")).drop("v", "d")  # one row


def archetypes(crisis: DataFrame, k: int = 5, seed: int = 42, starts: int = 10) -> DataFrame:
    """Adds archetype and its name: k-means on scaled features, the best of some starts; numbers by centre, deepest drawdown first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    st = crisis.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in FEATURES])
    z = crisis.crossJoin(F.broadcast(st)).select("*", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(f"z_{c}") for c in FEATURES])  # one row
    z = VectorAssembler(inputCols=[f"z_{c}" for c in FEATURES], outputCol="z").transform(written(z, "scaled"))
    fits = [KMeans(k=k, featuresCol="z", predictionCol="c", seed=seed + i).fit(z) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    at = FEATURES.index("max_drawdown")
    order = sorted(range(len(best.clusterCenters())), key=lambda i: float(best.clusterCenters()[i][at]))
    number = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)]), F.col("c")).cast("long")
    d = best.transform(z).withColumn("archetype", number)
    return d.select(*crisis.columns, "archetype", archetype_name(F.col("archetype")).alias("archetype_name"))


def archetype_name(c: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in ARCHETYPES]), c.cast("int")), F.concat(F.lit("Cluster "), c.cast("string")))


def near(crisis: DataFrame, windows: DataFrame, epsilon: float = 2.0) -> Near:
    """Both sides of the nearest neighbours between crisis windows and the windows of paths, in one pass over the latter.

    Features are scaled by their deviation over both sets, a model at a time. The crisis windows, at most a tenth of one
    daily series, lie in a ball tree a model; each task streams windows past it (operators/nearest.py).
    """
    counted = windows.select("model", weight(windows).alias("n"), *FEATURES)
    names = counted.select("model").distinct()
    both = written(counted.unionByName(crisis.select(F.lit(1).cast("long").alias("n"), *FEATURES).crossJoin(names)), "both")  # a crisis window a model
    mean = both.groupBy("model").agg(F.sum("n").alias("all"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"m_{c}") for c in FEATURES])
    d = both.join(F.broadcast(mean), "model")  # a row a model
    sd = lambda c: F.sqrt(F.sum(F.col("n") * F.pow(F.col(c) - F.col(f"m_{c}"), F.lit(2))) / F.first("all"))
    # a feature that never varies leaves rounding alone
    scale = d.groupBy("model").agg(F.first("all").alias("all"), *[F.when(sd(c) > 1e-12 * F.greatest(F.max(F.abs(c)), F.lit(1e-300)), sd(c)).otherwise(1.0).alias(c) for c in FEATURES])
    return search(crisis.select("start", *FEATURES), counted, scale, FEATURES, epsilon)


def nearest_path(crisis: DataFrame, windows: DataFrame) -> DataFrame:
    """model, start, dist, dist_sample: each crisis window's distance to the nearest window of a path, scaled by the population's and by the sample's deviation."""
    return near(crisis, windows).crises


def coverage(nearest: DataFrame, epsilons: tuple[float, ...] = EPSILONS) -> DataFrame:
    d = nearest.withColumn("epsilon", F.explode(F.array(*[F.lit(e) for e in epsilons])))
    d = d.groupBy("model", "epsilon").agg(F.sum((F.col("dist") <= F.col("epsilon")).cast("long")).alias("n_covered"), F.count("*").alias("n_total"))
    return d.withColumn("coverage", F.col("n_covered") / F.col("n_total"))


def archetype_coverage(typed: DataFrame, windows: DataFrame, epsilon: float = 2.0, found: Near | None = None) -> DataFrame:
    """Coverage by archetype; scaled by the sample deviation. found: near() where it is there already."""
    nearest = (near(typed, windows, epsilon) if found is None else found).crises.select("model", "start", F.col("dist_sample").alias("dist"))
    d = nearest.join(typed.select("start", "archetype"), "start")
    d = d.groupBy("model", "archetype").agg(F.count("*").alias("n_windows"), F.avg((F.col("dist") <= epsilon).cast("double")).alias("coverage"), F.avg("dist").alias("mean_nearest_dist"))
    return d.withColumn("archetype_name", archetype_name(F.col("archetype"))).withColumn("verdict", F.when(F.col("coverage") >= 0.60, "PASS").when(F.col("coverage") >= 0.40, "WARNING").otherwise("FAIL"))


def precision(crisis: DataFrame, windows: DataFrame, epsilon: float = 2.0, found: Near | None = None) -> DataFrame:
    """model, precision, n_windows, verdict: the share of the paths' windows with a crisis window nearby."""
    d = (near(crisis, windows, epsilon) if found is None else found).windows.select("model", (F.col("n_near") / F.col("n_windows")).alias("precision"), "n_windows")
    return d.withColumn("verdict", F.when(F.col("precision") >= 0.40, "PASS").when(F.col("precision") >= 0.25, "WARNING").otherwise("FAIL"))


def crisis_report(typed: DataFrame, windows: DataFrame, epsilon: float = 2.0) -> DataFrame:
    """One row per model: coverage, precision, archetypes by verdict, the precision trap, overall verdict."""
    typed = written(typed, "typed")
    found = near(typed, windows, epsilon)
    cov = coverage(found.crises, (epsilon,)).select("model", F.col("coverage").alias("coverage_at_eps"), F.col("n_total").alias("n_crisis_windows"))
    pre = precision(typed, windows, epsilon, found).select("model", F.col("precision").alias("precision_at_eps"), F.col("verdict").alias("precision_verdict"), F.col("n_windows").alias("n_synthetic_windows"))
    n = lambda v: F.sum((F.col("verdict") == v).cast("long")).alias(f"n_archetypes_{v.lower()}")
    arch = archetype_coverage(typed, windows, epsilon, found).groupBy("model").agg(F.count("*").alias("n_archetypes_tested"), n("PASS"), n("FAIL"), n("WARNING"))
    d = cov.join(pre, "model").join(arch, "model").withColumn("precision_trap", (F.col("precision_at_eps") >= 0.70) & (F.col("coverage_at_eps") < 0.50))
    return d.withColumn("overall_verdict", F.when((F.col("coverage_at_eps") >= 0.65) & ~F.col("precision_trap"), "PASS").when(F.col("coverage_at_eps") >= 0.50, "WARNING").otherwise("FAIL"))
