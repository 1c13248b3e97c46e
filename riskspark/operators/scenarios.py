"""Block bootstrap of forward paths, tail correction and path statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, RiskConfig
from ..functions.columns import at_least, drawdown, let, over
from ..functions.counter import BLOCKS, TAILS, uniform, uniforms
from ..functions.quantiles import quantiles
from ..store import written

REGIME = ("vol_20d", "drawdown_20d", "ret_20d", "vix_level", "vix_z_252d")
CELLS = 1024


def block_library(features: DataFrame, horizon: int = 20, skip: int = 60, feature_lag: int = 0) -> DataFrame:
    """Overlapping blocks of the complete feature rows but the first `skip`, with the features of their first row, or of the row feature_lag before it."""
    if feature_lag:
        w = Window.partitionBy("series").orderBy("rn")
        features = features.withColumns({c: F.lag(c, feature_lag).over(w) for c in REGIME})
    win, r = over(0, horizon - 1), F.col("r")
    d = features.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy("rn"))).withColumn("rets", F.collect_list(r).over(win)).withColumn("block_vol_ann", F.stddev_pop(r).over(win) * 252**0.5).withColumn("block_return", F.sum(r).over(win)).withColumn("block_worst_1d", F.min(r).over(win))
    d = d.where((F.size("rets") == horizon) & (F.col("place") > skip + feature_lag))
    return d.select(F.col("rn").alias("block_id"), "block_return", "block_vol_ann", drawdown(F.col("rets")).alias("block_max_dd"), "block_worst_1d", *REGIME, "rets")


def block_weights(blocks: DataFrame, features: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    """Gaussian kernel of the distance to the latest features, doubled for crisis blocks, normalised."""
    stats = blocks.agg(*[F.avg(c).alias(f"m_{c}") for c in REGIME], *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in REGIME], F.percentile("block_vol_ann", F.lit(0.95)).alias("hi"), F.percentile("block_max_dd", F.lit(0.05)).alias("low"))
    now = features.dropna(subset=list(REGIME)).agg(*[F.max_by(c, "rn").alias(f"v_{c}") for c in REGIME])
    d = blocks.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(now))  # one row each
    far = sum((F.pow((F.col(c) - F.col(f"v_{c}")) / F.col(f"s_{c}"), 2) for c in REGIME), F.lit(0.0))
    d = d.withColumn("regime_distance", F.sqrt(far)).withColumn("regime_weight", F.exp(-0.5 * F.pow(F.col("regime_distance") / config.bandwidth, 2)))
    d = d.withColumn("is_crisis_block", at_least("block_vol_ann", "hi") | at_least("low", "block_max_dd"))
    d = d.withColumn("w", F.col("regime_weight") * F.when(F.col("is_crisis_block"), config.crisis_weight).otherwise(1.0))
    total = d.agg(F.sum("w").alias("total"), F.count("*").alias("blocks"))
    d = d.crossJoin(F.broadcast(total)).withColumn("final_sample_weight", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("blocks")))
    return d.select("block_id", "regime_distance", "regime_weight", "is_crisis_block", "final_sample_weight", "rets")


def bootstrap(weighted: DataFrame, sims: DataFrame) -> DataFrame:
    """sim_id, block_id: draws by weight, each from the counter (simulation, 0). A draw u meets its interval [lo, hi) by an equi-join on cells of u, not by a cross join."""
    # the series' blocks are few (one per day); sims are many and stay distributed
    w = Window.partitionBy(F.lit(0)).orderBy("block_id")
    d = weighted.withColumn("hi", F.sum("final_sample_weight").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lead("block_id").over(w).isNull())
    d = d.withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0))).withColumn("hi", F.when(F.col("last"), 1.0).otherwise(F.col("hi")))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))
    d = d.select("block_id", "lo", "hi", F.explode(cells).alias("cell"))
    # a row of one value: the conditions on it stay above, where they do not draw once more
    u = F.explode(F.array(uniforms(BLOCKS, F.col("sim_id"), F.lit(0))))
    s = sims.where("sim_id is not null").select("sim_id", u.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    return s.join(d, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("sim_id", "block_id")


def evt_exceedances(ret: DataFrame, alpha: float = 0.05, wide: float = 0.10, least: int = 20) -> DataFrame:
    """threshold and excess per exceedance; the wider quantile where the first leaves fewer than `least`."""
    loss = ret.select("rn", (-F.col("r")).alias("loss"))
    q = loss.agg(F.percentile("loss", F.lit(1 - alpha)).alias("q1"), F.percentile("loss", F.lit(1 - wide)).alias("q2"))
    n = loss.crossJoin(F.broadcast(q)).agg(F.sum((F.col("loss") > F.col("q1")).cast("int")).alias("n"), F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    u = n.select(F.when(F.col("n") < least, F.col("q2")).otherwise(F.col("q1")).alias("threshold"))
    return loss.crossJoin(F.broadcast(u)).where("loss > threshold").select("rn", "threshold", (F.col("loss") - F.col("threshold")).alias("excess"))  # one row


def evt_fit(exceedances: DataFrame) -> DataFrame:
    """Generalised Pareto by probability-weighted moments: threshold, n, xi, sigma."""
    w = Window.partitionBy(F.lit(0)).orderBy("excess", "rn")  # a twentieth of one series
    d = exceedances.withColumn("i", F.row_number().over(w)).crossJoin(F.broadcast(exceedances.agg(F.count("*").alias("n"))))
    d = d.groupBy("threshold", "n").agg(F.avg("excess").alias("b0"), F.avg((1 - (F.col("i") - 0.35) / F.col("n")) * F.col("excess")).alias("b1"))
    gap = F.nullif(F.col("b0") - 2 * F.col("b1"), F.lit(0.0))
    return d.select("threshold", "n", (2 - F.col("b0") / gap).alias("xi"), (2 * F.col("b0") * F.col("b1") / gap).alias("sigma"))


def tail_step(r: F.Column, step: F.Column) -> F.Column:
    """A step r of simulation sim_id under cut, threshold, xi and sigma: what is beyond the cut becomes a draw from the tail, of the counter (sim_id, step)."""
    flat = F.abs("xi") < 1e-9
    tail = lambda u: F.when(flat, -F.col("sigma") * F.ln(1 - u)).otherwise(F.col("sigma") / F.when(flat, 1.0).otherwise(F.col("xi")) * (F.pow(1 - u, -F.col("xi")) - 1))
    return F.when(-r >= F.col("cut"), -(F.col("threshold") + let(uniform(TAILS, F.col("sim_id"), step), tail))).otherwise(r)


def evt_fit_ml(exceedances: DataFrame, grids: tuple[int, ...] = (400, 100, 40), by: tuple[str, ...] = ()) -> DataFrame:
    """Generalised Pareto by maximum likelihood, a fit per group: threshold, n, xi, sigma.

    For theta = xi / sigma the best xi is the mean of ln(1 + theta * excess), which leaves a likelihood in theta alone; it
    is taken on a grid and on ever finer ones around the best, each a sum per theta that is combined before the shuffle.
    """
    y, keys = F.col("excess"), [*by, "threshold", "n"]
    box = exceedances.groupBy(*by).agg(F.first("threshold").alias("threshold"), F.count("*").alias("n"), (-0.999 / F.max(y)).alias("from"), (4 / F.avg(y)).alias("to"))
    for steps in grids:
        step = (F.col("to") - F.col("from")) / steps
        grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.col("from") + step * k)
        points = F.broadcast(box.select(*keys, step.alias("step"), F.explode(grid).alias("theta")))  # a few hundred grid points a group
        d = exceedances.select(*by, "excess")
        d = d.join(points, list(by)) if by else d.crossJoin(points)
        d = d.where("abs(theta) > 1e-9 and 1 + theta * excess > 0").groupBy(*keys, "step", "theta").agg(F.avg(F.ln(1 + F.col("theta") * y)).alias("xi"), F.count("*").alias("inside")).where("inside = n")
        like = -F.ln(F.col("xi") / F.col("theta")) - F.col("xi")
        best = d.groupBy(*keys).agg(F.max_by(F.struct("theta", "xi", "step"), like).alias("b"))
        box = best.select(*keys, (F.col("b.theta") - F.col("b.step")).alias("from"), (F.col("b.theta") + F.col("b.step")).alias("to"))
    return best.select(*keys, F.col("b.xi").alias("xi"), (F.col("b.xi") / F.col("b.theta")).alias("sigma"))


def evt_correct(paths: DataFrame, fit: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Steps in the worst alpha of all become draws from the tail. paths is read twice: write it first where it is dear."""
    cut = quantiles(paths, -F.col("r"), (1 - alpha,)).select(F.col("q")[0].alias("cut"))
    d = paths.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(fit))  # one row each
    return d.select("sim_id", "step", tail_step(F.col("r"), F.col("step")).alias("r"))


def evt_correct_drawn(drawn: DataFrame, blocks: DataFrame, fit: DataFrame, alpha: float = 0.01) -> DataFrame:
    """evt_correct() of simulations (sim_id, block_id) that take whole blocks (block_id, rets), as arrays: sim_id, a, n.

    No step is a row. The cut comes from the blocks' steps, each counted as often as its block was drawn. A block with no step
    beyond the cut is one path of n simulations, under the least sim_id; in the others each simulation draws its own tail. drawn is read
    twice: write it first where it is dear.
    """
    n = drawn.groupBy("block_id").agg(F.min("sim_id").alias("sim_id"), F.count("*").alias("n"))
    counted = written(blocks.select("block_id", "rets").join(n, "block_id"), "counted")
    cut = quantiles(counted.select(F.explode("rets").alias("r"), "n"), -F.col("r"), (1 - alpha,), weight=F.col("n")).select(F.col("q")[0].alias("cut"))
    d = counted.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(fit.select("threshold", "xi", "sigma")))  # one row each
    d = written(d.withColumn("tailed", F.coalesce(F.exists("rets", lambda r: -r >= F.col("cut")), F.lit(False))), "tailed")
    own = drawn.join(d.where("tailed").drop("sim_id", "n"), "block_id").select("sim_id", F.transform("rets", lambda r, step: tail_step(r, step)).alias("a"), F.lit(1).cast("long").alias("n"))
    return d.where("not tailed").select("sim_id", F.col("rets").alias("a"), "n").unionByName(own)


def weight(paths: DataFrame) -> F.Column:
    """How many simulations have a row's path: column n, or 1 where there is none."""
    return F.col("n") if "n" in paths.columns else F.lit(1).cast("long")


def as_arrays(paths: DataFrame, by: tuple[str, ...] = ("model", "sim_id")) -> DataFrame:
    """by, a and n: paths given as arrays a as they are, those given by steps (step, r) gathered by path."""
    if "a" in paths.columns:
        return paths.select(*by, "a", weight(paths).alias("n"))
    d = paths.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("step", "r"))).alias("s"))
    return d.select(*by, F.transform("s", lambda x: x["r"]).alias("a"), F.lit(1).cast("long").alias("n"))


def per_array(paths: DataFrame, by: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """cum, max_dd, vol, worst_1d, worst_5d, negative_days, n of each path, given as an array a of its steps: a narrow map."""
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    k = F.size("a")
    d = paths.select(*by, "a", weight(paths).alias("n"), total("a", lambda x: x).alias("cum")).withColumn("mean", F.col("cum") / k)
    sd = F.sqrt(total("a", lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / k)
    fives = F.transform(F.sequence(F.lit(1), k - 4), lambda i: total(F.slice("a", i, 5), lambda x: x))
    negative = F.size(F.filter("a", lambda x: x < 0)).cast("long")
    return d.select(*by, "cum", drawdown(F.col("a")).alias("max_dd"), (sd * 252**0.5).alias("vol"), F.array_min("a").alias("worst_1d"), F.when(k >= 5, F.array_min(fives)).alias("worst_5d"), negative.alias("negative_days"), "n")


def per_path(paths: DataFrame, by: tuple[str, ...] = ("sim_id",)) -> DataFrame:
    """per_array() of paths given by steps (step, r), which are gathered by path first."""
    return per_array(as_arrays(paths, by), by)


def path_stats(each: DataFrame, config: RiskConfig = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """Drawdown probabilities, value at risk and expected shortfall, quantiles of return and drawdown.

    each, the figures of paths with the number n of simulations that have them, is read twice: write it first where it is dear.
    """
    loss, n, probs = -F.col("cum"), weight(each), (0.01, 0.05, 0.5)
    figures = F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(k).alias("x")) for k in ("cum", "max_dd")]))
    q = quantiles(each.select(*by, n.alias("n"), figures.alias("f")).select(*by, "n", "f.figure", "f.x"), F.col("x"), probs, (*by, "figure"), F.col("n"))
    pick = lambda k: F.max(F.when(F.col("figure") == k, F.col("q"))).alias(f"q_{k}")
    q = q.groupBy(*by).agg(pick("cum"), pick("max_dd"))
    d = each.join(F.broadcast(q), list(by)) if by else each.crossJoin(F.broadcast(q))  # one row per model
    var = {"5pct": -F.col("q_cum")[1], "1pct": -F.col("q_cum")[0]}
    names = {"p01": 0, "p05": 1, "median": 2}
    share = lambda yes, x: F.sum(F.when(yes, n * x)) / F.sum(F.when(yes, n))
    return d.groupBy(*by).agg(
        *[(F.sum(F.when(F.col("max_dd") <= -x, n).otherwise(0)) / F.sum(n)).alias(f"p_drawdown_{round(100 * x)}pct") for x in config.drawdown_levels],
        *[F.first(v).alias(f"var_{k}") for k, v in var.items()],
        *[share(at_least(loss, v), loss).alias(f"es_{k}") for k, v in var.items()],
        *[F.first(F.col("q_cum")[i]).alias(f"{k}_return") for k, i in names.items()],
        *[F.first(F.col("q_max_dd")[i]).alias(f"{k}_max_dd") for k, i in names.items()],
        (F.sum(n * F.col("vol")) / F.sum(n)).alias("mean_vol"),
    )


def worst_paths(each: DataFrame, blocks: DataFrame, n: int = 10) -> DataFrame:
    """The n worst paths by return, ties to the smaller sim_id, with the block they were drawn from."""
    top = each.orderBy("cum", "sim_id").limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy("cum", "sim_id")  # n rows
    return top.withColumn("rank", F.row_number().over(w).cast("long")).join(blocks, "sim_id")


def histogram(each: DataFrame, bins: int = 80) -> DataFrame:
    edge = each.agg(F.min("cum").alias("lo"), F.max("cum").alias("hi"))
    d = each.crossJoin(F.broadcast(edge))  # one row
    b = F.least(F.floor((F.col("cum") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return d.groupBy(F.coalesce(b, F.lit(0)).cast("long").alias("bin")).agg(F.sum(weight(each)).alias("n"))


def return_chart(each: DataFrame, bins: int = 80) -> DataFrame:
    """histogram() with the bins' bounds (bin_from, bin_to), as a chart of simulated returns has them."""
    edge = each.agg(F.min("cum").alias("lo"), F.max("cum").alias("hi"))
    at = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) / bins * (F.col("bin") + k)
    return histogram(each, bins).crossJoin(F.broadcast(edge)).select("bin", "n", at(0).alias("bin_from"), at(1).alias("bin_to"))  # one row
