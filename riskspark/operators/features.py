"""Rolling market features, stress labels and the regime score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, RiskConfig
from ..functions.columns import at_least, drawdown, over, rolling
from ..functions.stretches import sliding_drawdown

WINDOWS = (5, 10, 20, 60)
ANNUAL = 252**0.5


def log_returns(prices: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("dt")
    return prices.withColumn("r", F.ln(F.col("close") / F.lag("close").over(w))).where("r is not null")


def split(ret: DataFrame, fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first part of a numbered series, and the rest, whose rows are numbered from 1 again."""
    cut = ret.agg(F.floor(F.count("*") * fraction).alias("cut"))
    d = ret.crossJoin(F.broadcast(cut))  # one row
    return d.where("rn <= cut").drop("cut"), d.where("rn > cut").withColumn("rn", F.col("rn") - F.col("cut")).drop("cut")


def forward_fill(df: DataFrame, value: str, by: str, order: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def with_vix(ret: DataFrame, vix: DataFrame) -> DataFrame:
    """The level of the last day that has one."""
    return forward_fill(ret.join(vix, "dt", "left"), "vix_level", "series", "rn")


def market_features(ret: DataFrame) -> DataFrame:
    """One sort of the series for all windows."""
    r = F.col("r")
    out = ret.select("*", *[rolling(F.sum, r, w).alias(f"ret_{w}d") for w in WINDOWS], *[(rolling(F.stddev_samp, r, w) * ANNUAL).alias(f"vol_{w}d") for w in WINDOWS])
    out = sliding_drawdown(out, "r", {f"drawdown_{w}d": (1 - w, 0) for w in WINDOWS})
    out = out.select("*", (-F.col("ret_5d")).alias("loss_5d"), (-F.col("ret_20d")).alias("loss_20d"))
    if "vix_level" in ret.columns:
        v = F.col("vix_level")
        w = Window.partitionBy("series").orderBy("rn")
        sd = rolling(F.stddev_samp, v, 252)
        out = out.select("*", (v - F.lag(v, 5).over(w)).alias("vix_change_5d"), (v - F.lag(v, 20).over(w)).alias("vix_change_20d"), ((v - rolling(F.avg, v, 252)) / F.nullif(sd, F.lit(0.0))).alias("vix_z_252d"))
    return out


def cross_features(ret: DataFrame) -> DataFrame:
    """ticker, other, dt, ret_20d, vol_20d of the other and their 60-row correlation, over the dates that both have."""
    a, b = ret.select("dt", "ticker", F.col("r").alias("x")), ret.select("dt", F.col("ticker").alias("other"), F.col("r").alias("y"))
    j = a.join(b, "dt").where("ticker <> other").withColumn("pair", F.concat_ws("/", "ticker", "other"))
    y = F.col("y")
    corr = F.when(F.count(y).over(over(59, 0, "pair", "dt")) == 60, F.corr("x", "y").over(over(59, 0, "pair", "dt")))
    return j.select("ticker", "other", "dt", rolling(F.sum, y, 20, "pair", "dt").alias("ret_20d"), (rolling(F.stddev_samp, y, 20, "pair", "dt") * ANNUAL).alias("vol_20d"), corr.alias("corr_60d"))


def stress_labels(ret: DataFrame, horizons: tuple[int, ...] = (5, 20, 60), fall: float = -0.08, levels: tuple[float, ...] = (0.05, 0.08, 0.10), start_offset: int = 0) -> DataFrame:
    """Per horizon h over rows t .. t+h-1, or from t+start_offset on: the fall, and the volatility against the 95 % quantile of the 20-row one; the last h rows are 0."""
    r = F.col("r")
    d = ret.withColumn("v20", rolling(F.stddev_samp, r, 20))
    cut = d.agg(F.percentile("v20", F.lit(0.95)).alias("cut"), F.max("rn").alias("n"))
    d = d.crossJoin(F.broadcast(cut))  # one row
    d = sliding_drawdown(d, "r", {f"dd{h}": (start_offset, start_offset + h - 1) for h in horizons})
    cols = []
    for h in horizons:
        d = d.withColumn(f"sd{h}", F.stddev_pop(r).over(over(-start_offset, start_offset + h - 1)))
        there = F.col("rn") <= F.col("n") - h - start_offset
        cols.append((there & ((F.col(f"dd{h}") <= fall) | (F.col(f"sd{h}") >= F.col("cut")))).cast("int").alias(f"stress_{h}d"))
        cols += [(there & (F.col(f"dd{h}") <= -x)).cast("int").alias(f"dd_{round(100 * x)}pct_{h}d") for x in levels]
    return d.select("rn", *cols)


def realised_drawdown(ret: DataFrame, horizon: int = 20) -> DataFrame:
    return sliding_drawdown(ret, "r", {"realised_max_dd": (1, horizon)}).select("rn", "realised_max_dd").where("realised_max_dd is not null")


def window_features(ret: DataFrame, width: int = 20) -> DataFrame:
    """Eight features of every full window that starts at a row."""
    r, win = F.col("r"), over(0, width - 1)
    tail = ret.agg(F.percentile("r", F.lit(0.05)).alias("q"))
    d = ret.crossJoin(F.broadcast(tail)).withColumn("a", F.collect_list(r).over(win)).where(F.size("a") == width)  # one row
    return of_windows(d, width, F.col("rn").alias("start"))


def of_windows(d: DataFrame, width: int, *keys: F.Column) -> DataFrame:
    """The eight features of the windows in array a, given the tail threshold q."""
    fives = F.transform(F.sequence(F.lit(1), F.lit(width - 4)), lambda i: F.aggregate(F.slice("a", i, 5), F.lit(0.0), lambda s, x: s + x))
    mean = F.aggregate("a", F.lit(0.0), lambda s, x: s + x) / width
    d = d.withColumn("mean", mean).withColumn("amean", F.aggregate("a", F.lit(0.0), lambda s, x: s + F.abs(x)) / width)
    sd = F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / width)
    asd = F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + (F.abs(x) - F.col("amean")) * (F.abs(x) - F.col("amean"))) / width)
    return d.select(
        *keys, (F.col("mean") * width).alias("cum_return"), (sd * ANNUAL).alias("realised_vol_ann"), drawdown(F.col("a")).alias("max_drawdown"),
        F.array_min("a").alias("worst_1d"), F.array_min(fives).alias("worst_5d"), F.size(F.filter("a", lambda x: x < 0)).cast("long").alias("negative_days"),
        F.size(F.filter("a", lambda x: x <= F.col("q"))).cast("long").alias("tail_days"), asd.alias("vol_of_abs_returns"),
    )


def crisis_windows(features: DataFrame) -> DataFrame:
    """Windows of the highest 5 % volatility or the deepest 5 % drawdown."""
    cut = features.agg(F.percentile("realised_vol_ann", F.lit(0.95)).alias("hi"), F.percentile("max_drawdown", F.lit(0.05)).alias("low"))
    return features.crossJoin(F.broadcast(cut)).where(at_least("realised_vol_ann", "hi") | at_least("low", "max_drawdown")).drop("hi", "low")  # one row


def regime(features: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    """Average-rank percentiles of the latest row in history, the regime score and its label; counts alone, no sort."""
    names = {"vol_20d": "vol_pct", "vix_level": "vix_pct", "drawdown_20d": "dd_stress", "ret_20d": "ret_stress"}
    d = features.dropna(subset=list(names)).select("rn", *[F.round(c, 10).alias(c) for c in names])  # ties are ties whatever the order of sums
    latest = d.agg(*[F.max_by(c, "rn").alias(f"v_{c}") for c in names])
    j = d.crossJoin(F.broadcast(latest))  # one row
    counts = [f(F.when(F.col(c) < F.col(f"v_{c}") if k == "lt" else F.col(c) <= F.col(f"v_{c}"), 1).otherwise(0)).alias(f"{k}_{c}") for c in names for k, f in (("lt", F.sum), ("le", F.sum))]
    one = j.agg(F.count("*").alias("n"), *counts)
    pct = {c: (F.col(f"lt_{c}") + F.col(f"le_{c}") + 1) / (2 * F.col("n")) for c in names}
    pct |= {c: 1 - pct[c] for c in ("drawdown_20d", "ret_20d")}
    one = one.select(*[pct[c].alias(name) for c, name in names.items()])
    raw = sum((F.lit(w) * F.col(name) for w, name in zip(config.weights, names.values(), strict=True)), F.lit(0.0))
    one = one.withColumn("raw_score", raw).withColumn("lambda_t", 1 / (1 + F.exp(-config.steepness * (F.col("raw_score") - config.center))))
    return one.withColumn("regime", F.when(F.col("lambda_t") > 0.70, "crisis").when(F.col("lambda_t") > 0.30, "fragile").otherwise("calm"))


DRIFT = ("vol_20d", "vix_level", "drawdown_20d")


def drift(features: DataFrame, recent: int = 60, least: int = 100) -> DataFrame:
    """drift, status: mean over features of the recent mean's distance from the earlier median, in interquartile ranges.

    Features without spread are left out; UNKNOWN below recent + least rows.
    """
    f = features.select("rn", *DRIFT)
    f = f.crossJoin(F.broadcast(f.agg((F.max("rn") - recent).alias("cut"), F.count("*").alias("n"))))  # one row
    now, then = F.col("rn") > F.col("cut"), F.col("rn") <= F.col("cut")
    q = lambda c, p: F.percentile(F.when(then, F.col(c)), F.lit(p))
    one = f.agg(F.first("n").alias("n"), *[x.alias(f"{k}_{c}") for c in DRIFT for k, x in (("now", F.avg(F.when(now, F.col(c)))), ("mid", q(c, 0.5)), ("iqr", q(c, 0.75) - q(c, 0.25)))])
    each = F.filter(F.array(*[F.when(F.col(f"iqr_{c}") > 0, F.abs(F.col(f"now_{c}") - F.col(f"mid_{c}")) / F.col(f"iqr_{c}")) for c in DRIFT]), lambda x: x.isNotNull())
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(each), F.lit(0))
    one = one.select(F.when(F.col("n") >= recent + least, mean).alias("drift"))
    return one.withColumn("status", F.when(F.col("drift") < 1.0, "LOW").when(F.col("drift") < 2.5, "MODERATE").when(F.col("drift").isNotNull(), "HIGH").otherwise("UNKNOWN"))


def autocorrelation(ret: DataFrame, lags: int = 5) -> DataFrame:
    """lag, acf, acf_sq: by an equi-join on row + lag, so no global window."""
    base = ret.select("rn", "r")
    a = base.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).select((F.col("rn") + F.col("lag")).alias("rn"), "lag", F.col("r").alias("x"))
    j = a.join(base, "rn")
    return j.groupBy(F.col("lag").cast("long").alias("lag")).agg(F.coalesce(F.corr("x", "r"), F.lit(0.0)).alias("acf"), F.coalesce(F.corr(F.col("x") * F.col("x"), F.col("r") * F.col("r")), F.lit(0.0)).alias("acf_sq"))
