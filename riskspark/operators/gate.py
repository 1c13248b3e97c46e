"""The stress gate: features, three classifiers and their ensemble, walk-forward use, calibration."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .learners import Boosted, isotonic, l1_logistic

# The columns that the gate reads.
COLUMNS = ("vol_5d", "vol_20d", "vol_60d", "ret_5d", "ret_20d", "ret_60d", "drawdown_5d", "drawdown_20d", "drawdown_60d", "vix_level", "vix_z_252d", "vix_change_5d", "loss_5d", "loss_20d")
MEMBERS = ("p_logistic", "p_gradient_boosting", "p_calibrated_gb")


def gate_features(features: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """rn and the columns; missing ones and nulls are 0."""
    return features.select("rn", *[(F.coalesce(F.col(c), F.lit(0.0)) if c in features.columns else F.lit(0.0)).alias(c) for c in columns])


@dataclass(frozen=True)
class Gate:
    columns: tuple[str, ...]
    scale: DataFrame
    logistic: object
    boosted: object
    folds: tuple

    def drivers(self, n: int = 5) -> list[tuple[str, float]]:
        """The logistic model's largest coefficients by size."""
        c = [abs(float(x)) for x in self.logistic.coefficients]
        return [(self.columns[i], c[i]) for i in sorted(range(len(c)), key=lambda i: (-c[i], i))[:n]]

    def predict(self, rows: DataFrame) -> DataFrame:
        d = _scaled(rows, self.scale, self.columns)
        p = lambda m, d, name: m.transform(d).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        d = p(self.logistic, d, MEMBERS[0])
        d = p(self.boosted, d, MEMBERS[1])
        for k, (boosted, iso) in enumerate(self.folds):
            d = iso.transform(p(boosted, d, "score")).withColumnRenamed("prediction", f"iso{k}").drop("score")
        cal = reduce(lambda a, b: a + b, [F.col(f"iso{k}") for k in range(len(self.folds))]) / len(self.folds) if self.folds else F.col(MEMBERS[1])
        return ensemble(d.withColumn(MEMBERS[2], cal).select("rn", *MEMBERS))


def _scaled(rows: DataFrame, scale: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    d = rows.crossJoin(F.broadcast(scale))  # one row
    d = d.select(*rows.columns, *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(f"z_{c}") for c in columns])
    return VectorAssembler(inputCols=[f"z_{c}" for c in columns], outputCol="z").transform(d).drop(*[f"z_{c}" for c in columns])


def fit(train: DataFrame, columns: tuple[str, ...] = COLUMNS, trees: int = 100, folds: int = 3, c: float = 0.1, seed: int = 42) -> Gate:
    """train: rn, the columns, y. An L1 logistic model on scaled columns, boosted trees, and boosted trees with an isotonic map learned on each fold in turn.

    A fold is a run of rows. A fold whose other rows hold one class only is left out; without any fold the boosted trees stand in.
    """
    scale = train.agg(*[F.avg(x).alias(f"m_{x}") for x in columns], *[F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0)).alias(f"s_{x}") for x in columns])
    d = _scaled(train, scale, columns).withColumn("y", F.col("y").cast("double"))
    d = d.withColumn("fold", F.ntile(folds).over(Window.partitionBy(F.lit(0)).orderBy("rn"))).select("rn", "z", "y", "fold").cache()  # one row a day
    counts = {r.fold: (r.n, r.ones) for r in d.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()}
    n, ones = (sum(v[i] for v in counts.values()) for i in (0, 1))
    gbt = GBTClassifier(featuresCol="z", labelCol="y", maxIter=trees, maxDepth=3, stepSize=0.05, seed=seed)
    logistic = LogisticRegression(featuresCol="z", labelCol="y", elasticNetParam=1.0, regParam=1 / (c * n), standardization=False, maxIter=1000).fit(d)
    boosted = gbt.fit(d)
    held = []
    for k, (size, own) in sorted(counts.items()):
        if 0 < ones - own < n - size:
            m = gbt.fit(d.where(F.col("fold") != k))
            scores = m.transform(d.where(F.col("fold") == k)).select(vector_to_array("probability")[1].alias("score"), "y")
            held.append((m, IsotonicRegression(featuresCol="score", labelCol="y").fit(scores)))
    d.unpersist()
    return Gate(columns, scale, logistic, boosted, tuple(held))


def ensemble(p: DataFrame, members: tuple[str, ...] = MEMBERS) -> DataFrame:
    """Adds p_ensemble_mean and p_ensemble_range over the members that are there, and the confidence by the range."""
    a = F.filter(F.array(*members), lambda x: x.isNotNull() & ~F.isnan(x))
    d = p.withColumn("p_ensemble_mean", F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0)))
    d = d.withColumn("p_ensemble_range", F.when(F.size(a) > 1, F.array_max(a) - F.array_min(a)).otherwise(0.0))
    return d.withColumn("confidence", F.when(F.col("p_ensemble_range") < 0.05, "HIGH").when(F.col("p_ensemble_range") < 0.15, "MEDIUM").otherwise("LOW"))


#: The forecasts of one date: each is a task of its own.
TASKS = ("logistic", "boosted", "fold0", "fold1", "fold2")


def horizon_of(target: str) -> int:
    """The rows that a label looks at, from its name: stress_20d looks at 20, its own first."""
    return int(target.rpartition("_")[2].removesuffix("d"))


def forecasts(features: DataFrame, labels: DataFrame, dates: DataFrame, target: str = "stress_20d", trees: int = 100, positives: int = 5, legacy_labels: bool = False, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The ensemble at each row of dates (rn), all dates in one job: rn, the members' probabilities, their ensemble, top_driver_1..3.

    A date learns from the rows whose labels were known by then, those at least the label's horizon before it; with
    legacy_labels from all rows before it, whose last labels look past the date. Dates and members are dealt to tasks, each
    of which holds one series of days and one model. Dates with fewer than `positives` labels of 1, or without a 0, have no row.
    """
    f = gate_features(features, columns)
    known = f.join(labels.select("rn", F.col(target).cast("double").alias("y")), "rn")
    lag = 1 if legacy_labels else horizon_of(target)
    at = F.broadcast(dates.select(F.col("rn").alias("at")))  # evaluation dates: at most a row a day
    train = known.join(at, F.col("rn") <= F.col("at") - lag)
    able = train.groupBy("at").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).where(f"ones >= {positives} and ones < n").select("at")
    asked = f.join(at, F.col("rn") == F.col("at")).withColumn("y", F.lit(None).cast("double"))
    rows = train.unionByName(asked).join(F.broadcast(able), "at").withColumn("task", F.explode(F.array(*[F.lit(x) for x in TASKS])))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        own, last = pdf[pdf.y.notna()], pdf[pdf.y.isna()]
        x, y, z = own[list(columns)].to_numpy(float), own.y.to_numpy(float), last[list(columns)].to_numpy(float)
        p, drivers = None, []
        if key[1] == "logistic":
            mean, sd = x.mean(axis=0), x.std(axis=0)
            sd[sd == 0] = 1.0
            w, constant = l1_logistic((x - mean) / sd, y)
            p = 1 / (1 + np.exp(-(((z - mean) / sd) @ w + constant)))
            drivers = [columns[i] for i in sorted(range(len(w)), key=lambda i: (-abs(w[i]), i))[:3]]
        elif key[1] == "boosted":
            p = 1 / (1 + np.exp(-Boosted(trees).fit(x, y).logits(z)))
        else:
            fold = np.arange(len(y)) * 3 // len(y) == int(key[1][-1])  # a run of rows
            if 0 < y[~fold].sum() < (~fold).sum() and fold.any():
                m = Boosted(trees).fit(x[~fold], y[~fold])
                p = np.interp(m.logits(z), *isotonic(m.logits(x[fold]), y[fold]))
        return pd.DataFrame({"rn": [int(key[0])], "task": [key[1]], "p": [None if p is None else float(p[0])], "drivers": [drivers]})

    each = rows.groupBy("at", "task").applyInPandas(run, "rn long, task string, p double, drivers array<string>")
    of = lambda name: F.max(F.when(F.col("task") == name, F.col("p")))
    d = each.groupBy("rn").agg(of("logistic").alias(MEMBERS[0]), of("boosted").alias(MEMBERS[1]), F.coalesce(F.avg(F.when(F.col("task").startswith("fold"), F.col("p"))), of("boosted")).alias(MEMBERS[2]), F.max(F.when(F.col("task") == "logistic", F.col("drivers"))).alias("drivers"))
    return ensemble(d).select("rn", *MEMBERS, "p_ensemble_mean", "p_ensemble_range", "confidence", *[F.get("drivers", F.lit(k - 1)).alias(f"top_driver_{k}") for k in (1, 2, 3)])


def predict_current(features: DataFrame, labels: DataFrame, target: str = "stress_20d", least: int = 504, trees: int = 100, legacy_labels: bool = False) -> DataFrame:
    """The ensemble at the last row, learned from the rows whose labels are known by then. Empty below `least` rows."""
    n = features.agg(F.count("*").alias("n"), F.max("rn").alias("rn")).where(F.col("n") >= least)
    return forecasts(features, labels, n.select("rn"), target, trees, 1, legacy_labels)


def outlook(features: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("stress_5d", "stress_20d", "stress_60d"), least: int = 504, trees: int = 100) -> DataFrame:
    """predict_current() for several targets: a row each, with its name."""
    each = [predict_current(features, labels, t, least, trees).withColumn("target", F.lit(t)) for t in targets]
    return reduce(DataFrame.unionByName, each)


def walk_forward(features: DataFrame, labels: DataFrame, target: str = "stress_20d", least: int = 504, every: int = 21, tail: int = 63, trees: int = 100, legacy_labels: bool = False) -> DataFrame:
    """One row per evaluation date: the ensemble learned from what was known at it, and what came (realised).

    Dates are every `every` complete rows from the one with `least` rows before it to the one with more than `tail` after it.
    """
    known = gate_features(features).select("rn").join(labels.select("rn", F.col(target).alias("realised")), "rn")
    w = Window.partitionBy(F.lit(0)).orderBy("rn")  # one row a day
    d = known.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    dates = d.where((F.col("i") >= least) & (F.col("i") < F.col("n") - tail) & ((F.col("i") - least) % every == 0))
    return forecasts(features, labels, dates, target, trees, 5, legacy_labels).join(dates.select("rn", "realised"), "rn")


def calibration(f: DataFrame, p: str = "p_ensemble_mean", y: str = "realised", bins: int = 8, threshold: float = 0.15) -> DataFrame:
    """Brier score and skill, unweighted calibration error over quantile bins, detection. No row below 20 forecasts."""
    d = f.select(F.col(p).alias("p"), F.col(y).cast("double").alias("y")).dropna()
    edges = d.agg(F.percentile("p", F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("edges"))
    b = F.size(F.filter("edges", lambda e: e < F.col("p")))
    gaps = d.crossJoin(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.abs(F.avg("p") - F.avg("y")).alias("gap")).agg(F.avg("gap").alias("ece"))  # one row
    hit, yes = F.col("p") >= threshold, F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    one = d.agg(F.count("*").alias("n_obs"), F.avg("y").alias("base_rate"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), n(hit & yes).alias("tp"), n(hit & ~yes).alias("fp"), n(~hit & ~yes).alias("tn"), n(~hit & yes).alias("fn")).where("n_obs >= 20")
    c = F.col
    one = one.crossJoin(F.broadcast(gaps)).withColumn("brier_skill", 1 - c("brier") / F.nullif(c("base_rate") * (1 - c("base_rate")), F.lit(0.0)))
    one = one.withColumn("recall", c("tp") / F.greatest(c("tp") + c("fn"), F.lit(1))).withColumn("precision", c("tp") / F.greatest(c("tp") + c("fp"), F.lit(1))).withColumn("false_alarm_rate", c("fp") / F.greatest(c("fp") + c("tn"), F.lit(1)))
    return one.withColumn("verdict", F.when(c("ece") < 0.05, "WELL_CALIBRATED").when(c("ece") < 0.10, "MODERATE_CALIBRATION").otherwise("POORLY_CALIBRATED"))
