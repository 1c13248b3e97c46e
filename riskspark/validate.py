"""python -m riskspark.validate --real R.csv --synthetic P.csv [--model-name M] [--out DIR]: all validation layers of one model's paths.

With --run-engine --ticker T --prices P.csv --vix V.csv [--horizon H --n-sims N] the engine's own paths are validated.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, clean, one, report
from .operators import features as fe
from .operators import health as he
from .operators import realism as re_
from .operators import scenarios as sc
from .operators import validation as va
from .sources import files
from .store import Store, release_all


def layers(real: DataFrame, models: DataFrame, fraction: float = 0.8) -> dict[str, DataFrame]:
    """Tables by layer; backtests read the last part of the series, crises the first. Crisis windows are typed by k-means."""
    store = Store(real.sparkSession)  # ended by store.release_all()
    train, test = (store.table(k, lambda d=d: d) for k, d in zip(("train", "test"), fe.split(real, fraction), strict=True))
    crisis = store.table("crisis", lambda: fe.crisis_windows(fe.window_features(train)))
    typed = store.table("typed", lambda: re_.by_rule(crisis) if crisis.isEmpty() else re_.archetypes(crisis))
    paths = store.table("paths", lambda: sc.as_arrays(models))
    values = store.table("values", lambda: va.step_values(paths))
    windows = store.table("windows", lambda: re_.path_windows(train, paths))
    return {
        "body realism": re_.body_realism(test, paths, values),
        "VaR and ES": va.var_backtest(test, values),
        "pathwise stability": re_.stability(test, paths, values=values),
        "crisis coverage": re_.crisis_report(typed, windows),
        "archetypes": re_.archetype_coverage(typed, windows),
    }


def verdicts(tables: dict[str, DataFrame], drift: DataFrame | None = None, options: DataFrame | None = None, brier: DataFrame | None = None) -> dict[str, DataFrame]:
    """Health per model, its checks as a table, and the leaderboard; what is not given counts as unknown."""
    body, var, stable, crisis = (tables[k] for k in ("body realism", "VaR and ES", "pathwise stability", "crisis coverage"))
    row = body.sparkSession.range(1)
    drift = row.select(F.lit(None).cast("double").alias("drift"), F.lit(None).cast("string").alias("status")) if drift is None else drift
    options = row.select(F.lit(None).cast("double").alias("mean_gap")) if options is None else options
    brier = body.select("model", F.lit(None).cast("double").alias("brier")) if brier is None else brier
    checks = he.checks(he.layers(var, body, crisis, stable, drift, options))
    return {"health": he.health(checks), "diagnostics": he.health_table(checks), "leaderboard": he.leaderboard(he.scored_models(body, var, stable, crisis, brier))}


def run(real: DataFrame, models: DataFrame, out: str, drift: DataFrame | None = None, brier: DataFrame | None = None, title: str = "Validation") -> dict[str, DataFrame]:
    """Writes every table below out: Parquet, of which the verdicts are made, then CSV and JSON, metrics.json and report.html."""
    spark = real.sparkSession
    tables = {}
    for made in (lambda: layers(real, models), lambda: verdicts(tables, drift, brier=brier)):
        for name, df in made().items():
            folder = f"{out}/{name.replace(' ', '_')}"
            df.write.mode("overwrite").parquet(f"{folder}/parquet")
            tables[name] = spark.read.parquet(f"{folder}/parquet")
            files.write_csv(tables[name], f"{folder}/csv")
            files.write_json(tables[name], f"{folder}/json")
    files.write_text(spark, files.json_text({k: _rows(tables[k]) for k in ("body realism", "crisis coverage", "health", "leaderboard")}), f"{out}/metrics.json")
    files.write_text(spark, report(title, tables), f"{out}/report.html")
    return tables


def _rows(df: DataFrame) -> list[dict]:
    """A table of one row a model as dictionaries."""
    return [clean(r.asDict()) for r in df.orderBy("model").collect()]


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--real")
    p.add_argument("--synthetic")
    p.add_argument("--model-name", default="model")
    p.add_argument("--run-engine", action="store_true")
    p.add_argument("--ticker", default="SPY")
    p.add_argument("--prices", help="CSV of a date and a column of closes a ticker")
    p.add_argument("--vix", help="CSV of a date and a volatility level")
    p.add_argument("--horizon", type=int, default=20)
    p.add_argument("--n-sims", type=int, default=5000)
    p.add_argument("--out", default="validation")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.run_engine and a.prices and a.vix:
        e = Engine.of_csv(spark, a.ticker, a.prices, a.vix)
        real, models, name = e.ret.select("series", "rn", "r"), e.paths(a.n_sims, a.horizon), f"engine_{a.ticker}"
        models, drift = models.select(F.lit(name).alias("model"), "sim_id", F.col("step").cast("long").alias("step"), "r"), fe.drift(e.features())
    elif a.real and a.synthetic:
        name, drift = a.model_name, None
        real, models = files.returns_csv(spark, a.real), files.paths_csv(spark, a.synthetic, name)
    else:
        p.error("--real and --synthetic, or --run-engine with --prices and --vix")
    print(one(run(real, models, a.out, drift, title=f"Validation of {name}")["health"])["headline"])
    release_all(spark)


if __name__ == "__main__":
    main()
