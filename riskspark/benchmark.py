"""python -m riskspark.benchmark --real R.csv --model NAME=P.csv [--model ...] [--brier NAME=X ...] [--out DIR]: several models ranked by their risk validity."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from . import validate
from .engine import report
from .sources import files
from .store import release_all

#: Read beside the ranks.
NOTES = (
    "A model close to the body of the returns may still fail its backtests or miss the crises: closeness alone is no validity.",
    "Scores: distribution up to 20, value at risk and shortfall up to 35, crisis coverage up to 30, stability over aggregations up to 15, forecasts up to 10 more, 100 in all at most.",
    "HIGH from 70 on: sound in all layers. MEDIUM from 50 on: usable with its failures stated. LOW below: no base for decisions.",
    "Backtests read the last fifth of the series, crises the first four fifths.",
)


def page(board: DataFrame, title: str = "Leaderboard") -> str:
    """The leaderboard as one HTML page."""
    return report(title, {"Ranks": board.orderBy("rank")}, notes=NOTES)


def run(real: DataFrame, models: DataFrame, out: str, brier: dict[str, float] | None = None) -> DataFrame:
    """Validates all models at once and writes leaderboard.html and leaderboard.json beside the tables of validate.run()."""
    spark = real.sparkSession
    scores = spark.createDataFrame(sorted((brier or {}).items()), "model string, brier double")
    board = validate.run(real, models, out, brier=scores, title="Benchmark")["leaderboard"]
    files.write_text(spark, page(board), f"{out}/leaderboard.html")
    files.write_text(spark, files.json_text(validate._rows(board)), f"{out}/leaderboard.json")
    return board


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--real", required=True)
    p.add_argument("--model", action="append", required=True, metavar="NAME=P.csv")
    p.add_argument("--brier", action="append", default=[], metavar="NAME=X")
    p.add_argument("--out", default="benchmark")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    each = [files.paths_csv(spark, path, name) for name, _, path in (m.partition("=") for m in a.model)]
    brier = {name: float(x) for name, _, x in (b.partition("=") for b in a.brier)}
    run(files.returns_csv(spark, a.real), reduce(DataFrame.unionByName, each), a.out, brier).orderBy("rank").show(truncate=False)
    release_all(spark)


if __name__ == "__main__":
    main()
