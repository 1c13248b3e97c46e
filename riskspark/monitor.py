"""python -m riskspark.monitor --ticker T --prices P.csv --vix V.csv [--chain C.csv] --log DIR: appends one row to the monitoring log; --summary shows its tail."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .engine import Engine
from .streaming import monitor

#: What --summary shows, where the log has it.
SHOWN = ("run_timestamp", "ticker", "lambda_t", "regime", "model_p_drawdown_5pct", "model_var_5pct", "options_atm_implied_vol", "options_top_gap", "options_top_interpretation")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--ticker", default="SPY")
    p.add_argument("--horizon", type=int, default=20)
    p.add_argument("--n-sims", type=int, default=5000)
    p.add_argument("--prices", help="CSV of a date and a column of closes a ticker")
    p.add_argument("--vix", help="CSV of a date and a volatility level")
    p.add_argument("--chain", help="CSV of a put chain")
    p.add_argument("--log", default="monitor_log")
    p.add_argument("--summary", action="store_true")
    p.add_argument("--last", type=int, default=10)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if not a.summary:
        if not (a.prices and a.vix):
            p.error("--prices and --vix, or --summary")
        e = Engine.of_csv(spark, a.ticker, a.prices, a.vix, a.chain)
        monitor.append(e.monitor_row(a.ticker, datetime.now(UTC).isoformat(), a.n_sims, a.horizon), a.log)
    rows = monitor.tail(monitor.log(spark, a.log), a.last)
    rows.select(*[c for c in SHOWN if c in rows.columns]).orderBy("ticker", "run_timestamp").show(a.last, truncate=False)


if __name__ == "__main__":
    main()
