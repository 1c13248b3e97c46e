"""The engine's surface: one object over the input DataFrames, answers as plain dictionaries of a few values, and an HTML report.

ret: series, rn, dt, r; vix: dt, vix_level; chain: see sources.tables.chain. A wrong request raises ValueError.
"""

from __future__ import annotations

import html
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import features as fe
from .operators import options as op
from .operators import scenarios as sc
from .operators import walkforward as wf
from .sources import files
from .store import Store


def clean(value: Any) -> Any:
    """JSON-safe: NaN and infinities are None, floats have six places, rows are dictionaries."""
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    return [clean(v) for v in value] if isinstance(value, (list, tuple)) else value


def one(df: DataFrame) -> dict[str, Any]:
    """The single row of a summary."""
    row = df.first()
    return clean(row.asDict(recursive=True)) if row else {}


@dataclass(frozen=True)
class Engine:
    ret: DataFrame
    vix: DataFrame
    chain: DataFrame | None = None
    _made: dict = field(default_factory=dict, compare=False, repr=False)  # stores by what they are of

    @classmethod
    def of_csv(cls, spark: SparkSession, ticker: str, prices: str, vix: str, chain: str | None = None) -> Engine:
        """The engine of one ticker over files; a chain without spot takes the ticker's last price, else its median last price."""
        panel = files.prices_csv(spark, prices).where(F.col("ticker") == ticker)
        ret = fe.log_returns(panel).select(F.col("ticker").alias("series"), "dt", "r").withColumn("rn", F.row_number().over(Window.partitionBy("series").orderBy("dt")).cast("long"))
        if ret.isEmpty():
            raise ValueError(f"no prices of {ticker}")
        puts = files.chain_csv(spark, chain) if chain else None
        if puts is not None and "spot" not in puts.columns:
            puts = op.with_spot(puts.withColumn("ticker", F.lit(ticker)), op.spot(panel)).drop("ticker")
        return cls(ret, files.vix_csv(spark, vix), puts)

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    @property
    def store(self) -> Store:
        """The tables that answers share: features, weights, paths and their figures, each made once."""
        return self._made.setdefault("store", Store(self.ret.sparkSession))

    def release(self) -> None:
        """Deletes those tables; later answers make them anew."""
        if "store" in self._made:
            self._made.pop("store").release()

    def features(self) -> DataFrame:
        return self.store.table("features", lambda: fe.market_features(fe.with_vix(self.ret, self.vix)).dropna())

    def regime(self) -> dict[str, Any]:
        return one(fe.regime(self.features()))

    def paths(self, n_sims: int = 5000, horizon: int = 20) -> DataFrame:
        """sim_id, step, r: draws by regime, with the tail corrected."""
        if not (5 <= horizon <= 60 and 1000 <= n_sims <= 20000):
            raise ValueError("horizon must be 5 to 60 and n_sims 1,000 to 20,000")
        f, table = self.features(), self.store.table
        w = table(f"weights-{horizon}", lambda: sc.block_weights(sc.block_library(f, horizon), f))
        sims = self.ret.sparkSession.range(1, n_sims + 1).withColumnRenamed("id", "sim_id")
        drawn = sc.bootstrap(w.drop("rets"), sims).join(w.select("block_id", "rets"), "block_id")
        steps = table(f"steps-{horizon}-{n_sims}", lambda: drawn.select("sim_id", F.posexplode("rets").alias("step", "r")))
        return table(f"paths-{horizon}-{n_sims}", lambda: sc.evt_correct(steps, self.tail()))

    def tail(self) -> DataFrame:
        """The fit of the losses' tail."""
        beyond = self.store.table("exceedances", lambda: sc.evt_exceedances(self.ret))
        return self.store.table("tail", lambda: sc.evt_fit_ml(beyond))

    def figures(self, n_sims: int = 5000, horizon: int = 20) -> DataFrame:
        """The figures of each path."""
        p = self.paths(n_sims, horizon)
        return self.store.table(f"figures-{horizon}-{n_sims}", lambda: sc.per_path(p))

    def risk(self, n_sims: int = 5000, horizon: int = 20) -> dict[str, Any]:
        stats = one(sc.path_stats(self.figures(n_sims, horizon)))
        return {"horizon": horizon, "n_sims": n_sims, **self.regime(), "stress_metrics": stats, "evt_fit": one(self.tail())}

    def expiries(self) -> list[float]:
        if self.chain is None:
            raise ValueError("no options data")
        return [r.t_years for r in self.chain.select("t_years").distinct().orderBy("t_years").collect()]  # a handful of terms

    def options_disagreement(self, t_years: float | None = None, n_sims: int = 5000, horizon: int = 20, top: int = 20) -> dict[str, Any]:
        terms = self.expiries()
        t = t_years if t_years is not None else terms[min(1, len(terms) - 1)]
        if not any(math.isclose(t, x) for x in terms):
            raise ValueError(f"no options of term {t}")
        puts = self.store.table(f"puts-{t}", lambda: op.bs_metrics(op.liquid(op.quoted(self.chain.where(F.abs(F.col("t_years") - t) < 1e-9)))))
        scored = self._scored(t, puts, n_sims, horizon)
        summary = one(op.summary(scored))
        if not summary.get("n_options"):
            raise ValueError("no liquid puts")
        best = [clean(r.asDict()) for r in op.top(scored, top).collect()]
        return {"t_years": t, **self.regime(), "vol_surface": one(op.vol_surface(puts)), "disagreement_summary": summary, "top_disagreements": best}

    def _scored(self, t: float, puts: DataFrame, n_sims: int, horizon: int) -> DataFrame:
        each, table = self.figures(n_sims, horizon), self.store.table
        priced = table(f"priced-{t}-{horizon}-{n_sims}", lambda: op.physical(puts, each))
        return table(f"scored-{t}-{horizon}-{n_sims}", lambda: op.scored(priced))

    def charts(self, t_years: float | None = None, n_sims: int = 5000, horizon: int = 20) -> dict[str, DataFrame]:
        """The tables behind a dashboard's charts: the histogram of simulated returns, the regime score's history and, with a chain, both probabilities by strike."""
        f = self.features()
        out = {"returns": sc.return_chart(self.figures(n_sims, horizon)), "lambda_history": wf.lambda_at(f, wf.history_rows(f))}
        if self.chain is not None:
            t = self.options_disagreement(t_years, n_sims, horizon)["t_years"]
            out["probability_by_strike"] = op.by_strike(self.store.tables[f"scored-{t}-{horizon}-{n_sims}"])
        return out

    def monitor_row(self, ticker: str, at: str, n_sims: int = 5000, horizon: int = 20) -> DataFrame:
        """One flat row for the monitoring log; keys carry the prefix of their part."""
        r = self.risk(n_sims, horizon)
        flat = {"ticker": ticker, "run_timestamp": at, "horizon": horizon, "n_sims": n_sims, "regime": r["regime"], "lambda_t": r["lambda_t"]}
        flat |= {f"model_{k}": v for k, v in r["stress_metrics"].items()} | {f"evt_{k}": v for k, v in r["evt_fit"].items()}
        if self.chain is not None:
            d = self.options_disagreement(n_sims=n_sims, horizon=horizon)
            flat |= {f"options_{k}": v for k, v in {**d["vol_surface"], **d["disagreement_summary"]}.items()}
        return self.ret.sparkSession.createDataFrame([{k: v for k, v in flat.items() if v is not None}])


def report(title: str, tables: dict[str, DataFrame], most: int = 200, notes: tuple[str, ...] = ()) -> str:
    """A page with small result tables and notes below them; verdicts are badges. At most `most` rows of each are shown, and it says so."""
    colours = {"PASS": "#2e7d32", "WARNING": "#b26a00", "WARNING_MILD": "#b26a00", "FAIL": "#b71c1c"}
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        cell = lambda v: f"<b style='color:{colours[v]}'>{v}</b>" if v in colours else html.escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows[:most])
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>{body}</table>" + (f"<p>First {most} rows.</p>" if len(rows) > most else ""))
    out += [f"<p>{html.escape(x)}</p>" for x in notes]
    return "".join(out)
