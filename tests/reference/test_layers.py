"""Parts without SQL: walk-forward against the plans of a single date, the gate, archetypes, readers, engine, report."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark import benchmark, monitor, validate
from riskspark.engine import Engine, clean, report
from riskspark.functions.columns import bs_price
from riskspark.functions.quantiles import quantiles
from riskspark.operators import features as fe
from riskspark.operators import gate, health, options, realism, validation
from riskspark.operators import scenarios as sc
from riskspark.operators import walkforward as wf
from riskspark.operators.health import CHECKS
from riskspark.sources import files
from riskspark.sources import tables as t
from riskspark.streaming.monitor import append

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    ret = t.returns(spark, SF).cache()
    return ret, fe.market_features(fe.with_vix(ret, t.vix(spark, SF))).dropna().cache()


def test_a_date_of_the_walk_forward_equals_the_single_plans(spark, series):
    ret, f = series
    at = f.agg(F.max("rn")).first()[0] - 25
    rows = spark.createDataFrame([(at,)], "rn long")
    got = wf.forecasts(ret, f, rows, sims=500).first().asDict()
    old_r, old_f = ret.where(F.col("rn") <= at), f.where(F.col("rn") <= at)
    w = sc.block_weights(sc.block_library(old_f), old_f)
    sims = spark.range(1, 501).withColumnRenamed("id", "sim_id")
    steps = sc.bootstrap(w.drop("rets"), sims).join(w.select("block_id", "rets"), "block_id").select("sim_id", F.posexplode("rets").alias("step", "r"))
    want = sc.path_stats(sc.per_path(sc.evt_correct(steps, sc.evt_fit(sc.evt_exceedances(old_r))))).first().asDict()
    for k in ("p_drawdown_5pct", "p_drawdown_8pct", "var_5pct", "var_1pct", "es_5pct", "median_return"):
        assert got[k] == pytest.approx(want[k], abs=1e-9), k
    lam, one = wf.lambda_at(f, rows).first(), fe.regime(old_f).first()
    assert lam.lambda_t == pytest.approx(one.lambda_t) and lam.regime == one.regime


def test_the_gate_learns_and_names_its_driver(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.2 * rng.normal(size=300) > 0).astype(int)
    d = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "rn long, vol_5d double, ret_5d double, y int")
    g = gate.fit(d, ("vol_5d", "ret_5d"), trees=3)
    assert g.drivers(1)[0][0] == "vol_5d"
    p = {r.rn: r for r in g.predict(d.drop("y")).collect()}
    high, low = int(x[:, 0].argmax()), int(x[:, 0].argmin())
    assert p[high].p_ensemble_mean > 0.5 > p[low].p_ensemble_mean and p[low].confidence in ("HIGH", "MEDIUM", "LOW")


def test_archetypes_cover_all_windows(spark, series):
    c = fe.crisis_windows(fe.window_features(series[0])).cache()
    d = realism.archetypes(c, k=3, starts=1)
    n = d.groupBy("archetype").agg(F.avg("max_drawdown").alias("m")).orderBy("archetype").collect()
    assert d.count() == c.count() and [r.m for r in n] == sorted(r.m for r in n)


def test_paths_of_any_length_give_all_their_full_windows(spark, series):
    lengths = {1: 25, 2: 60, 3: 20, 4: 19, 5: 7}
    rng = np.random.default_rng(5)
    paths = {i: rng.normal(0, 0.02, n) for i, n in lengths.items()}
    models = spark.createDataFrame([("m", i, k, float(x)) for i, p in paths.items() for k, x in enumerate(p)], "model string, sim_id long, step long, r double").repartition(3)
    real = series[0].select("rn", "r")
    q = float(np.percentile([r.r for r in real.collect()], 5))
    windows = realism.path_windows(real, models).cache()
    got = {(r.sim_id, r.at): r for r in windows.collect()}
    assert set(got) == {(i, k) for i, n in lengths.items() for k in range(n - 19)}
    for (i, k), r in got.items():
        w = paths[i][k : k + 20]
        cum = np.cumsum(w)
        want = (w.sum(), w.std() * 252**0.5, (cum - np.maximum.accumulate(cum)).min(), w.min(), min(w[j : j + 5].sum() for j in range(16)), (w < 0).sum(), (w <= q).sum(), np.abs(w).std())
        assert [r[c] for c in realism.FEATURES] == pytest.approx(want, abs=1e-12)
    typed = realism.by_rule(fe.crisis_windows(fe.window_features(real.withColumn("series", F.lit(t.SERIES)))))
    assert realism.precision(typed, windows).first().n_windows == realism.crisis_report(typed, windows).first().n_synthetic_windows == 6 + 41 + 1


def test_readers_and_report(spark, tmp_path):
    (tmp_path / "r.csv").write_text("date,x\n2020-01-02,0.1\n2020-01-01,-0.2\n2020-01-03,\n")
    (tmp_path / "p.csv").write_text("a,b\n0.1,0.2\n0.3,-0.4\n")
    assert [(r.rn, r.r) for r in files.returns_csv(spark, str(tmp_path / "r.csv")).orderBy("rn").collect()] == [(1, -0.2), (2, 0.1)]
    p = files.paths_csv(spark, str(tmp_path / "p.csv"))
    whole = p.groupBy("sim_id").agg(F.sort_array(F.collect_list(F.struct("step", "r"))).alias("s")).collect()
    assert sorted([x.r for x in r.s] for r in whole) == [[0.1, 0.2], [0.3, -0.4]] and {x.step for r in whole for x in r.s} == {0, 1}
    page = report("A & B", {"t": spark.createDataFrame([("PASS", 1.5, None)], "verdict string, x double, y string")})
    assert "A &amp; B" in page and "<b style" in page
    files.write_json(spark.createDataFrame([(float("nan"), 1)], "x double, k int"), str(tmp_path / "j"))
    assert spark.read.schema("x double, k int").json(str(tmp_path / "j")).first() == (None, 1)
    assert clean({"a": float("inf"), "b": [1.23456789]}) == {"a": None, "b": [1.234568]}


def test_engine_answers_and_refuses(spark):
    e = Engine(t.returns(spark, SF), t.vix(spark, SF), t.chain(spark, SF))
    assert e.regime()["regime"] in ("calm", "fragile", "crisis") and len(e.expiries()) == 6
    with pytest.raises(ValueError):
        e.paths(horizon=2)
    with pytest.raises(ValueError):
        e.options_disagreement(t_years=9.0)


def test_price_without_time_is_intrinsic(spark):
    d = spark.range(1).select(bs_price(F.lit(90.0), F.lit(100.0), F.lit(0.0), F.lit(0.05), F.lit(0.2)).alias("p"), bs_price(F.lit(90.0), F.lit(100.0), F.lit(0.5), F.lit(0.05), F.lit(0.0), call=True).alias("c")).first()
    assert (d.p, d.c) == (10.0, 0.0)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    groups = {"wide": rng.normal(size=30_000), "ties": rng.integers(0, 7, 5000) / 2, "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "same": np.full(1000, 4.25)}
    d = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("one", None)], "g string, x double").repartition(5)
    probs = (0.0, 0.005, 0.05, 0.25, 0.5, 0.95, 0.999, 1.0)
    got = {r.g: r.q for r in quantiles(d, F.col("x"), probs, ("g",)).collect()}
    for g, v in groups.items():
        assert got[g] == pytest.approx(np.quantile(v, probs), abs=1e-12), g
    whole = quantiles(d.where("g = 'wide'"), F.col("x"), probs).collect()
    assert len(whole) == 1 and whole[0].q == got["wide"]
    assert quantiles(d.where("g = 'none'"), F.col("x"), probs, ("g",)).count() == 0


def test_engine_risk_and_monitor_row(spark):
    from riskspark import Engine as exported

    e = exported(t.returns(spark, SF), t.vix(spark, SF))
    r = e.risk(n_sims=1000)
    assert 0 <= r["lambda_t"] <= 1 and r["stress_metrics"]["es_5pct"] >= r["stress_metrics"]["var_5pct"] and r["evt_fit"]["sigma"] > 0
    row = e.monitor_row("T", "2024-01-01", n_sims=1000).first().asDict()
    assert row["ticker"] == "T" and row["model_var_5pct"] == pytest.approx(r["stress_metrics"]["var_5pct"])


@pytest.fixture(scope="module")
def csvs(spark, tmp_path_factory):
    """Prices of two tickers, a volatility level, a chain without spot or ids, returns, and paths of two models."""
    d = tmp_path_factory.mktemp("csv")
    rng = np.random.default_rng(7)
    n = 700
    days = [str(x) for x in np.datetime64("2020-01-01") + np.arange(n)]
    shocks = rng.standard_t(4, size=(n, 2)) * 0.01
    close = 100 * np.exp(np.cumsum(shocks, axis=0))
    (d / "prices.csv").write_text("date,AA,BB\n" + "".join(f"{x},{a},{b}\n" for x, (a, b) in zip(days, close, strict=True)))
    (d / "vix.csv").write_text("date,level\n" + "".join(f"{x},{15 + 5 * rng.random()}\n" for x in days))
    (d / "real.csv").write_text("date,r\n" + "".join(f"{x},{a}\n" for x, a in zip(days, shocks[:, 0], strict=True)))
    spot = close[-1, 0]
    rows = [(spot * k, t, max(spot * (k - 1), 0) + 2 + k) for t in (0.1, 0.2) for k in (0.9, 0.95, 1.0, 1.05)]
    (d / "chain.csv").write_text("strike,t_years,bid,ask,open_interest,volume,last_price\n" + "".join(f"{k},{t},{m * 0.98},{m * 1.02},500,50,{m}\n" for k, t, m in rows))
    for name, scale in (("near", 1.0), ("far", 3.0)):
        p = rng.standard_t(4, size=(150, 25)) * 0.01 * scale
        (d / f"{name}.csv").write_text(",".join(f"s{i}" for i in range(25)) + "\n" + "".join(",".join(map(str, x)) + "\n" for x in p))
    return d, spot


def test_validation_of_a_csv_writes_all_its_outputs(spark, csvs, tmp_path):
    d, _ = csvs
    validate.main(["--real", str(d / "real.csv"), "--synthetic", str(d / "near.csv"), "--model-name", "near", "--out", str(tmp_path)])
    metrics = json.loads((tmp_path / "metrics.json").read_text())
    assert metrics["health"][0]["confidence"] in ("HIGH", "MEDIUM", "LOW") and metrics["body realism"][0]["model"] == "near"
    table = spark.read.option("header", True).csv(str(tmp_path / "diagnostics" / "csv"))
    assert {r.check for r in table.collect()} == {*CHECKS, "OVERALL"}
    status = {r.check: r.status for r in table.collect()}
    assert status["regime_drift"] == "UNKNOWN" and status["options_disagreement"] == "UNKNOWN"  # neither was given
    assert spark.read.option("header", True).csv(str(tmp_path / "VaR_and_ES" / "csv")).count() == 6
    assert spark.read.parquet(str(tmp_path / "archetypes" / "parquet")).count() == metrics["crisis coverage"][0]["n_archetypes_tested"] == 5
    assert metrics["crisis coverage"][0]["n_synthetic_windows"] == 150 * 6
    assert "near" in (tmp_path / "report.html").read_text()
    with pytest.raises(SystemExit):
        validate.main(["--real", str(d / "real.csv")])


def test_benchmark_ranks_models(spark, csvs, tmp_path):
    d, _ = csvs
    benchmark.main(["--real", str(d / "real.csv"), "--model", f"near={d / 'near.csv'}", "--model", f"far={d / 'far.csv'}", "--brier", "near=0.05", "--out", str(tmp_path)])
    board = {r["model"]: r for r in json.loads((tmp_path / "leaderboard.json").read_text())}
    assert board["near"]["rank"] == 1 and board["far"]["rank"] == 2 and board["near"]["brier"] == 0.05 and board["far"]["brier"] is None
    assert "HIGH from 70" in (tmp_path / "leaderboard.html").read_text()


def test_monitor_appends_a_row_a_run_and_shows_its_tail(spark, csvs, tmp_path, capsys):
    d, spot = csvs
    log = str(tmp_path / "log")
    monitor.main(["--ticker", "AA", "--prices", str(d / "prices.csv"), "--vix", str(d / "vix.csv"), "--chain", str(d / "chain.csv"), "--n-sims", "1000", "--log", log])
    append(spark.createDataFrame([("AA", "9999", 0.5)], "ticker string, run_timestamp string, lambda_t double"), log)  # a run without options
    monitor.main(["--summary", "--log", log])
    rows = spark.read.option("mergeSchema", "true").parquet(log).orderBy("run_timestamp").collect()
    assert len(rows) == 2 and rows[0]["options_n_options"] == 4 and rows[0]["options_atm_implied_vol"] > 0 and rows[1]["options_n_options"] is None
    assert "lambda_t" in capsys.readouterr().out
    e = Engine.of_csv(spark, "AA", str(d / "prices.csv"), str(d / "vix.csv"), str(d / "chain.csv"))
    assert e.chain.select("spot").distinct().first().spot == pytest.approx(spot) and e.expiries() == [0.1, 0.2]
    with pytest.raises(ValueError):
        Engine.of_csv(spark, "ZZ", str(d / "prices.csv"), str(d / "vix.csv"))


def test_a_chain_of_two_underlyings_is_refused(spark):
    each = spark.createDataFrame([(1, -0.1), (2, 0.1)], "sim_id long, cum double")
    chain = spark.createDataFrame([(1, 100.0, 90.0), (2, 50.0, 45.0)], "contract_id long, spot double, strike double")
    with pytest.raises(Exception, match="one underlying"):
        options.physical(chain, each).collect()


def test_one_series_becomes_a_panel_and_several_are_refused(spark):
    d = spark.createDataFrame([("2020-01-01", 1.0, 2.0)], "dt string, x double, y double")
    assert files.panel_of(d.drop("y"), "dt", "T").collect() == [("2020-01-01", "T", 1.0)]
    assert {(r.ticker, r.close) for r in files.panel_of(d).collect()} == {("x", 1.0), ("y", 2.0)}
    with pytest.raises(ValueError):
        files.panel_of(d, "dt", "T")


def test_the_gate_walks_forward_over_its_dates_only(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=260)
    feats = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "rn long, vol_5d double")
    labels = spark.createDataFrame([(i, int(v > 0.3)) for i, v in enumerate(x)], "rn long, stress_20d int")
    rows = gate.walk_forward(feats, labels, least=100, every=60, tail=63, trees=60).orderBy("rn").collect()
    assert [r.rn for r in rows] == [100, 160] and all(r.top_driver_1 == "vol_5d" for r in rows)
    assert [r.realised for r in rows] == [int(x[100] > 0.3), int(x[160] > 0.3)]
    assert all((r.p_ensemble_mean > 0.5) == bool(r.realised) for r in rows)
    assert gate.walk_forward(feats, labels, least=250, trees=2).count() == 0


def test_flags_of_labels_blocks_and_backtests(spark, series):
    ret, f = series
    now, later = fe.stress_labels(ret, (5,)).cache(), fe.stress_labels(ret, (5,), start_offset=1)
    j = later.join(now.select((F.col("rn") - 1).alias("rn"), F.col("dd_5pct_5d").alias("next"), F.col("rn").alias("at")), "rn")
    assert j.where("rn < 1000 and dd_5pct_5d <> next").count() == 0 and now.where("dd_5pct_5d = 1").count() > 0
    lagged = sc.block_library(f, feature_lag=3).select((F.col("block_id") - 3).alias("rn"), F.col("vol_20d").alias("v"), "block_return")
    k = lagged.join(f.select("rn", "vol_20d"), "rn")
    assert k.count() == lagged.count() > 0 and k.where("v <> vol_20d").count() == 0
    legacy = validation.var_backtest(ret.select("rn", "r"), ret.select(F.lit("m").alias("model"), "r"), legacy_cc=True).collect()
    assert all(r.conditional_cov_verdict == "PASS" and r.conditional_cov_pval == pytest.approx(np.exp(-(r.kupiec_pval + r.independence_pval) / 2)) for r in legacy)


def test_stability_without_usable_data_is_unknown(spark):
    layer = spark.createDataFrame([("m", "PASS", "PASS", "PASS", 1.0, 1.0, 0.8, False, 0, False, 0, 0, 0.1, "LOW", 0.01)], "model string, kupiec_verdict string, conditional_cov_verdict string, es_verdict string, obs_exp_ratio double, tail_mass_ratio double, coverage_at_eps double, precision_trap boolean, n_archetypes_fail int, sensitive boolean, modes_pass int, modes int, drift double, drift_status string, mean_gap double")
    assert {r.check: r.status for r in health.checks(layer).collect()} == {"calibration": "PASS", "tail_mass": "PASS", "crisis_coverage": "PASS", "pathwise_stability": "UNKNOWN", "regime_drift": "LOW", "options_disagreement": "NARROW"}


def test_charts_of_the_engine(spark):
    e = Engine(t.returns(spark, SF), t.vix(spark, SF), t.chain(spark, SF))
    c = e.charts(n_sims=1000)
    returns = c["returns"].orderBy("bin").collect()
    assert sum(r.n for r in returns) == 1000 and all(a.bin_to == pytest.approx(a.bin_from + (returns[0].bin_to - returns[0].bin_from)) for a in returns)
    strikes = [(r.strike, r.contract_id) for r in c["probability_by_strike"].collect()]
    assert strikes == sorted(strikes) and strikes and c["lambda_history"].count() == 51
    e.release()
    assert e.regime()["regime"] in ("calm", "fragile", "crisis")
