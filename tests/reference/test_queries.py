"""Every query against its SQL in DuckDB on the smallest tables, and properties of the closed forms."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from riskspark import store
from riskspark.functions.columns import bs_put, chi2_tail, drawdown, implied_vol, normal_cdf
from riskspark.operators import options
from riskspark.plans import ORACLE, REGISTRY
from riskspark.streaming import monitor

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(x, y) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)
    return x == y


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = REGISTRY[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda row: tuple((v is None, round(v, 3) if isinstance(v, float) else v) if v is not None else (True, 0) for v in row)
    order = sorted(names)
    a = sorted((tuple(r[c] for c in order) for r in got.collect()), key=lambda r: str(key(r)))
    b = sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=lambda r: str(key(r)))
    assert len(a) == len(b)
    store.release_all(spark)
    for x, y in zip(a, b, strict=True):
        assert all(same(u, float(v) if isinstance(u, float) and v is not None else v) for u, v in zip(x, y, strict=True)), (x, y)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_normal_and_chi_square(spark):
    for x in (-9.0, -3.3, -0.5, 0.0, 0.7, 2.0, 7.5):
        assert one(spark, normal_cdf(F.lit(x))) == pytest.approx(math.erfc(-x / math.sqrt(2)) / 2, abs=1e-14)
    assert one(spark, chi2_tail(F.lit(3.841458820694124), 1)) == pytest.approx(0.05, abs=1e-9)
    assert one(spark, chi2_tail(F.lit(2.0), 2)) == pytest.approx(math.exp(-1))


def test_implied_vol_inverts_the_price(spark):
    s, k, t, r = (F.lit(x) for x in (100.0, 95.0, 0.25, 0.045))
    price = one(spark, bs_put(s, k, t, r, F.lit(0.37)))
    assert one(spark, implied_vol(F.lit(price), s, k, t, r)) == pytest.approx(0.37, abs=1e-9)
    assert one(spark, implied_vol(F.lit(0.0), s, k, t, r)) is None


def test_all_solved_puts_reprice(spark):
    """Every liquid contract that has a root is there, thin time value or not, and its price from the volatility is its mid."""
    d = REGISTRY["solved_puts"](spark, "/root/testdata/sf0.01").cache()
    rows = d.collect()
    assert {r.contract_id for r in rows} == {r.contract_id for r in REGISTRY["put_liquidity_filter"](spark, "/root/testdata/sf0.01").collect()}
    thin = [r for r in rows if r.mid - max(r.strike * math.exp(-0.045 * r.t_years) - r.spot, 0) <= 0.001]
    assert thin
    cdf = lambda x: math.erfc(-x / math.sqrt(2)) / 2
    for r in rows:
        s = r.implied_vol * math.sqrt(r.t_years)
        d1 = math.log(r.spot / r.strike) / s + 0.045 * r.t_years / s + s / 2
        price = r.strike * math.exp(-0.045 * r.t_years) * cdf(s - d1) - r.spot * cdf(-d1)
        assert price == pytest.approx(r.mid, abs=1e-7) and r.bs_price_from_iv == pytest.approx(r.mid, abs=1e-7)
        assert r.risk_neutral_prob_itm == pytest.approx(cdf(s - d1), abs=1e-9) and r.delta == pytest.approx(-cdf(-d1), abs=1e-9)


def test_scores_rank_counts_of_values_not_rows(spark):
    chain = spark.range(5000).selectExpr("id as contract_id", "100D as strike", "100D as moneyness", "0.1D as bid_ask_pct", "1D as mid", "id % 7 as open_interest", "if(id % 5 = 0, null, id % 3) as volume", "0.5D as physical_prob_itm", "1D as physical_expected_payoff", "0.4D as risk_neutral_prob_itm")
    d = options.scored(chain)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan and d.columns[:10] == chain.columns
    rows = d.collect()
    share = lambda c, x: (2 * sum((r[c] or 0) < x for r in rows) + sum((r[c] or 0) == x for r in rows) + 1) / 2 / 5000
    want = {(a, b): (0.6 * share("open_interest", a) + 0.4 * share("volume", b)) / 2 for a in range(7) for b in range(3)}
    assert len(rows) == 5000 and all(r.liquidity_score == pytest.approx(want[r.open_interest, r.volume or 0]) for r in rows)


def test_drawdown_starts_at_the_first_step(spark):
    dd = lambda *a: one(spark, drawdown(F.array(*[F.lit(float(x)) for x in a])))
    assert dd(-1, -1) == -1 and dd(-5) == 0 and dd(1, 2, 3) == 0 and dd(1, -3, 1, -2) == -4


def test_monitor_log_grows_by_batches(spark, tmp_path):
    path, inbox = str(tmp_path / "log"), str(tmp_path / "in")
    monitor.append(spark.createDataFrame([("A", 1, 0.5)], "ticker string, run_timestamp long, x double"), path)
    spark.createDataFrame([("A", 2, "z"), ("B", 3, "z")], "ticker string, run_timestamp long, note string").write.parquet(inbox)
    monitor.stream(spark.readStream.schema("ticker string, run_timestamp long, note string").parquet(inbox), path, str(tmp_path / "c")).awaitTermination()
    rows = monitor.log(spark, path)
    assert set(rows.columns) == {"ticker", "run_timestamp", "x", "note"} and rows.count() == 3
    assert {(r.ticker, r.run_timestamp) for r in monitor.tail(rows, 1).collect()} == {("A", 2), ("B", 3)}
