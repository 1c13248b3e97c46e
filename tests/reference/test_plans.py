"""What the plans are made of: draws, quantiles by rounds, running sums, stretches, trees, learners, stores and the log's sink."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark import store
from riskspark.functions import counter, lattice, quantiles, running, stretches
from riskspark.operators import gate, learners, nearest, options
from riskspark.operators import features as fe
from riskspark.operators import scenarios
from riskspark.plans import REGISTRY
from riskspark.plans.inputs import Inputs
from riskspark.sources import tables
from riskspark.streaming import monitor

SF = "/root/testdata/sf0.001"


# draws


def test_the_generator_gives_its_published_answers(spark):
    cases = [((0, 0), (0, 0), (0x6B200159, 0x99BA4EFE)), ((0xFFFFFFFF,) * 2, (0xFFFFFFFF,) * 2, (0x1CB996FC, 0xBB002BE7)), ((0x13198A2E, 0x03707344), (0x243F6A88, 0x85A308D3), (0xC4923A9C, 0x483DF7A0))]
    long = lambda v: F.lit(v).cast("long")
    for key, count, want in cases:
        assert tuple(spark.range(1).select(counter.threefry(*map(long, key), *map(long, count)).alias("w")).first().w) == want


def test_draws_are_uniform_and_independent(spark):
    d = spark.range(4000).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step"))
    rows = d.withColumn("u", counter.uniform(counter.TAILS, F.col("sim"), F.col("step"))).collect()
    u = np.zeros((4000, 5))
    for r in rows:
        u[r.sim, r.step] = r.u
    n = u.size
    assert u.min() >= 0 and u.max() < 1
    seen = np.histogram(u, bins=20, range=(0, 1))[0]
    assert ((seen - n / 20) ** 2 / (n / 20)).sum() < 50  # chi-square of 19 degrees: 50 is beyond 0.0002
    near = lambda a, b: abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) * math.sqrt(a.size)
    assert near(u[:, :-1], u[:, 1:]) < 4 and near(u[:-1], u[1:]) < 4 and near(u[:, 0], u[:, 4]) < 4
    gaps = (u[:, 1:] - u[:, :-1]) % 1
    assert np.histogram(gaps, bins=10, range=(0, 1))[0].min() > 0.8 * gaps.size / 10  # steps of a simulation follow no lattice
    other = spark.range(100).select(counter.uniform(counter.BLOCKS, F.col("id"), F.lit(0)).alias("u")).collect()
    assert all(abs(a.u - b) > 0 for a, b in zip(other, u[:100, 0], strict=True))


def test_draws_by_batches_are_those_of_the_column(spark):
    rows = [(s, k) for s in (0, 1, -1, 7, 2**31, 2**32 + 5, -(2**40), 2**62, 6_000_000_019) for k in (0, 1, 19, 2**32 - 1)]
    d = spark.createDataFrame(rows, "sim long, step long")
    for stream in (counter.BLOCKS, counter.TAILS):
        got = d.select(counter.uniforms(stream, F.col("sim"), F.col("step")).alias("a"), counter.uniform(stream, F.col("sim"), F.col("step")).alias("b")).collect()
        assert all(r.a == r.b for r in got)


@pytest.mark.parametrize("least", [0.001, 0.2])
def test_corrected_draws_equal_corrected_steps(spark, least):
    """Whole blocks, counted: the same returns as step by step, though simulations of a block without a tail step are one row."""
    rng = np.random.default_rng(6)
    rets = [(b, [float(x) for x in rng.normal(0, 0.01, 20)]) for b in range(1, 40)] + [(40, [-0.05 * least] * 20)]
    blocks = spark.createDataFrame(rets, "block_id long, rets array<double>")
    drawn = spark.range(1, 2001).select(F.col("id").alias("sim_id"), (1 + F.col("id") * F.col("id") % 40).alias("block_id"))
    fit = spark.createDataFrame([(0.016, 120, 0.1, 0.005)], "threshold double, n long, xi double, sigma double")
    steps = drawn.join(blocks, "block_id").select("sim_id", F.posexplode("rets").alias("step", "r"))
    want = {r.sim_id: r.cum for r in scenarios.per_path(scenarios.evt_correct(steps, fit)).collect()}
    got = scenarios.per_array(scenarios.evt_correct_drawn(drawn, blocks, fit)).collect()
    assert sum(r.n for r in got) == len(want) == 2000 and len(got) < 2000
    assert all(r.cum == want[r.sim_id] for r in got)
    assert sorted(c for r in got for c in [r.cum] * r.n) == sorted(want.values())


def test_scenario_options_keeps_no_steps(spark, monkeypatch):
    """Rows of what it writes: at most one a simulation, none a step."""
    made, table = {}, store.Store.table

    def kept(self, name, make):
        made[name] = table(self, name, make)
        return made[name]

    monkeypatch.setattr(store.Store, "table", kept)
    REGISTRY["scenario_options"](spark, SF)
    sims = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert "boot" not in made and made["drawn"].count() == sims
    assert made["each"].count() < sims == made["each"].agg(F.sum("n")).first()[0]
    store.release_all(spark)


def test_a_price_of_the_chain_is_worked_out_once(spark):
    plan = options.liquid(options.quoted(tables.chain(spark, SF)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EXP(") == 2  # the price's own two


# quantiles and running sums


def test_ordered_bits_keep_the_order_of_doubles(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 2.0, math.nextafter(2.0, 0), math.nextafter(2.0, 3)]
    values += [rng.gauss(0, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(500)] + [math.ldexp(1.0, k) for k in range(-1070, 1024, 37)] + [math.nextafter(math.ldexp(1.0, k), 0) for k in range(-1000, 1024, 41)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.ordered_bits(F.col("v")).alias("k")).collect()
    rows.sort(key=lambda r: (r.v, r.k))
    for a, b in zip(rows, rows[1:], strict=False):
        assert (a.k < b.k) == (a.v < b.v) and (a.k == b.k) == (a.v == b.v), (a, b)


def test_quantiles_by_rounds_equal_sorted_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 10)
    rng = np.random.default_rng(6)
    groups = {"wide": rng.standard_cauchy(size=3000), "ties": rng.integers(0, 17, 3000) / 3, "far": np.array([-1e300, -1.0, 0.0, 1e-300, 1e300] * 7), "two": np.array([1.0, 2.0])}
    d = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("two", None), ("two", float("nan"))], "g string, x double").repartition(5)
    probs = (0.0, 0.005, 0.05, 0.25, 0.5, 0.95, 0.999, 1.0)
    got = {r.g: r.q for r in quantiles.quantiles(d, F.col("x"), probs, ("g",)).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g] == pytest.approx(np.quantile(v, probs), rel=1e-12, abs=1e-12), g
    weighted = quantiles.quantiles(spark.createDataFrame([(float(v), v % 5) for v in range(40)], "x double, n long"), F.col("x"), probs, (), F.col("n")).first().q
    assert weighted == pytest.approx(np.quantile([v for v in range(40) for _ in range(v % 5)], probs))


def test_quantiles_of_ten_million_values_gather_nothing(spark):
    n = 10_000_000
    d = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    q = quantiles.quantiles(d, F.col("x"), (0.01, 0.5, 0.999))
    assert q.first().q == pytest.approx([0.01 * (n - 1), 0.5 * (n - 1), 0.999 * (n - 1)], abs=1e-6)
    assert "collect" not in q._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", [7, 1000])
def test_running_sums_over_ranges(spark, size):
    rng = np.random.default_rng(3)
    rows = [(g, float(v), int(rng.integers(0, 5)), float(v) / 7) for g, n in (("a", 90), ("b", 1), ("c", 30)) for v in rng.permutation(1000)[:n]]
    d = spark.createDataFrame(rows, "g string, v double, n long, k double").repartition(3)
    got = {(r.g, r.v): (r.upto_n, r.upto_k, r.next) for r in running.running(d, "v", ("n", "k"), ("g",), per_range=size).collect()}
    for g, v, *_ in rows:
        upto = [r for r in rows if r[0] == g and r[1] <= v]
        assert got[g, v][:2] == pytest.approx((sum(r[2] for r in upto), sum(r[3] for r in upto)))
        assert got[g, v][2] == min((r[1] for r in rows if r[0] == g and r[1] > v), default=None)


def test_many_strikes_meet_no_path(spark):
    strikes, n = 100_000, 5000
    chain = spark.range(strikes).select(F.col("id").alias("contract_id"), F.lit(100.0).alias("spot"), (50 + F.col("id") / 1000).alias("strike"))
    rng = np.random.default_rng(2)
    cum = rng.normal(0, 0.2, n)
    each = spark.createDataFrame([(i, float(c)) for i, c in enumerate(cum)], "sim_id long, cum double")
    d = options.physical(chain, each)
    got = {r.contract_id: r for r in d.collect()}
    price = 100 * np.exp(cum)
    assert len(got) == strikes
    for k in range(0, strikes, 9973):
        s = 50 + k / 1000
        assert got[k].physical_prob_itm == pytest.approx((price < s).mean()) and got[k].physical_expected_payoff == pytest.approx(np.maximum(s - price, 0).mean())
    assert "NestedLoop" not in re.sub(r"BroadcastNestedLoopJoin BuildRight, (Inner|Cross)\b", "", d._jdf.queryExecution().executedPlan().toString())


# stretches


def brute_drawdown(a):
    c = np.cumsum(a)
    return float((c - np.maximum.accumulate(c)).min())


def test_drawdowns_by_doubling(spark):
    rng = np.random.default_rng(4)
    a = {g: rng.normal(size=n) for g, n in (("s", 150), ("t", 9))}
    d = spark.createDataFrame([(g, i + 1, float(v)) for g, v in a.items() for i, v in enumerate(v)] + [("u", 1, None), ("u", 2, 1.0)], "series string, rn long, r double")
    windows = {"one": (0, 0), "back": (-6, 0), "next": (1, 20), "around": (-3, 2), "year": (-99, 0)}
    for r in stretches.sliding_drawdown(d, "r", windows).collect():
        for name, (first, last) in windows.items():
            s = a.get(r.series, [])
            at, to = r.rn - 1 + first, r.rn - 1 + last
            want = brute_drawdown(s[at : to + 1]) if at >= 0 and to < len(s) else None
            if r.series == "u":
                want = 0.0 if name == "one" and r.rn == 2 else None
            assert r[name] == (None if want is None else pytest.approx(want, abs=1e-12)), (r.series, r.rn, name)


def test_blocks_give_what_one_window_gives(spark):
    n = 1_000_000
    d = spark.range(1, n + 1).select(F.lit("S").alias("series"), F.col("id").alias("rn"), F.sin(F.col("id") * 0.37).alias("r"))
    f = lambda x: fe.market_features(x).select("series", "rn", "vol_20d", "drawdown_60d", *[c for c in x.columns if c.startswith("_")])
    blocks = stretches.in_blocks(d, f, before=60, size=20_000)
    whole = f(d).withColumnsRenamed({"vol_20d": "v", "drawdown_60d": "w"})
    j = blocks.join(whole, ["series", "rn"])
    bad = F.abs(F.col("vol_20d") - F.col("v")) + F.abs(F.col("drawdown_60d") - F.col("w"))
    one = j.agg(F.count("*").alias("n"), F.max(bad).alias("bad"), F.sum((F.col("v").isNull() != F.col("vol_20d").isNull()).cast("int")).alias("nulls")).first()
    assert (one.n, one.nulls) == (n, 0) and one.bad < 1e-9
    with pytest.raises(ValueError):
        stretches.in_blocks(d, f, before=60, size=50)


@pytest.mark.parametrize("size", [5, 10_000])
def test_asof_takes_the_last_row_before(spark, size):
    rng = random.Random(5)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    right = [("hot", day(rng.randrange(200)), float(i)) for i in range(60)] + [("cold", day(50), 1.0), (None, day(1), 9.0), ("hot", None, 9.0)]
    left = [(i, rng.choice(("hot", "hot", "hot", "cold", "none", None)), day(rng.randrange(-5, 260))) for i in range(300)] + [(900, "hot", None), (5, "cold", day(50)), (5, "cold", day(50))]
    got = stretches.asof(spark.createDataFrame(left, "id long, k string, t date"), spark.createDataFrame(right, "k string, t date, close double"), "k", "t", ["close"], tolerance=30, per_block=size).collect()
    assert len(got) == len(left)

    def want(k, t):
        old = [(s, v) for q, s, v in right if q == k and k is not None and t is not None and s is not None and s <= t]
        return max(old)[1] if old and (t - max(old)[0]).days <= 30 else None

    assert sorted(((r.id, r.k, r.t, r.close) for r in got), key=str) == sorted(((i, k, t, want(k, t)) for i, k, t in left), key=str)


def test_asof_carries_times_not_rows(spark, monkeypatch):
    """Rows of left that share key and time are one row of what is sorted, and are themselves not shuffled."""
    sizes, carried = [], stretches.carried
    monkeypatch.setattr(stretches, "carried", lambda df, *a, **b: sizes.append(df.count()) or carried(df, *a, **b))
    left = spark.range(20_000).select("id", F.lit("k").alias("k"), (F.col("id") % 4 * 10).alias("t"))
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 20, 2.0)], "k string, t long, close double")
    got = stretches.asof(left, right, "k", "t", ["close"], tolerance=9)
    assert [tuple(r) for r in got.groupBy("t", "close").count().orderBy("t").collect()] == [(0, None, 5000), (10, 1.0, 5000), (20, 2.0, 5000), (30, None, 5000)]
    assert sizes == [5]  # times 0, 5, 10, 20, 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan and "Sort" not in plan


def test_a_row_finds_its_block_by_halving(spark):
    d = spark.range(300).select(F.lit("k").alias("k"), "id", F.when(F.col("id") % 50 == 7, F.col("id")).alias("v"))
    out = stretches.carried(d, ["v"], "k", "id", per_block=4)
    assert "filter(_cuts" not in out._jdf.queryExecution().optimizedPlan().toString()  # all cuts, for each row
    assert [r.v for r in out.orderBy("id").collect()] == [None if i < 7 else (i - 7) // 50 * 50 + 7 for i in range(300)]


def test_prefix_ranks_count_the_history(spark):
    rng = random.Random(7)
    rows = [(s, i, float(rng.randrange(12)), rng.random()) for s, n in (("a", 70), ("b", 1), ("c", 33)) for i in range(3, n + 3)]
    d = spark.createDataFrame(rows, "series string, rn long, x double, y double")
    out = stretches.prefix_ranks(d, ["x", "y"], F.col("rn") % 2 == 1)
    got = {(r.series, r.rn): r for r in out.collect()}
    assert set(got) == {(s, i) for s, i, *_ in rows if i % 2}
    for s, i, *v in rows:
        if i % 2:
            past = [r for r in rows if r[0] == s and r[1] <= i]
            r = got[s, i]
            assert (r.n, r.lt_x, r.le_x, r.lt_y, r.le_y) == (len(past), *[sum(f(q[2 + c], v[c]) for q in past) for c in (0, 1) for f in (lambda a, b: a < b, lambda a, b: a <= b)])
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_exact_distances_of_small_samples(spark):
    rng = random.Random(8)
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (1, 6)):
        x, y = [rng.random() for _ in range(n)], [rng.random() for _ in range(m)]
        d = spark.createDataFrame([(x, y)], "x array<double>, y array<double>").withColumn("far", lattice.distance(F.col("x"), F.col("y")))
        far = d.first().far
        one = lambda a, b: max(abs(sum(v <= t for v in a) * m - sum(v <= t for v in b) * n) for t in a + b)  # noqa: E731, B023
        assert far == one(x, y)
        whole = x + y
        splits = [(list(c), [v for v in whole if v not in c]) for c in itertools.combinations(whole, n)]
        for f in {far, 1, n * m}:
            p = spark.range(1).select(lattice.exact_tail(F.lit(f), F.lit(n), F.lit(m)).alias("p")).first().p
            assert p == pytest.approx(sum(one(a, b) >= f for a, b in splits) / len(splits), abs=1e-12)
    assert spark.range(1).select(lattice.exact_tail(F.lit(5), F.lit(200), F.lit(200)).alias("p")).first().p is None
    assert all(0 <= r.ks_pval <= 1 for r in REGISTRY["ks_monthly"](spark, SF).collect())


# trees and learners


def test_the_ball_tree_finds_what_all_pairs_give(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 3)) * 4
    few = np.vstack([c + 0.3 * rng.normal(size=(15, 3)) for c in centres] + [centres[:1]] * 9)
    many = np.vstack([centres[k % 12] + (0.5 if k % 3 else 3.0) * rng.normal(size=3) for k in range(4000)])
    s = nearest.Search(nearest.Tree(few), 0.8)
    within = np.concatenate([s.add(many[at : at + 500]) for at in range(0, 4000, 500)])
    d = np.sqrt(((many[:, None] - few[None]) ** 2).sum(axis=2))
    assert (within == (d.min(axis=1) <= 0.8)).all()
    assert np.sqrt(s.best) == pytest.approx(d.min(axis=0)[s.tree.order])
    assert s.computed < 0.3 * d.size
    empty = nearest.Search(nearest.Tree(np.zeros((0, 3))), 1.0)
    assert not empty.add(many[:5]).any() and not nearest.Search(nearest.Tree(few), 1.0).add(many[:0]).any()


def test_crisis_plans_have_no_product(spark):
    i = Inputs(spark, SF)
    for name in ("crisis_report", "precision_at_eps"):
        plan = REGISTRY[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and plan.count("orders.parquet") == 0
    assert i.windows.agg(F.sum("n")).first()[0] == 4 * i.sims.count()
    i.store.release()
    with pytest.raises(Exception):
        i.windows.collect()


def test_a_store_keeps_tables_until_it_is_released(spark):
    made = []
    make = lambda: made.append(1) or spark.range(5)
    with store.Store(spark) as s:
        assert s.table("t", make).count() == s.table("t", make).count() == 5 and len(made) == 1
        folder = s.folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    left = store.written(spark.range(3))
    assert left.count() == 3 and store.release_all(spark) >= 1 and store.release_all(spark) == 0


def plain_boosted(x, y, z, trees, depth, rate, bins):
    """Trees grown row by row: the same cuts, gains and leaves in plain loops."""
    edges = [sorted(set(np.quantile(x[:, c], np.arange(1, bins) / bins))) for c in range(x.shape[1])]
    place = lambda v, c: sum(e < v for e in edges[c])
    b = [[place(v, c) for c, v in enumerate(row)] for row in x]
    bz = [[place(v, c) for c, v in enumerate(row)] for row in z]
    start = math.log(y.mean() / (1 - y.mean()))
    f, fz = [start] * len(y), [start] * len(z)
    for _ in range(trees):
        g = [t - 1 / (1 + math.exp(-s)) for t, s in zip(y, f, strict=True)]
        h = [(1 / (1 + math.exp(-s))) * (1 - 1 / (1 + math.exp(-s))) for s in f]

        def grow(rows, asked, level):
            if level == depth:
                v = rate * sum(g[i] for i in rows) / max(sum(h[i] for i in rows), 1e-12) if rows else 0.0
                for i in rows:
                    f[i] += v  # noqa: B023
                for i in asked:
                    fz[i] += v  # noqa: B023
                return
            best, cut = 1e-12, None
            for c in range(x.shape[1]):
                for k in range(bins):
                    left = [i for i in rows if b[i][c] <= k]
                    if 0 < len(left) < len(rows):
                        a, all_ = sum(g[i] for i in left), sum(g[i] for i in rows)
                        gain = round(a * a / len(left) + (all_ - a) ** 2 / (len(rows) - len(left)) - all_ * all_ / len(rows), 12)
                        if gain > best:
                            best, cut = gain, (c, k)
            c, k = cut or (0, bins)
            grow([i for i in rows if b[i][c] <= k], [i for i in asked if bz[i][c] <= k], level + 1)
            grow([i for i in rows if b[i][c] > k], [i for i in asked if bz[i][c] > k], level + 1)

        grow(list(range(len(y))), list(range(len(z))), 0)
    return fz


def test_boosted_trees_equal_plain_loops():
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(80, 3)), 2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0.5)).astype(float)
    z = rng.normal(size=(20, 3))
    got = learners.Boosted(4, 3, 0.3, 8).fit(x, y).logits(z)
    assert got == pytest.approx(plain_boosted(x, y, z, 4, 3, 0.3, 8), abs=1e-9)


def test_logistic_and_isotonic():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(300, 4))
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    w, k = learners.l1_logistic(x, y, 0.1, 5000)
    loss = lambda w, k: np.abs(w).sum() + 0.1 * np.logaddexp(0, -(2 * y - 1) * (x @ w + k)).sum()
    for _ in range(200):
        assert loss(w, k) <= loss(w + rng.normal(size=4) * 0.02, k + rng.normal() * 0.02) + 1e-9
    assert abs(w[0]) > 5 * np.abs(w[1:]).max()
    s, t = np.array([1.0, 2.0, 3.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0])
    assert np.interp([0.0, 1.0, 2.5, 4.0], *learners.isotonic(s, t)) == pytest.approx([0, 0, 2 / 3, 1])


def test_the_gate_does_not_see_labels_from_the_future(spark):
    """The labels of the last rows before a date give the outcome away; only legacy_labels reads them."""
    n, at = 700, 600
    rng = np.random.default_rng(14)
    x = rng.normal(size=n)
    leak = [int(at - 20 < i <= at) or int(rng.random() < 0.1 and i <= at - 20) for i in range(n)]
    feats = spark.createDataFrame([(i, float(v), float(at - 20 < i <= at)) for i, v in enumerate(x)], "rn long, vol_5d double, ret_5d double")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(leak)], "rn long, stress_20d int")
    dates = spark.createDataFrame([(at,)], "rn long")
    fair = gate.forecasts(feats, labels, dates, trees=30).first()
    seen = gate.forecasts(feats, labels, dates, trees=30, legacy_labels=True).first()
    assert fair.p_gradient_boosting < 0.4 < 0.5 < seen.p_gradient_boosting and gate.horizon_of("dd_8pct_60d") == 60
    assert gate.predict_current(feats.where("rn < 400"), labels).count() == 0
    assert gate.forecasts(feats, labels.withColumn("stress_20d", F.lit(0)), dates).count() == 0


# the log


def test_a_retried_batch_is_there_once(spark, tmp_path):
    inbox, path, at = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "c")
    spark.createDataFrame([("A", "1", 0.5), ("B", "1", 0.7)], "ticker string, run_timestamp string, x double").write.parquet(inbox)
    rows = lambda: spark.readStream.schema("ticker string, run_timestamp string, x double").parquet(inbox)

    def fails(batch, i):
        monitor.append(batch, path, f"stream-{i}")
        raise RuntimeError("after the write")

    with pytest.raises(Exception, match="after the write"):
        rows().writeStream.foreachBatch(fails).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    monitor.stream(rows(), path, at).awaitTermination()
    monitor.stream(rows(), path, at).awaitTermination()
    assert sorted(map(tuple, monitor.log(spark, path).select("ticker", "run_timestamp", "x").collect())) == [("A", "1", 0.5), ("B", "1", 0.7)]


def test_runs_that_are_sent_again_are_dropped(spark, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "ticker string, run_timestamp string, at timestamp"
    when = lambda m: dt.datetime(2024, 1, 1, 0, m)
    for rows in ([("A", "1", when(0)), ("A", "1", when(1))], [("A", "1", when(2)), ("A", "2", when(3))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        d = monitor.distinct_runs(spark.readStream.schema(schema).parquet(inbox), "at", "1 hour")
        monitor.stream(d, path, str(tmp_path / "c")).awaitTermination()
    assert sorted((r.ticker, r.run_timestamp) for r in monitor.log(spark, path).collect()) == [("A", "1"), ("A", "2")]
