"""DuckDB SQL of the queries in validation.py, written apart from the DataFrame plans."""

from __future__ import annotations

import re

from ..operators.gate import COLUMNS
from ..operators.realism import ARCHETYPES, FEATURES
from ..operators.validation import QUANTILES
from ..sources.tables import TICKERS
from . import oracle as o
from .oracle import CHAIN, EVT, FORECAST, MODEL, PANEL, PATHS, PHYSICAL, RET, SCORED, VIX, WINDOW, cols, each, ll, phi, r

COMPLETE = o.FEATURES + ", cf AS (SELECT *, row_number() OVER (ORDER BY rn DESC) AS back FROM feat WHERE ret_60d IS NOT NULL AND vix_z_252d IS NOT NULL AND vix_change_20d IS NOT NULL)"
_L = ("vol_20d", "vix_level", "drawdown_20d", "ret_20d")
LAMBDA = f"""{COMPLETE}, hr AS (SELECT rn, {", ".join(f"round({c}, 10) AS {c}" for c in _L)}, back FROM cf),
ev AS (SELECT * FROM hr WHERE back <= 252 AND ((SELECT max(back) FROM hr WHERE back <= 252) - back) % 5 = 0),
lc AS (SELECT e.rn, count(*) AS n, {", ".join(f"count(*) FILTER (h.{c} < e.{c}) AS lt_{c}, count(*) FILTER (h.{c} <= e.{c}) AS le_{c}" for c in _L)} FROM ev e JOIN hr h ON h.rn <= e.rn GROUP BY e.rn HAVING count(*) >= 50),
lp AS (SELECT rn, {", ".join(f"{'1 - ' if c in _L[2:] else ''}(lt_{c} + le_{c} + 1)/(2*n) AS {name}" for c, name in zip(_L, ("vol_pct", "vix_pct", "dd_stress", "ret_stress")))} FROM lc),
ls AS (SELECT *, 0.35*vol_pct + 0.30*vix_pct + 0.20*dd_stress + 0.15*ret_stress AS raw_score FROM lp), lam AS (SELECT *, 1/(1 + exp(-8*(raw_score - 0.6))) AS lambda_t FROM ls)"""
_ACF = f"""{MODEL}, lg AS (SELECT model, r, {", ".join(f"lag(r, {k}) OVER w AS l{k}" for k in range(1, 6))} FROM models WINDOW w AS (PARTITION BY model, sim_id ORDER BY step)),
ma AS (SELECT model, {", ".join(f"corr(l{k}, r) AS m1_{k}, corr(l{k}*l{k}, r*r) AS m2_{k}" for k in range(1, 6))} FROM lg GROUP BY 1),
ra AS (SELECT {", ".join(f"(SELECT corr(a.r, b.r) FROM ret a JOIN ret b ON b.rn = a.rn + {k}) AS r1_{k}, (SELECT corr(a.r*a.r, b.r*b.r) FROM ret a JOIN ret b ON b.rn = a.rn + {k}) AS r2_{k}" for k in range(1, 6))}),
ae AS (SELECT model, ({" + ".join(f"abs(r1_{k} - m1_{k})" for k in range(1, 6))})/5 AS acf_error, ({" + ".join(f"abs(r2_{k} - m2_{k})" for k in range(1, 6))})/5 AS acf_sq_error FROM ma CROSS JOIN ra)"""
_Q = [f"q{round(100 * p):02d}_error" for p in QUANTILES]
BODY = f"""WITH {_ACF}, x1 AS ({o.ORACLE["ks_wasserstein"]}), x2 AS ({o.ORACLE["tail_mass_quantiles"]}), x3 AS ({o.ORACLE["moments"]}),
x4 AS (SELECT model, {", ".join(f"abs(quantile_cont(r, {p}) - (SELECT quantile_cont(r, {p}) FROM ret)) AS {n}" for p, n in zip(QUANTILES, _Q))} FROM models GROUP BY 1),
rc AS (SELECT r, avg(r) OVER () AS mu FROM ret), x5 AS (SELECT any_value(mu) AS mu, avg(pow(r - mu, 2)) AS m2, avg(pow(r - mu, 3)) AS m3, avg(pow(r - mu, 4)) AS m4 FROM rc)
SELECT model, ks_stat, ks_pval, wasserstein, {cols("acf_error acf_sq_error")}, tail_mass_ratio, mean_quantile_error, {cols(tuple(_Q))}, mean AS synth_mean, sd AS synth_sd, skew AS synth_skew, excess_kurtosis AS synth_excess_kurtosis,
 {r("mu")} AS real_mean, {r("sqrt(m2)")} AS real_sd, {r("m3/pow(m2, 1.5)")} AS real_skew, {r("m4/(m2*m2) - 3")} AS real_excess_kurtosis FROM x1 JOIN x2 USING (model) JOIN x3 USING (model) JOIN x4 USING (model) JOIN ae USING (model) CROSS JOIN x5"""
STABILITY = f"""WITH {MODEL}, cm AS (SELECT model, sim_id, sum(r) AS cum FROM models GROUP BY 1, 2),
va AS (SELECT model, 'pooled' AS mode, quantile_cont(-r, 0.95) AS var FROM models GROUP BY 1 UNION ALL SELECT model, 'pathwise_median', -quantile_cont(cum, 0.5) FROM cm GROUP BY 1
 UNION ALL SELECT model, 'pathwise_q25', -quantile_cont(cum, 0.25) FROM cm GROUP BY 1 UNION ALL SELECT model, 'pathwise_q75', -quantile_cont(cum, 0.75) FROM cm GROUP BY 1),
br AS (SELECT model, mode, any_value(var) AS var, count(*) AS n_obs, count(*) FILTER (-r >= var) AS n_breach FROM ret CROSS JOIN va GROUP BY 1, 2),
kz AS (SELECT *, sqrt(greatest(-2*({ll("n_obs - n_breach", "n_breach", "0.05")} - {ll("n_obs - n_breach", "n_breach", "n_breach/n_obs")}), 0)) AS zk FROM br),
kp AS (SELECT *, 2*(1 - {phi("zk")}) AS kupiec_pval FROM kz), kv AS (SELECT *, CASE WHEN n_obs < 30 THEN 'INSUFFICIENT_DATA' WHEN kupiec_pval >= 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM kp),
ks AS (SELECT *, min(verdict) OVER (PARTITION BY model) <> max(verdict) OVER (PARTITION BY model) AS aggregation_sensitive FROM kv)
SELECT model, mode, {cols("var kupiec_pval")}, n_obs, n_breach, verdict, aggregation_sensitive, CASE WHEN aggregation_sensitive THEN 'WARNING' ELSE 'OK' END AS flag FROM ks"""
TYPED = f"""{MODEL}, {each("models", "model, sim_id")}, {WINDOW.removeprefix(RET + ", ")}, wx AS (SELECT * FROM wf WHERE max_drawdown IS NOT NULL),
wk AS (SELECT quantile_cont(realised_vol_ann, 0.95) AS hi, quantile_cont(max_drawdown, 0.05) AS low FROM wx), crisis AS (SELECT wx.* FROM wx CROSS JOIN wk WHERE round(realised_vol_ann, 9) >= round(hi, 9) OR round(max_drawdown, 9) <= round(low, 9)),
md AS (SELECT round(quantile_cont(realised_vol_ann, 0.5), 9) AS v, round(quantile_cont(max_drawdown, 0.5), 9) AS d FROM crisis),
typed AS (SELECT crisis.*, CASE WHEN round(max_drawdown, 9) <= d AND round(realised_vol_ann, 9) >= v THEN 0 WHEN round(max_drawdown, 9) <= d THEN 1 ELSE 2 END AS archetype FROM crisis CROSS JOIN md),
syn AS (SELECT model, sim_id, sum(r) AS cum_return, stddev_pop(r)*sqrt(252) AS realised_vol_ann, min(c - p) AS max_drawdown, min(r) AS worst_1d, min(five) AS worst_5d, count(*) FILTER (r < 0) AS negative_days, count(*) FILTER (r <= q) AS tail_days, stddev_pop(abs(r)) AS vol_of_abs_returns FROM pp CROSS JOIN q GROUP BY 1, 2),
bothw AS (SELECT model, {", ".join(FEATURES)} FROM syn UNION ALL SELECT model, {", ".join(FEATURES)} FROM typed CROSS JOIN (SELECT DISTINCT model FROM syn)),
sds AS (SELECT model, {", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1) AS p_{c}, coalesce(nullif(stddev_samp({c}), 0), 1) AS s_{c}" for c in FEATURES)} FROM bothw GROUP BY 1)"""


def _dist(k: str) -> str:
    return "sqrt(" + " + ".join(f"pow((syn.{c} - typed.{c})/{k}_{c}, 2)" for c in FEATURES) + ")"


NEAR = f"{TYPED}, nr AS (SELECT model, start, any_value(archetype) AS archetype, min({_dist('p')}) AS dist, min({_dist('s')}) AS dist_s FROM syn JOIN sds USING (model) CROSS JOIN typed GROUP BY 1, 2)"
_PREC = f"pn AS (SELECT model, sim_id, min({_dist('p')}) AS dist FROM syn JOIN sds USING (model) CROSS JOIN typed GROUP BY 1, 2), pr AS (SELECT model, avg(CASE WHEN dist <= 2 THEN 1.0 ELSE 0.0 END) AS precision, count(*) AS n_windows FROM pn GROUP BY 1), pv AS (SELECT *, CASE WHEN precision >= 0.40 THEN 'PASS' WHEN precision >= 0.25 THEN 'WARNING' ELSE 'FAIL' END AS verdict FROM pr)"
_ARCH = "ar AS (SELECT model, archetype, count(*) AS n_windows, avg(CASE WHEN dist_s <= 2 THEN 1.0 ELSE 0.0 END) AS coverage, avg(dist_s) AS mean_nearest_dist FROM nr GROUP BY 1, 2), av AS (SELECT *, CASE WHEN coverage >= 0.60 THEN 'PASS' WHEN coverage >= 0.40 THEN 'WARNING' ELSE 'FAIL' END AS verdict FROM ar)"
REPORT = f"""WITH {NEAR}, {_PREC}, {_ARCH}, cv AS (SELECT model, avg(CASE WHEN dist <= 2 THEN 1.0 ELSE 0.0 END) AS cov, count(*) AS n_crisis_windows FROM nr GROUP BY 1),
ag AS (SELECT model, count(*) AS n_archetypes_tested, {", ".join(f"count(*) FILTER (verdict = '{v}') AS n_archetypes_{v.lower()}" for v in ("PASS", "FAIL", "WARNING"))} FROM av GROUP BY 1),
rp AS (SELECT *, precision >= 0.70 AND cov < 0.50 AS precision_trap FROM cv JOIN pv USING (model) JOIN ag USING (model))
SELECT model, {r("cov")} AS coverage_at_eps, n_crisis_windows, {r("precision")} AS precision_at_eps, verdict AS precision_verdict, n_windows AS n_synthetic_windows, n_archetypes_tested, n_archetypes_pass, n_archetypes_fail, n_archetypes_warning, precision_trap,
 CASE WHEN cov >= 0.65 AND NOT precision_trap THEN 'PASS' WHEN cov >= 0.50 THEN 'WARNING' ELSE 'FAIL' END AS overall_verdict FROM rp"""
_ML = f"{EVT}, bx0 AS (SELECT any_value(threshold) AS threshold, count(*) AS n, -0.999/max(excess) AS a, 4/avg(excess) AS b FROM ex)"
for _i, _n in enumerate((400, 100, 40)):
    _ML += f""", gr{_i} AS (SELECT threshold, n, (b - a)/{_n} AS step, a + (b - a)/{_n}*k AS theta FROM bx{_i} CROSS JOIN range({_n + 1}) t(k)),
 de{_i} AS (SELECT g.threshold, g.n, step, theta, avg(ln(1 + theta*excess)) AS xi FROM gr{_i} g CROSS JOIN ex WHERE abs(theta) > 1e-9 AND 1 + theta*excess > 0 GROUP BY ALL HAVING count(*) = g.n),
 be{_i} AS (SELECT threshold, n, arg_max(struct_pack(theta := theta, xi := xi, step := step), -ln(xi/theta) - xi) AS s FROM de{_i} GROUP BY ALL), bx{_i + 1} AS (SELECT threshold, n, s.theta - s.step AS a, s.theta + s.step AS b FROM be{_i})"""
SCENARIO = f"""WITH RECURSIVE {o.IV}, {o.BOOT}, {_ML.removeprefix(RET + ", ").replace("q AS (", "eq AS (", 1).replace("CROSS JOIN q)", "CROSS JOIN eq)", 1)}, fit AS (SELECT threshold, n, s.xi AS xi, s.xi/s.theta AS sigma FROM be2),
{o.corrected("boot")}, per AS (SELECT sim_id, sum(r) AS cum FROM corrected GROUP BY 1), {PHYSICAL.format(source="puts")}{o.RANKED} {o._SUMMARY}"""
_G = o._REG
WALK = f"""WITH {o.BLOCKS}, ev AS (SELECT rn AS day FROM ret WHERE (rn - 505) % 21 = 0 AND rn > 504 AND rn <= (SELECT max(rn) FROM ret) - 20),
fa AS (SELECT day, {", ".join(f"{c} AS v_{c}" for c in _G)} FROM ev JOIN cf ON cf.rn = day WHERE place >= 100),
jb AS (SELECT day, block_id, block_vol_ann, block_max_dd, {", ".join(f"{c}, v_{c}" for c in _G)} FROM fa JOIN bl ON block_id + 19 <= day),
js AS (SELECT day, {", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _G)}, quantile_cont(block_vol_ann, 0.95) AS hi, quantile_cont(block_max_dd, 0.05) AS low FROM jb GROUP BY 1),
jw AS (SELECT day, block_id, exp(-0.5*({" + ".join(f"pow(({c} - v_{c})/s_{c}, 2)" for c in _G)}))*CASE WHEN round(block_vol_ann, 9) >= round(hi, 9) OR round(block_max_dd, 9) <= round(low, 9) THEN 2.0 ELSE 1.0 END AS w FROM jb JOIN js USING (day)),
jc AS (SELECT day, block_id, sum(w) OVER (PARTITION BY day ORDER BY block_id)/sum(w) OVER (PARTITION BY day) AS c FROM jw),
jv AS (SELECT day, block_id, coalesce(lag(c) OVER w, 0) AS lo, CASE WHEN lead(c) OVER w IS NULL THEN 1 ELSE c END AS hi FROM jc WINDOW w AS (PARTITION BY day ORDER BY block_id)),
sm AS (SELECT i AS sim_id, 0 AS zero FROM range(1, 2001) t(i)), su AS ({o.uniform_sql("sm", o.BLOCK_DRAWS, "sim_id", "zero")}), jd AS (SELECT day, sim_id, block_id FROM su JOIN jv ON u >= lo AND u < hi),
bs AS (SELECT day, sim_id, rn - block_id AS step, r FROM jd JOIN ret ON rn >= block_id AND rn < block_id + 20), kq AS (SELECT day, quantile_cont(-r, 0.99) AS cut FROM bs GROUP BY 1),
lo AS (SELECT day, rn, -r AS loss FROM ret JOIN fa ON rn <= day), lq AS (SELECT day, quantile_cont(loss, 0.95) AS q1, quantile_cont(loss, 0.90) AS q2 FROM lo GROUP BY 1),
lu AS (SELECT day, CASE WHEN count(*) FILTER (loss > q1) < 20 THEN any_value(q2) ELSE any_value(q1) END AS threshold FROM lo JOIN lq USING (day) GROUP BY 1),
lx AS (SELECT day, threshold, loss - threshold AS y, row_number() OVER (PARTITION BY day ORDER BY loss, rn) AS i, count(*) OVER (PARTITION BY day) AS n FROM lo JOIN lu USING (day) WHERE loss > threshold),
lb AS (SELECT day, threshold, avg(y) AS b0, avg((1 - (i - 0.35)/n)*y) AS b1 FROM lx GROUP BY 1, 2), lf AS (SELECT day, threshold, 2 - b0/(b0 - 2*b1) AS xi, 2*b0*b1/(b0 - 2*b1) AS sigma FROM lb),
tz AS (SELECT bs.* FROM bs JOIN kq USING (day) WHERE -r >= cut), tu AS ({o.uniform_sql("tz", o.TAILS, "sim_id", "step", "z")}),
cs AS (SELECT bs.* FROM bs JOIN kq USING (day) WHERE -r < cut UNION ALL SELECT day, sim_id, step, -(threshold + {o._TAIL}) FROM tu JOIN lf USING (day)),
{each("cs", "day, sim_id")}, pv AS (SELECT day, quantile_cont(-cum, 0.95) AS v5, quantile_cont(-cum, 0.99) AS v1 FROM per GROUP BY 1),
pd AS (SELECT day AS rn, {", ".join(f"avg(CASE WHEN max_dd <= -{x / 100} THEN 1.0 ELSE 0.0 END) AS pred_p_drawdown_{x}pct" for x in (5, 8, 10))}, any_value(v5) AS pred_var_5pct, any_value(v1) AS pred_var_1pct, avg(-cum) FILTER (round(-cum, 9) >= round(v5, 9)) AS pred_es_5pct, quantile_cont(cum, 0.5) AS pred_median_return FROM per JOIN pv USING (day) GROUP BY 1),
hr AS (SELECT rn, {", ".join(f"round({c}, 10) AS {c}" for c in _L)} FROM cf), {LAMBDA[LAMBDA.index("lc AS ("):].replace("FROM ev e JOIN", "FROM (SELECT hr.* FROM hr JOIN ev ON hr.rn = day) e JOIN")}, lt AS (SELECT rn, lambda_t, CASE WHEN lambda_t > 0.7 THEN 'crisis' WHEN lambda_t > 0.3 THEN 'fragile' ELSE 'calm' END AS regime FROM lam),
lb2 AS ({o._LABELS}), {o.dd("rx", 1, 20)}
SELECT pd.rn, {cols(tuple(f"pred_{k}" for k in ("p_drawdown_5pct", "p_drawdown_8pct", "p_drawdown_10pct", "var_5pct", "var_1pct", "es_5pct", "median_return")))}, {r("lambda_t")} AS lambda_t, coalesce(regime, 'unknown') AS regime, stress_20d AS realised_stress, {r("rx.v")} AS realised_max_dd
FROM pd LEFT JOIN lt ON lt.rn = pd.rn JOIN lb2 ON lb2.rn = pd.rn LEFT JOIN rx ON rx.rn = pd.rn"""
_REL8 = f"{FORECAST}, ed AS (SELECT quantile_cont(p, [{', '.join(str(k / 8) for k in range(1, 8))}]) AS edges FROM fc), bi AS (SELECT p, y, len(list_filter(edges, lambda e: e < p)) AS bin FROM fc CROSS JOIN ed), eg AS (SELECT avg(g) AS ece FROM (SELECT abs(avg(p) - avg(y)) AS g FROM bi GROUP BY bin))"
_W = {"calibration": "CASE WHEN kupiec_verdict IS NULL OR es_verdict = 'FAIL' THEN 0.0 WHEN kupiec_verdict = 'PASS' AND conditional_cov_verdict = 'PASS' THEN 1.0 WHEN kupiec_verdict = 'PASS' THEN 0.5 ELSE 0.0 END",
      "tail_mass": "CASE WHEN tail_mass_ratio BETWEEN 0.6 AND 2 THEN 1.0 WHEN tail_mass_ratio < 0.3 THEN 0.0 WHEN tail_mass_ratio < 0.6 THEN 0.4 ELSE 0.5 END",
      "crisis_coverage": "CASE WHEN coverage_at_eps >= 0.7 AND NOT precision_trap AND n_archetypes_fail = 0 THEN 1.0 WHEN coverage_at_eps >= 0.55 THEN 0.5 ELSE 0.0 END",
      "pathwise_stability": "CASE WHEN nm = 0 THEN 0.5 WHEN sens THEN 0.3 WHEN np = nm THEN 1.0 ELSE 0.6 END",
      "regime_drift": "CASE status WHEN 'LOW' THEN 1.0 WHEN 'MODERATE' THEN 0.6 WHEN 'HIGH' THEN 0.2 ELSE 0.5 END",
      "options_disagreement": "CASE WHEN mean_gap IS NULL THEN 0.5 WHEN abs(mean_gap) < 0.03 THEN 0.9 WHEN abs(mean_gap) < 0.08 THEN 0.6 ELSE 0.3 END"}
_S = {"calibration": "CASE WHEN kupiec_verdict IS NULL THEN 'UNKNOWN' WHEN es_verdict = 'FAIL' THEN 'FAIL' WHEN kupiec_verdict = 'PASS' AND conditional_cov_verdict = 'PASS' THEN 'PASS' WHEN kupiec_verdict = 'PASS' THEN 'WARNING' ELSE 'FAIL' END",
      "tail_mass": "CASE WHEN tail_mass_ratio IS NULL THEN 'UNKNOWN' WHEN tail_mass_ratio BETWEEN 0.6 AND 2 THEN 'PASS' WHEN tail_mass_ratio >= 0.3 THEN 'WARNING' ELSE 'FAIL' END",
      "crisis_coverage": "CASE WHEN coverage_at_eps >= 0.7 AND NOT precision_trap AND n_archetypes_fail = 0 THEN 'PASS' WHEN coverage_at_eps >= 0.55 THEN 'WARNING' ELSE 'FAIL' END",
      "pathwise_stability": "CASE WHEN nm = 0 THEN 'UNKNOWN' WHEN NOT sens AND np = nm THEN 'PASS' ELSE 'WARNING' END", "regime_drift": "status",
      "options_disagreement": "CASE WHEN mean_gap IS NULL THEN 'UNKNOWN' WHEN abs(mean_gap) < 0.03 THEN 'NARROW' WHEN abs(mean_gap) < 0.08 THEN 'MODERATE' ELSE 'WIDE' END"}
_F = {"calibration": "obs_exp_ratio", "tail_mass": "tail_mass_ratio", "crisis_coverage": "100*coverage_at_eps", "pathwise_stability": "CAST(np AS DOUBLE)", "regime_drift": "drift", "options_disagreement": "100*mean_gap"}
HEALTH = f"""WITH h1 AS ({o.ORACLE["var_backtest_multi"]}), h2 AS ({o.ORACLE["tail_mass_quantiles"]}), h3 AS ({REPORT}), h4 AS ({STABILITY}), h5 AS ({o.ORACLE["regime_drift"]}), h6 AS ({o.ORACLE["disagreement_summary"]}),
h7 AS (SELECT model, bool_or(aggregation_sensitive) AS sens, count(*) FILTER (verdict = 'PASS') AS np, count(*) FILTER (verdict <> 'INSUFFICIENT_DATA') AS nm FROM h4 GROUP BY 1),
ly AS (SELECT * FROM (SELECT * FROM h1 WHERE alpha = 0.05) JOIN h2 USING (model) JOIN h3 USING (model) JOIN h7 USING (model) CROSS JOIN h5 CROSS JOIN (SELECT mean_gap FROM h6)),
ck AS ({" UNION ALL ".join(f"SELECT model, '{k}' AS check_name, {_S[k]} AS status, CAST({_W[k]} AS DOUBLE) AS confidence_weight, {_F[k]} AS figure FROM ly" for k in _S)}),
ch AS (SELECT model, avg(confidence_weight) AS score, count(*) FILTER (status IN ('PASS', 'LOW', 'NARROW')) AS n_pass, count(*) FILTER (status IN ('WARNING', 'MODERATE', 'HIGH')) AS n_warning, count(*) FILTER (status = 'FAIL') AS n_fail FROM ck GROUP BY 1),
ho AS (SELECT *, CASE WHEN round(score, 9) >= 0.75 THEN 'HIGH' WHEN round(score, 9) >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ch)"""
def _part(sql: str, part: str) -> str:
    """The SQL over a part of the series; the models' paths are drawn from the whole of it."""
    held = f"{MODEL}, part AS ({part})"
    return held.join(re.sub(r"\bret\b", "part", x) for x in sql.split(MODEL))


_CUT = "(SELECT CAST(floor(count(*)*0.8) AS BIGINT) FROM ret)"
_TRAIN, _TEST = f"SELECT * FROM ret WHERE rn <= {_CUT}", f"SELECT rn - {_CUT} AS rn, dt, r FROM ret WHERE rn > {_CUT}"
_LEADER = f"""b4 AS ({o.ORACLE["calibration_metrics"]}),
bt AS (SELECT model, CASE WHEN max(overall_verdict) FILTER (alpha = 0.05) = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS var_5pct_verdict, CASE WHEN max(overall_verdict) FILTER (alpha = 0.01) = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS var_1pct_verdict, max(es_severity_ratio) FILTER (alpha = 0.05) AS es_severity_ratio FROM b1 GROUP BY 1),
al AS (SELECT b0.model, ks_stat, wasserstein, acf_sq_error, tail_mass_ratio, var_5pct_verdict, var_1pct_verdict, es_severity_ratio, aggregation_sensitive, coverage_at_eps AS crisis_coverage, precision_at_eps AS crisis_precision, precision_trap, n_archetypes_pass, n_archetypes_fail, CASE WHEN b0.model = 'boot' THEN brier END AS brier
 FROM b0 JOIN bt USING (model) JOIN (SELECT model, bool_or(aggregation_sensitive) AS aggregation_sensitive FROM b2 GROUP BY 1) USING (model) JOIN b3 USING (model) CROSS JOIN (SELECT brier FROM b4)),
sc AS (SELECT *, round(least(100, least(greatest(0, 10 - ks_stat*200) + greatest(0, 5 - wasserstein*2000) + greatest(0, 5 - acf_sq_error*50), 20) + CASE WHEN var_5pct_verdict = 'PASS' THEN 12 ELSE 0 END + CASE WHEN var_1pct_verdict = 'PASS' THEN 12 ELSE 0 END
 + coalesce(least(11, greatest(0, 11 - 11*abs(ln(CASE WHEN es_severity_ratio IS NOT NULL THEN greatest(es_severity_ratio, 0.01) END)))), 0)*CASE WHEN es_severity_ratio IS NULL THEN 0 ELSE 1 END + least(30, least(crisis_coverage*30, 20) + least(crisis_precision*10, 10)) + CASE WHEN aggregation_sensitive THEN 5 ELSE 15 END
 + CASE WHEN brier IS NULL THEN 0 ELSE least(10, greatest(0, 10 - brier*100)) END), 1) AS risk_validity_score, {r('CASE WHEN tail_mass_ratio IS NULL THEN 0 ELSE greatest(0, 10 - 10*abs(ln(greatest(tail_mass_ratio, 0.01)))) END')} AS tail_pts FROM al)
SELECT *, row_number() OVER (ORDER BY risk_validity_score DESC, model) AS rank, CASE WHEN risk_validity_score >= 70 THEN 'HIGH' WHEN risk_validity_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM sc"""
_NAME = "CASE archetype " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(ARCHETYPES)) + " END"
_LINE = """CASE WHEN n_fail > 0 THEN n_fail || ' validation layers fail: do not rely on this model without a closer look' WHEN n_warning > 1 THEN n_warning || ' validation warnings: read beside other indicators' WHEN n_warning = 1 THEN 'One validation warning: look at the flagged layer' ELSE 'All validation layers pass' END"""

ORACLE = {
    "null_drop_all": f"WITH {PANEL}, {VIX} SELECT CAST(dt AS VARCHAR) AS dt, count(*) AS n FROM vx JOIN panel USING (dt) GROUP BY vx.dt, dt",
    "opt_spot": f"WITH {PANEL} SELECT ticker, {r('max_by(close, dt)')} AS spot FROM panel GROUP BY 1",
    "src_single_series": f"WITH {PANEL} SELECT CAST(dt AS VARCHAR) AS dt, ticker, {r('close')} AS close FROM panel WHERE ticker = '1-URGENT'",
    "opt_spot_fallback": f"WITH {CHAIN}, {PANEL}, lp AS (SELECT contract_id, CASE contract_id % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE 'NO-PRICE' END AS ticker, (bid + ask)/2 AS last_price FROM chain), sp AS (SELECT ticker, max_by(close, dt) AS px FROM panel GROUP BY 1), me AS (SELECT ticker, quantile_cont(last_price, 0.5) AS med FROM lp GROUP BY 1) SELECT contract_id, lp.ticker, {r('coalesce(px, med)')} AS spot FROM lp LEFT JOIN sp USING (ticker) JOIN me USING (ticker)",
    "opt_spot_asof": f"WITH {PANEL}, qu AS (SELECT CAST(l_orderkey*10 + l_linenumber AS BIGINT) AS quote_id, CASE l_orderkey % 5 {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(TICKERS))} END AS ticker, CAST(l_shipdate AS DATE) AS dt FROM lineitem) SELECT quote_id, qu.ticker, CAST(qu.dt AS VARCHAR) AS dt, CASE WHEN qu.dt - panel.dt <= 30 THEN {r('close')} END AS spot FROM qu ASOF LEFT JOIN panel ON qu.ticker = panel.ticker AND qu.dt >= panel.dt",
    "opt_call_chain": f"WITH {CHAIN}, x AS (SELECT contract_id, spot, strike, t_years, open_interest, volume, (ask - bid)/2 AS half, greatest((bid + ask)/2 + spot - strike*exp(-0.045*t_years), (ask - bid)/2 + 0.01) AS c0 FROM chain) SELECT contract_id, open_interest, volume, {cols('spot strike t_years')}, {r('c0 - half')} AS bid, {r('c0 + half')} AS ask, {r('c0')} AS mid, {r('2*half')} AS bid_ask, {r('strike/spot')} AS moneyness, {r('2*half/c0')} AS bid_ask_pct FROM x",
    "put_ui_filter": f"WITH {CHAIN} SELECT contract_id FROM liquid WHERE coalesce(open_interest, 0) >= 250 AND round(bid_ask_pct, 9) <= 0.10",
    "bs_call": f"WITH {CHAIN}, x AS (SELECT *, (ln(spot/strike) + CAST(0.045 AS DOUBLE)*t_years)/(0.2*sqrt(t_years)) + 0.2*sqrt(t_years)/2 AS a FROM chain), y AS (SELECT *, a - 0.2*sqrt(t_years) AS b FROM x) SELECT contract_id, {r(f'spot*{phi(chr(97))} - strike*exp(-0.045*t_years)*{phi(chr(98))}')} AS bs_call FROM y",
    "historical_context": f"WITH {CHAIN}, {PATHS}, {each('paths', 'sim_id')}, {PHYSICAL.format(source='liquid')}, hq AS (SELECT quantile_cont(-r, 0.95) AS hist_tail_threshold FROM ret), hm AS (SELECT quantile_cont(physical_prob_itm, 0.5) AS m FROM phys), hn AS (SELECT count(*) FILTER (-r > hist_tail_threshold) AS hist_crisis_episode_n, avg(CASE WHEN -r > m THEN 1.0 ELSE 0.0 END) AS share FROM ret CROSS JOIN hq CROSS JOIN hm) SELECT contract_id, {cols('physical_prob_itm hist_tail_threshold')}, hist_crisis_episode_n, physical_prob_itm > share AS model_exceeds_hist_95pct FROM phys CROSS JOIN hq CROSS JOIN hn",
    "top_disagreements": f"WITH RECURSIVE {SCORED} SELECT contract_id, {r('scored.tail_score')} AS tail_score FROM scored ORDER BY scored.tail_score DESC, contract_id LIMIT 20",
    "gate_features": f"WITH {o.FEATURES} SELECT rn, " + ", ".join("CAST(0 AS DOUBLE) AS vix_change_5d" if c == "vix_change_5d" else f"{r(f'coalesce({src}, 0)')} AS {c}" for c in COLUMNS for src in (f"-ret_{c[5:]}" if c.startswith("loss") else c,)) + " FROM feat",
    "gate_ensemble": f"WITH {FORECAST}, x AS (SELECT event_id, p AS a, p*p AS b, CASE WHEN event_id % 5 = 0 THEN NULL ELSE sqrt(p) END AS c FROM fc), y AS (SELECT event_id, (a + b + coalesce(c, 0))/(CASE WHEN c IS NULL THEN 2 ELSE 3 END) AS m, greatest(a, b, c) - least(a, b, c) AS w FROM x) SELECT event_id, {r('m')} AS p_ensemble_mean, {r('w')} AS p_ensemble_range, CASE WHEN w < 0.05 THEN 'HIGH' WHEN w < 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM y",
    "gate_calibration": f"WITH {_REL8}, g AS (SELECT count(*) AS n_obs, avg(y) AS b, avg(pow(p - y, 2)) AS brier, count(*) FILTER (p >= 0.15 AND y = 1) AS tp, count(*) FILTER (p >= 0.15 AND y = 0) AS fp, count(*) FILTER (p < 0.15 AND y = 0) AS tn, count(*) FILTER (p < 0.15 AND y = 1) AS fn FROM fc) SELECT n_obs, tp, fp, tn, fn, {r('b')} AS base_rate, {cols('brier ece')}, {r('1 - brier/nullif(b*(1 - b), 0)')} AS brier_skill, {r('tp/greatest(tp + fn, 1)')} AS recall, {r('tp/greatest(tp + fp, 1)')} AS precision, {r('fp/greatest(fp + tn, 1)')} AS false_alarm_rate, CASE WHEN ece < 0.05 THEN 'WELL_CALIBRATED' WHEN ece < 0.1 THEN 'MODERATE_CALIBRATION' ELSE 'POORLY_CALIBRATED' END AS verdict FROM g CROSS JOIN eg WHERE n_obs >= 20",
    "evt_fit": f"WITH {_ML} SELECT {r('threshold')} AS threshold, n, {r('s.xi')} AS xi, {r('s.xi/s.theta')} AS sigma FROM be2",
    "scenario_options": SCENARIO,
    "walk_forward": WALK,
    "lambda_history": f"WITH {LAMBDA} SELECT rn, {cols('vol_pct vix_pct dd_stress ret_stress raw_score lambda_t')}, CASE WHEN lambda_t > 0.7 THEN 'crisis' WHEN lambda_t > 0.3 THEN 'fragile' ELSE 'calm' END AS regime FROM lam",
    "acf_error": f"WITH {_ACF} SELECT model, {cols('acf_error acf_sq_error')} FROM ae",
    "body_realism": BODY,
    "pathwise_stability": STABILITY,
    "coverage_at_eps": f"WITH {NEAR}, ep AS (SELECT unnest([{', '.join(str(k / 2) for k in range(1, 11))}]::DOUBLE[]) AS epsilon) SELECT model, epsilon, count(*) FILTER (dist <= epsilon) AS n_covered, count(*) AS n_total, {r('count(*) FILTER (dist <= epsilon)/count(*)')} AS coverage FROM nr CROSS JOIN ep GROUP BY 1, 2",
    "precision_at_eps": f"WITH {TYPED}, {_PREC} SELECT model, {r('pv.precision')} AS precision, n_windows, verdict FROM pv",
    "archetype_coverage": f"WITH {NEAR}, {_ARCH} SELECT model, CAST(archetype AS BIGINT) AS archetype, n_windows, {r('av.coverage')} AS coverage, {r('av.mean_nearest_dist')} AS mean_nearest_dist, {_NAME} AS archetype_name, verdict FROM av",
    "crisis_report": REPORT,
    "prob_by_strike": f"WITH RECURSIVE {SCORED} SELECT contract_id, {cols('strike moneyness physical_prob_itm')}, CASE WHEN {o._TIME} > 0.01 THEN {r('risk_neutral_prob_itm', 5)} END AS risk_neutral_prob_itm FROM scored",
    "risk_charts": f"WITH {PATHS}, {each('paths', 'sim_id')}, e AS (SELECT min(cum) AS lo, max(cum) AS hi FROM per) SELECT CAST(least(floor((cum - lo)/(hi - lo)*80), 79) AS BIGINT) AS bin, count(*) AS n, {r('any_value(lo + (hi - lo)/80*least(floor((cum - lo)/(hi - lo)*80), 79))')} AS bin_from, {r('any_value(lo + (hi - lo)/80*(1 + least(floor((cum - lo)/(hi - lo)*80), 79)))')} AS bin_to FROM per CROSS JOIN e GROUP BY 1",
    "health_checks": f'{HEALTH} SELECT model, check_name AS "check", status, {cols("confidence_weight figure")} FROM ck',
    "model_health": f"{HEALTH} SELECT model, {r('score')} AS confidence_score, n_pass, n_warning, n_fail, confidence, {_LINE} AS headline FROM ho",
    "health_table": f'{HEALTH} SELECT model, check_name AS "check", status, {cols("confidence_weight")}, status || \' at \' || coalesce(printf(\'%.2f\', {r("figure")}), \'no figure\') AS detail FROM ck UNION ALL SELECT model, \'OVERALL\', confidence, {r("score")}, {_LINE} FROM ho',
    "leaderboard": f"WITH b0 AS ({BODY}), b1 AS ({o.ORACLE['var_backtest_multi']}), b2 AS ({STABILITY}), b3 AS ({REPORT}), {_LEADER}",
    "leaderboard_split": f"WITH b0 AS ({_part(BODY, _TEST)}), b1 AS ({_part(o.ORACLE['var_backtest_multi'], _TEST)}), b2 AS ({_part(STABILITY, _TEST)}), b3 AS ({_part(REPORT, _TRAIN)}), {_LEADER}",
}
