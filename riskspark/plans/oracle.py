"""The queries in DuckDB SQL, written apart from the DataFrame plans."""

from __future__ import annotations

from ..functions.columns import DENOMINATOR, NUMERATOR
from ..functions.counter import BLOCKS as BLOCK_DRAWS
from ..functions.counter import TAILS, uniform_sql
from ..sources.tables import MODELS
from ..operators.validation import QUANTILES


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


RET = """d AS (SELECT CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS px FROM orders GROUP BY 1),
m AS (SELECT avg(px) AS mu, stddev_pop(px) AS sd FROM d),
ret AS (SELECT row_number() OVER (ORDER BY dt) AS rn, dt, 0.01*(px-mu)/sd AS r FROM d CROSS JOIN m)"""
VIX = "vx AS (SELECT CAST(l_shipdate AS DATE) AS dt, 10 + 200*avg(l_discount) AS vix_level FROM lineitem GROUP BY 1)"
RETV = f"{RET}, {VIX}, rv AS (SELECT rn, dt, r, last_value(vix_level IGNORE NULLS) OVER (ORDER BY rn) AS vix_level FROM ret LEFT JOIN vx USING (dt))"
PANEL = """pd AS (SELECT CAST(o_orderdate AS DATE) AS dt, o_orderpriority AS ticker, avg(o_totalprice) AS px FROM orders GROUP BY 1, 2),
pm AS (SELECT ticker, avg(px) AS mu, stddev_pop(px) AS sd FROM pd GROUP BY 1),
panel AS (SELECT dt, ticker, 100*exp(sum(0.01*(px-mu)/sd) OVER (PARTITION BY ticker ORDER BY dt)) AS close FROM pd JOIN pm USING (ticker))"""
PRET = f"{PANEL}, pr AS (SELECT * FROM (SELECT dt, ticker, ln(close/lag(close) OVER (PARTITION BY ticker ORDER BY dt)) AS r FROM panel) WHERE r IS NOT NULL)"


def roll(f: str, x: str, w: int, by: str = "", order: str = "rn") -> str:
    o = f"OVER ({by} ORDER BY {order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {o} = {w} THEN {f}({x}) {o} END"


def dd(name: str, first: int, last: int, source: str = "ret") -> str:
    """CTE (rn, v): drawdown over the rows rn+first .. rn+last where all are there."""
    n = last - first + 1
    return f"""{name} AS (SELECT rn, min(c - p) AS v FROM (SELECT rn, c, max(c) OVER (PARTITION BY rn ORDER BY j) AS p FROM
 (SELECT e.rn, h.rn AS j, sum(h.r) OVER (PARTITION BY e.rn ORDER BY h.rn) AS c FROM {source} e JOIN {source} h ON h.rn BETWEEN e.rn + ({first}) AND e.rn + ({last}))) GROUP BY rn HAVING count(*) = {n})"""


_A = "sqrt(252)"
FEATURES = (
    RETV + ", " + ", ".join(dd(f"dd{w}", 1 - w, 0) for w in (5, 10, 20, 60)) + ", feat AS (SELECT rv.rn, r, vix_level, "
    + ", ".join(f"{roll('sum', 'r', w)} AS ret_{w}d, {roll('stddev_samp', 'r', w)} * {_A} AS vol_{w}d, dd{w}.v AS drawdown_{w}d" for w in (5, 10, 20, 60))
    + f", vix_level - lag(vix_level, 5) OVER (ORDER BY rv.rn) AS vix_change_5d, vix_level - lag(vix_level, 20) OVER (ORDER BY rv.rn) AS vix_change_20d, (vix_level - {roll('avg', 'vix_level', 252, order='rv.rn')}) / nullif({roll('stddev_samp', 'vix_level', 252, order='rv.rn')}, 0) AS vix_z_252d FROM rv "
    + " ".join(f"LEFT JOIN dd{w} ON dd{w}.rn = rv.rn" for w in (5, 10, 20, 60)) + ")"
).replace("ORDER BY rn ROWS", "ORDER BY rv.rn ROWS")
PATHS = f"""{RET}, nb AS (SELECT max(rn) - 19 AS nb FROM ret),
draw AS (SELECT o_orderkey AS sim_id, 1 + (o_orderkey*1103515245 + 12345) % 2147483648 % nb AS block_id FROM orders CROSS JOIN nb),
paths AS (SELECT sim_id, rn - block_id AS step, block_id, r FROM draw JOIN ret ON ret.rn >= draw.block_id AND ret.rn < draw.block_id + 20)"""
MODEL = f"{PATHS}, models AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, sim_id, step, r * CAST({a} AS DOUBLE) + CAST({b} AS DOUBLE) AS r FROM paths" for m, a, b in MODELS) + ")"


def each(source: str, by: str) -> str:
    return f"""pc AS (SELECT {by}, step, r, sum(r) OVER (PARTITION BY {by} ORDER BY step) AS c FROM {source}),
pp AS (SELECT *, max(c) OVER (PARTITION BY {by} ORDER BY step) AS p, CASE WHEN step >= 4 THEN sum(r) OVER (PARTITION BY {by} ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS five FROM pc),
per AS (SELECT {by}, sum(r) AS cum, min(c - p) AS max_dd, stddev_pop(r) * {_A} AS vol, min(r) AS worst_1d, min(five) AS worst_5d, count(*) FILTER (r < 0) AS negative_days FROM pp GROUP BY {by})"""


CHAIN = """cp AS (SELECT p_partkey AS contract_id, CAST(100 AS DOUBLE) AS spot, 70 + CAST(p_partkey % 121 AS DOUBLE)/2 AS strike, CAST(30*(1 + (p_partkey % 6)) AS DOUBLE)/365 AS t_years,
 CAST(0.10 AS DOUBLE) + CAST(p_size AS DOUBLE)/100 AS s0, CAST(0.01 AS DOUBLE) + CAST(p_partkey % 40 AS DOUBLE)/100 AS sp, (p_partkey*37) % 1000 AS open_interest, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_partkey*53) % 500 END AS volume FROM part),
cq AS (SELECT *, greatest(strike*exp(-0.045*t_years) - spot, 0) + 0.4*spot*s0*sqrt(t_years)*exp(-2*abs(ln(strike/spot))/(s0*sqrt(t_years))) AS m0 FROM cp),
chain AS (SELECT contract_id, spot, strike, t_years, m0*(1 - sp/2) AS bid, m0*(1 + sp/2) AS ask, open_interest, volume FROM cq),
quoted AS (SELECT *, (bid + ask)/2 AS mid, ask - bid AS bid_ask, strike/spot AS moneyness, CASE WHEN (bid + ask)/2 > 0 THEN (ask - bid)/((bid + ask)/2) END AS bid_ask_pct FROM chain),
liquid AS (SELECT * FROM quoted WHERE mid >= 0.05 AND bid > 0 AND ask > 0 AND ask >= bid AND round(bid_ask_pct, 9) <= 0.20 AND coalesce(open_interest, 0) >= 100)"""


def _poly(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out}*{x} + {c!r}::DOUBLE)"
    return out


def phi(x: str) -> str:
    """Normal distribution of a column name."""
    a = f"abs({x})"
    tail = f"(CASE WHEN {a} < 7.07106781186547 THEN exp(-{a}*{a}/2)*{_poly(a, NUMERATOR)}/{_poly(a, DENOMINATOR)} ELSE exp(-{a}*{a}/2)/({a} + 1/({a} + 2/({a} + 3/({a} + 4/({a} + 0.65)))))/2.506628274631 END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


# bisection: lo, hi and k per contract; a price at the middle from the CTE's own columns
IV = f"""{CHAIN},
iv(contract_id, mid, spot, strike, t_years, k, lo, hi) AS (SELECT contract_id, mid, spot, strike, t_years, 0, CAST(1e-5 AS DOUBLE), CAST(8 AS DOUBLE) FROM liquid WHERE mid > 0.999*greatest(strike*exp(-0.045*t_years) - spot, 0)
 UNION ALL SELECT contract_id, mid, spot, strike, t_years, k + 1, CASE WHEN price < mid THEN v ELSE lo END, CASE WHEN price < mid THEN hi ELSE v END FROM
 (SELECT *, strike*exp(-0.045*t_years)*{phi("a")} - spot*{phi("b")} AS price FROM (SELECT *, v*sqrt(t_years) - d1 AS a, -d1 AS b FROM
 (SELECT *, (ln(spot/strike) + CAST(0.045 AS DOUBLE)*t_years)/(v*sqrt(t_years)) + v*sqrt(t_years)/2 AS d1 FROM (SELECT *, (lo + hi)/2 AS v FROM iv WHERE k < 60))))),
puts AS (SELECT *, {phi("a2")} AS risk_neutral_prob_itm, {phi("d1")} - 1 AS delta, spot*exp(-d1*d1/2)/sqrt(2*pi())*sqrt(t_years)*0.01 AS vega_per_1pct, strike*exp(-0.045*t_years)*{phi("a2")} - spot*{phi("b2")} AS bs_price_from_iv FROM
 (SELECT *, implied_vol*sqrt(t_years) - d1 AS a2, -d1 AS b2 FROM (SELECT l.*, (lo + hi)/2 AS implied_vol, (ln(l.spot/l.strike) + (CAST(0.045 AS DOUBLE) + (lo + hi)*(lo + hi)/8)*l.t_years)/((lo + hi)/2*sqrt(l.t_years)) AS d1
 FROM liquid l JOIN iv USING (contract_id) WHERE k = 60 AND lo > 1e-5 AND hi < 8)))"""
PHYSICAL = """phys AS (SELECT l.contract_id, avg(CASE WHEN l.spot*exp(cum) < l.strike THEN 1.0 ELSE 0.0 END) AS physical_prob_itm, avg(greatest(l.strike - l.spot*exp(cum), 0)) AS physical_expected_payoff FROM {source} l CROSS JOIN per GROUP BY l.contract_id)"""
RANKED = """,
ranked AS (SELECT *, (rank() OVER (ORDER BY coalesce(open_interest, 0))*2 + count(*) OVER (PARTITION BY coalesce(open_interest, 0)) - 1)/2/count(*) OVER () AS ro,
 (rank() OVER (ORDER BY coalesce(volume, 0))*2 + count(*) OVER (PARTITION BY coalesce(volume, 0)) - 1)/2/count(*) OVER () AS rv FROM puts JOIN phys USING (contract_id)),
sc1 AS (SELECT *, physical_prob_itm - risk_neutral_prob_itm AS gap, (0.6*ro + 0.4*rv)/(1 + 10*coalesce(bid_ask_pct, 1)) AS liquidity_score FROM ranked),
scored AS (SELECT *, abs(gap)*liquidity_score*sqrt(greatest(coalesce(open_interest, 0), 1)) AS tail_score, CASE WHEN liquidity_score <= 0.33 THEN 'LOW' WHEN liquidity_score <= 0.66 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
 CASE WHEN gap >= 0.03 THEN 'MODEL_SEES_MORE_DOWNSIDE_THAN_OPTIONS' WHEN gap <= -0.03 THEN 'OPTIONS_PRICE_MORE_DOWNSIDE_THAN_MODEL' ELSE 'NO_MATERIAL_DISAGREEMENT' END AS interpretation FROM sc1)"""
SCORED = IV + ", " + PATHS + ", " + each("paths", "sim_id") + ", " + PHYSICAL.format(source="puts") + RANKED
WINDOW = f"""{RET}, {dd("wdd", 0, 19)}, q AS (SELECT quantile_cont(r, 0.05) AS q FROM ret),
five AS (SELECT rn, CASE WHEN count(*) OVER w = 5 THEN sum(r) OVER w END AS f FROM ret WINDOW w AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
wf AS (SELECT rn AS start, sum(r) OVER w AS cum_return, stddev_pop(r) OVER w * {_A} AS realised_vol_ann, v AS max_drawdown, min(r) OVER w AS worst_1d, min(f) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS worst_5d,
 CAST(sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS negative_days, CAST(sum(CASE WHEN r <= q THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tail_days, stddev_pop(abs(r)) OVER w AS vol_of_abs_returns
 FROM ret JOIN five USING (rn) CROSS JOIN q LEFT JOIN wdd USING (rn) WINDOW w AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))"""
_REG = ("vol_20d", "drawdown_20d", "ret_20d", "vix_level", "vix_z_252d")
BLOCKS = f"""{FEATURES}, {dd("bdd", 0, 19)}, cf AS (SELECT *, row_number() OVER (ORDER BY rn) AS place FROM feat WHERE ret_60d IS NOT NULL AND vix_z_252d IS NOT NULL AND vix_change_20d IS NOT NULL), bl AS (SELECT * FROM (SELECT cf.rn AS block_id, place, count(*) OVER w AS n, sum(r) OVER w AS block_return, stddev_pop(r) OVER w * {_A} AS block_vol_ann, v AS block_max_dd, min(r) OVER w AS block_worst_1d, {", ".join(_REG)}
 FROM cf LEFT JOIN bdd ON bdd.rn = cf.rn WINDOW w AS (ORDER BY cf.rn ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) WHERE n = 20 AND place > 60 AND {" AND ".join(f"{c} IS NOT NULL" for c in _REG)})"""
WEIGHTS = (
    BLOCKS + ", st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _REG) + ", quantile_cont(block_vol_ann, 0.95) AS hi, quantile_cont(block_max_dd, 0.05) AS low FROM bl), "
    + "now AS (SELECT " + ", ".join(f"max_by({c}, rn) AS v_{c}" for c in _REG) + " FROM feat WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _REG) + "), "
    + "w1 AS (SELECT block_id, sqrt(" + " + ".join(f"pow(({c} - v_{c})/s_{c}, 2)" for c in _REG) + ") AS regime_distance, round(block_vol_ann, 9) >= round(hi, 9) OR round(block_max_dd, 9) <= round(low, 9) AS is_crisis_block FROM bl CROSS JOIN st CROSS JOIN now), "
    + "w2 AS (SELECT *, exp(-0.5*pow(regime_distance, 2)) AS regime_weight FROM w1), w3 AS (SELECT *, regime_weight*CASE WHEN is_crisis_block THEN 2.0 ELSE 1.0 END AS w FROM w2), "
    + "weights AS (SELECT block_id, regime_distance, regime_weight, is_crisis_block, w/sum(w) OVER () AS final_sample_weight FROM w3)"
)
EVT = f"""{RET}, q AS (SELECT quantile_cont(-r, 0.95) AS q1, quantile_cont(-r, 0.90) AS q2 FROM ret),
u AS (SELECT CASE WHEN count(*) FILTER (-r > q1) < 20 THEN any_value(q2) ELSE any_value(q1) END AS threshold FROM ret CROSS JOIN q),
ex AS (SELECT rn, threshold, -r - threshold AS excess FROM ret CROSS JOIN u WHERE -r > threshold)"""
FIT = """ei AS (SELECT *, row_number() OVER (ORDER BY excess, rn) AS i, count(*) OVER () AS n FROM ex), b AS (SELECT threshold, n, avg(excess) AS b0, avg((1 - (i - 0.35)/n)*excess) AS b1 FROM ei GROUP BY ALL),
fit AS (SELECT threshold, n, 2 - b0/(b0 - 2*b1) AS xi, 2*b0*b1/(b0 - 2*b1) AS sigma FROM b)"""
_TAIL = "CASE WHEN abs(xi) < 1e-9 THEN -sigma*ln(1 - z) ELSE sigma/xi*(pow(1 - z, -xi) - 1) END"
#: Every simulation's block by its draw, and the block's steps.
BOOT = f"""{WEIGHTS}, bi AS (SELECT block_id, coalesce(lag(c) OVER (ORDER BY block_id), 0) AS lo, CASE WHEN lead(c) OVER (ORDER BY block_id) IS NULL THEN 1 ELSE c END AS hi FROM (SELECT block_id, sum(final_sample_weight) OVER (ORDER BY block_id) AS c FROM weights)),
sm AS (SELECT o_orderkey AS sim_id, 0 AS zero FROM orders), su AS ({uniform_sql("sm", BLOCK_DRAWS, "sim_id", "zero")}), drawn AS (SELECT sim_id, block_id FROM su JOIN bi ON u >= lo AND u < hi),
boot AS (SELECT sim_id, block_id, rn - block_id AS step, r FROM drawn JOIN ret ON rn >= block_id AND rn < block_id + 20)"""


def corrected(source: str) -> str:
    """CTEs up to corrected (sim_id, step, r), given fit."""
    return f"""kc AS (SELECT quantile_cont(-r, 0.99) AS cut FROM {source}), wz AS (SELECT sim_id, step, r FROM {source} CROSS JOIN kc WHERE -r >= cut), wu AS ({uniform_sql("wz", TAILS, "sim_id", "step", "z")}),
corrected AS (SELECT sim_id, step, r FROM {source} CROSS JOIN kc WHERE -r < cut UNION ALL SELECT sim_id, step, -(threshold + {_TAIL}) FROM wu CROSS JOIN fit)"""


FORECAST = "fc AS (SELECT event_id, least(value/500, 1) AS p, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events)"
REL = FORECAST + ", rel AS (SELECT CAST(floor(p*10) AS BIGINT) AS bin, avg(p) AS mean_predicted, avg(y) AS mean_realised, count(*) AS n_obs FROM fc WHERE floor(p*10) BETWEEN 0 AND 9 GROUP BY 1)"


def cols(names: str | tuple[str, ...], n: int = 6) -> str:
    return ", ".join(f"{r(c, n)} AS {c}" for c in (names.split() if isinstance(names, str) else names))


_TIME = "mid - greatest(strike*exp(-0.045*t_years) - spot, 0)"
_HORIZONS, _LEVELS = (5, 20, 60), (5, 8, 10)
_LABELS = (
    f"WITH {RET}, v AS (SELECT rn, {roll('stddev_samp', 'r', 20)} AS v20 FROM ret), c AS (SELECT quantile_cont(v20, 0.95) AS cut FROM v), n AS (SELECT max(rn) AS n FROM ret), " + ", ".join(dd(f"f{h}", 0, h - 1) for h in _HORIZONS)
    + ", s AS (SELECT rn, r, " + ", ".join(f"stddev_pop(r) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) AS sd{h}" for h in _HORIZONS) + " FROM ret) SELECT s.rn, "
    + ", ".join(f"CASE WHEN s.rn <= n - {h} AND (f{h}.v <= -0.08 OR sd{h} >= cut) THEN 1 ELSE 0 END AS stress_{h}d, " + ", ".join(f"CASE WHEN s.rn <= n - {h} AND f{h}.v <= -{x / 100} THEN 1 ELSE 0 END AS dd_{x}pct_{h}d" for x in _LEVELS) for h in _HORIZONS)
    + " FROM s CROSS JOIN c CROSS JOIN n " + " ".join(f"LEFT JOIN f{h} ON f{h}.rn = s.rn" for h in _HORIZONS)
)
_SUMMARY = """SELECT count(*) AS n_options, {0}, coalesce(max_by(interpretation, struct_pack(a := tail_score, b := -contract_id)), 'NO_DATA') AS top_interpretation, max_by(confidence, struct_pack(a := tail_score, b := -contract_id)) AS top_confidence,
 count(*) FILTER (interpretation LIKE 'MODEL%') AS n_more, count(*) FILTER (interpretation LIKE 'OPTIONS%') AS n_less, count(*) FILTER (interpretation LIKE 'NO%') AS n_none, {1} FROM scored""".format(
    ", ".join(f"{r(f'max_by({c}, struct_pack(a := tail_score, b := -contract_id))')} AS {n}" for c, n in (("strike", "top_strike"), ("moneyness", "top_moneyness"), ("physical_prob_itm", "top_physical_prob"), ("risk_neutral_prob_itm", "top_risk_neutral_prob"), ("gap", "top_gap"))),
    f"{r('avg(gap)')} AS mean_gap, {r('max(abs(gap))')} AS max_abs_gap, {r('avg(liquidity_score)')} AS mean_liquidity_score",
)
_STATS = """WITH {m}, {e}, v AS (SELECT model, quantile_cont(-cum, 0.95) AS var_5pct, quantile_cont(-cum, 0.99) AS var_1pct FROM per GROUP BY 1) SELECT model, {p}, {v}, {q} FROM per JOIN v USING (model) GROUP BY model""".format(
    m=MODEL, e=each("models", "model, sim_id"),
    p=", ".join(f"{r(f'avg(CASE WHEN max_dd <= -{x / 100} THEN 1.0 ELSE 0.0 END)')} AS p_drawdown_{x}pct" for x in _LEVELS),
    v=", ".join(f"{r(f'any_value(var_{k})')} AS var_{k}, {r(f'avg(-cum) FILTER (round(-cum, 9) >= round(var_{k}, 9))')} AS es_{k}" for k in ("5pct", "1pct")),
    q=", ".join(f"{r(f'quantile_cont({c}, {p})')} AS {n}" for c, p, n in (("cum", 0.5, "median_return"), ("cum", 0.05, "p05_return"), ("cum", 0.01, "p01_return"), ("max_dd", 0.5, "median_max_dd"), ("max_dd", 0.05, "p05_max_dd"), ("max_dd", 0.01, "p01_max_dd"))) + f", {r('avg(vol)')} AS mean_vol",
)
_LL = "({z}*ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12)) + {o}*ln(least(greatest({p}, 1e-12), 1 - 1e-12)))"


def ll(z: str, o: str, p: str) -> str:
    return _LL.format(z=f"({z})", o=f"({o})", p=f"({p})")


_BACKTEST = f"""WITH {MODEL}, al AS (SELECT unnest([0.20, 0.10, 0.05, 0.025, 0.01, 0.005]::DOUBLE[]) AS alpha),
v AS (SELECT model, alpha, CASE alpha {" ".join(f"WHEN {a} THEN quantile_cont(-r, {1 - a!r})" for a in (0.20, 0.10, 0.05, 0.025, 0.01, 0.005))} END AS var_model FROM models CROSS JOIN al GROUP BY 1, 2),
e AS (SELECT model, alpha, avg(-r) AS es_model FROM models JOIN v USING (model) WHERE -r >= var_model GROUP BY 1, 2),
b AS (SELECT *, lag(b) OVER (PARTITION BY model, alpha ORDER BY rn) AS a FROM (SELECT model, alpha, rn, -r AS loss, var_model, CASE WHEN -r >= var_model THEN 1 ELSE 0 END AS b FROM ret CROSS JOIN v)),
g AS (SELECT model, alpha, any_value(var_model) AS var_model, count(*) AS n_obs, CAST(sum(b) AS BIGINT) AS n_breaches, avg(loss) FILTER (b = 1) AS realised_es, {", ".join(f"count(*) FILTER (a = {x} AND b = {y}) AS n{x}{y}" for x in (0, 1) for y in (0, 1))} FROM b GROUP BY 1, 2),
l AS (SELECT *, -2*({ll("n_obs - n_breaches", "n_breaches", "alpha")} - {ll("n_obs - n_breaches", "n_breaches", "n_breaches/n_obs")}) AS kupiec_lr,
 -2*({ll("n00 + n10", "n01 + n11", "(n01 + n11)/greatest(n00 + n01 + n10 + n11, 1e-12)")} - {ll("n00", "n01", "n01/greatest(n00 + n01, 1e-12)")} - {ll("n10", "n11", "n11/greatest(n10 + n11, 1e-12)")}) AS independence_lr FROM g JOIN e USING (model, alpha)),
z AS (SELECT *, sqrt(greatest(kupiec_lr, 0)) AS zk, sqrt(greatest(independence_lr, 0)) AS zi, CASE WHEN n_breaches >= 5 THEN realised_es/greatest(es_model, 1e-12) END AS es_severity_ratio FROM l),
t AS (SELECT *, 2*(1 - {phi("zk")}) AS kupiec_pval, 2*(1 - {phi("zi")}) AS independence_pval, exp(-greatest(kupiec_lr + independence_lr, 0)/2) AS conditional_cov_pval,
 CASE WHEN n_breaches < 5 THEN 'INSUFFICIENT_DATA' WHEN es_severity_ratio BETWEEN 0.7 AND 1.5 THEN 'PASS' WHEN es_severity_ratio BETWEEN 0.5 AND 2 THEN 'WARNING_MILD' ELSE 'FAIL' END AS es_verdict FROM z),
o AS (SELECT *, {", ".join(f"CASE WHEN n_obs < 30 THEN 'INSUFFICIENT_DATA' WHEN {k}_pval >= 0.05 THEN 'PASS' ELSE 'FAIL' END AS {k}_verdict" for k in ("kupiec", "independence", "conditional_cov"))} FROM t)
SELECT model, {cols("alpha var_model es_model realised_es es_severity_ratio kupiec_lr kupiec_pval independence_lr independence_pval conditional_cov_pval")}, n_obs, n_breaches, n00, n01, n10, n11, {r("n_breaches/(n_obs*alpha)")} AS obs_exp_ratio,
 kupiec_verdict, independence_verdict, conditional_cov_verdict, es_verdict, CASE WHEN k >= 3 THEN 'PASS' WHEN k = 2 THEN 'WARNING' ELSE 'FAIL' END AS overall_verdict
FROM (SELECT *, {" + ".join(f"CAST({k}_verdict = 'PASS' AS INTEGER)" for k in ("kupiec", "independence", "conditional_cov", "es"))} AS k FROM o)"""

ORACLE = {
    "src_price_panel": f"WITH {PANEL} SELECT CAST(dt AS VARCHAR) AS dt, ticker, {r('close')} AS close FROM panel",
    "log_return": f"WITH {PRET} SELECT CAST(dt AS VARCHAR) AS dt, ticker, {r('r')} AS r FROM pr",
    "null_ffill": f"WITH {RETV} SELECT rn, {r('vix_level')} AS vix_level FROM rv",
    "null_drop_any": f"WITH {PANEL} SELECT CAST(dt AS VARCHAR) AS dt, count(*) AS n FROM panel GROUP BY panel.dt HAVING count(*) = (SELECT count(DISTINCT ticker) FROM panel)",
    "align_index": f"WITH {RET}, {VIX} SELECT rn, {cols('r vix_level')} FROM ret JOIN vx USING (dt)",
    "train_test_split": f"WITH {RET} SELECT CASE WHEN rn <= (SELECT floor(count(*)*0.8) FROM ret) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM ret GROUP BY 1",
    "roll_ret": f"WITH {FEATURES} SELECT rn, {cols('ret_5d ret_10d ret_20d ret_60d')} FROM feat",
    "roll_vol": f"WITH {FEATURES} SELECT rn, {cols('vol_5d vol_10d vol_20d vol_60d')} FROM feat",
    "roll_drawdown": f"WITH {FEATURES} SELECT rn, {cols('drawdown_20d drawdown_60d')} FROM feat",
    "roll_drawdown_year": f"WITH {RET}, {dd('a', -251, 0)}, {dd('b', 1, 252)} SELECT ret.rn, {r('a.v')} AS drawdown_252d, {r('b.v')} AS drawdown_next_252d FROM ret LEFT JOIN a ON a.rn = ret.rn LEFT JOIN b ON b.rn = ret.rn",
    "vix_zscore": f"WITH {FEATURES} SELECT rn, {cols('vix_change_5d vix_change_20d vix_z_252d')} FROM feat",
    "loss_momentum": f"WITH {FEATURES} SELECT rn, {r('-ret_5d')} AS loss_5d, {r('-ret_20d')} AS loss_20d FROM feat",
    "market_features": f"WITH {FEATURES} SELECT rn, {cols('r vix_level ret_5d ret_10d ret_20d ret_60d vol_5d vol_10d vol_20d vol_60d drawdown_5d drawdown_10d drawdown_20d drawdown_60d vix_change_5d vix_change_20d vix_z_252d')}, {r('-ret_5d')} AS loss_5d, {r('-ret_20d')} AS loss_20d FROM feat WHERE ret_60d IS NOT NULL AND vix_z_252d IS NOT NULL AND vix_change_20d IS NOT NULL",
    "cross_asset_features": f"WITH {PRET}, j AS (SELECT a.ticker, b.ticker AS other, dt, a.r AS x, b.r AS y FROM pr a JOIN pr b USING (dt) WHERE a.ticker <> b.ticker), c AS (SELECT ticker, other, CAST(dt AS VARCHAR) AS dt, {roll('sum', 'y', 20, 'PARTITION BY ticker, other', 'j.dt')} AS ret_20d, {roll('stddev_samp', 'y', 20, 'PARTITION BY ticker, other', 'j.dt')} * {_A} AS vol_20d, CASE WHEN count(y) OVER w = 60 THEN corr(x, y) OVER w END AS corr_60d FROM j WINDOW w AS (PARTITION BY ticker, other ORDER BY j.dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) SELECT ticker, other, dt, {cols('ret_20d vol_20d corr_60d')} FROM c",
    "stress_label_matrix": _LABELS,
    "realised_drawdown": f"WITH {RET}, {dd('x', 1, 20)} SELECT rn, {r('v')} AS realised_max_dd FROM x",
    "window_features": f"WITH {WINDOW} SELECT start, {cols('cum_return realised_vol_ann max_drawdown worst_1d worst_5d vol_of_abs_returns')}, negative_days, tail_days FROM wf WHERE max_drawdown IS NOT NULL",
    "crisis_windows": f"WITH {WINDOW}, f AS (SELECT * FROM wf WHERE max_drawdown IS NOT NULL), k AS (SELECT quantile_cont(realised_vol_ann, 0.95) AS hi, quantile_cont(max_drawdown, 0.05) AS low FROM f) SELECT start, {cols('realised_vol_ann max_drawdown')} FROM f CROSS JOIN k WHERE round(realised_vol_ann, 9) >= round(hi, 9) OR round(max_drawdown, 9) <= round(low, 9)",
    "eval_dates": f"WITH {RET} SELECT rn FROM ret WHERE (rn - 505) % 21 = 0 AND rn > 504 AND rn <= (SELECT max(rn) FROM ret) - 20",
    "acf_returns": f"WITH {RET} SELECT CAST(lag AS BIGINT) AS lag, {r('corr(a.r, b.r)')} AS acf, {r('corr(a.r*a.r, b.r*b.r)')} AS acf_sq FROM (SELECT unnest([1, 2, 3, 4, 5]) AS lag) CROSS JOIN ret a JOIN ret b ON b.rn = a.rn + lag GROUP BY 1",
    "regime_lambda": f"WITH {FEATURES}, h AS (SELECT rn, round(vol_20d, 10) AS vol_20d, round(vix_level, 10) AS vix_level, round(drawdown_20d, 10) AS drawdown_20d, round(ret_20d, 10) AS ret_20d FROM feat WHERE ret_60d IS NOT NULL AND vix_z_252d IS NOT NULL AND vix_change_20d IS NOT NULL), p AS (SELECT rn, {', '.join(f'(2*rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) - 1)/2/count(*) OVER () AS p_{c}' for c in ('vol_20d', 'vix_level', 'drawdown_20d', 'ret_20d'))} FROM h), o AS (SELECT p_vol_20d AS vol_pct, p_vix_level AS vix_pct, 1 - p_drawdown_20d AS dd_stress, 1 - p_ret_20d AS ret_stress FROM p ORDER BY rn DESC LIMIT 1), s AS (SELECT *, 0.35*vol_pct + 0.30*vix_pct + 0.20*dd_stress + 0.15*ret_stress AS raw_score FROM o), l AS (SELECT *, 1/(1 + exp(-8*(raw_score - 0.6))) AS lambda_t FROM s) SELECT {cols('vol_pct vix_pct dd_stress ret_stress raw_score lambda_t')}, CASE WHEN lambda_t > 0.7 THEN 'crisis' WHEN lambda_t > 0.3 THEN 'fragile' ELSE 'calm' END AS regime FROM l",
    "regime_drift": f"WITH {FEATURES}, h AS (SELECT *, rn > max(rn) OVER () - 60 AS now FROM feat WHERE ret_60d IS NOT NULL AND vix_z_252d IS NOT NULL AND vix_change_20d IS NOT NULL), x AS (SELECT ({' + '.join(f'abs(avg({c}) FILTER (now) - quantile_cont({c}, 0.5) FILTER (NOT now))/(quantile_cont({c}, 0.75) FILTER (NOT now) - quantile_cont({c}, 0.25) FILTER (NOT now))' for c in ('vol_20d', 'vix_level', 'drawdown_20d'))})/3 AS drift FROM h) SELECT {r('drift')} AS drift, CASE WHEN drift < 1 THEN 'LOW' WHEN drift < 2.5 THEN 'MODERATE' ELSE 'HIGH' END AS status FROM x",
    "block_library": f"WITH {BLOCKS} SELECT block_id, {cols('block_return block_vol_ann block_max_dd block_worst_1d')}, {cols(_REG)} FROM bl",
    "block_weights": f"WITH {WEIGHTS} SELECT block_id, {cols('regime_distance regime_weight')}, is_crisis_block, {r('final_sample_weight*1000')} AS final_sample_weight FROM weights",
    "bootstrap_paths": f"WITH {BOOT} SELECT sim_id, block_id, step, {r('r')} AS r FROM boot",
    "evt_exceedances": f"WITH {EVT} SELECT rn, {cols('threshold excess')} FROM ex",
    "evt_fit_pwm": f"WITH {EVT}, {FIT} SELECT {cols('threshold xi sigma')}, n FROM fit",
    "evt_correct_paths": f"WITH {EVT}, {FIT}, {PATHS.removeprefix(RET + ', ')}, {corrected('paths')} SELECT sim_id, step, {r('r')} AS r FROM corrected",
    "path_drawdown": f"WITH {PATHS}, {each('paths', 'sim_id')} SELECT sim_id, {cols('cum max_dd')} FROM per",
    "path_stats": _STATS,
    "worst_paths": f"WITH {PATHS}, {each('paths', 'sim_id')} SELECT row_number() OVER (ORDER BY per.cum, sim_id) AS rank, sim_id, block_id, {r('per.cum')} AS cum, {cols('max_dd vol worst_1d worst_5d')}, negative_days FROM per JOIN draw USING (sim_id) ORDER BY per.cum, sim_id LIMIT 10",
    "path_histogram": f"WITH {PATHS}, {each('paths', 'sim_id')}, e AS (SELECT min(cum) AS lo, max(cum) AS hi FROM per) SELECT CAST(least(floor((cum - lo)/(hi - lo)*80), 79) AS BIGINT) AS bin, count(*) AS n FROM per CROSS JOIN e GROUP BY 1",
    "opt_put_chain": f"WITH {CHAIN} SELECT contract_id, open_interest, volume, {cols('spot strike t_years bid ask mid bid_ask moneyness bid_ask_pct')} FROM quoted",
    "put_liquidity_filter": f"WITH {CHAIN} SELECT contract_id FROM liquid",
    "opt_expiries": f"WITH {CHAIN}, x AS (SELECT DISTINCT t_years FROM chain) SELECT {r('t_years')} AS t_years, row_number() OVER (ORDER BY x.t_years) = 2 AS is_default FROM x",
    "rn_prob": f"WITH {CHAIN}, x AS (SELECT *, (ln(spot/strike) + 0.025*t_years)/(0.2*sqrt(t_years)) AS d2 FROM chain), y AS (SELECT *, -d2 AS a, -d2 - 0.2*sqrt(t_years) AS b FROM x) SELECT contract_id, {r(phi('a'))} AS rn_prob, {r(f'strike*exp(-0.045*t_years)*{phi(chr(97))} - spot*{phi(chr(98))}')} AS bs_put FROM y",
    "implied_vol": f"WITH RECURSIVE {IV} SELECT contract_id, CASE WHEN {_TIME} > 0.001 THEN {r('implied_vol', 5)} END AS implied_vol, {r('bs_price_from_iv', 5)} AS bs_price_from_iv FROM puts",
    "bs_metrics": f"WITH RECURSIVE {IV} SELECT contract_id, {', '.join(f'CASE WHEN {_TIME} > 0.01 THEN {r(c, 5)} END AS {c}' for c in ('risk_neutral_prob_itm', 'delta', 'vega_per_1pct'))}, {r('bs_price_from_iv', 5)} AS bs_price_from_iv FROM puts",
    "vol_surface": f"WITH RECURSIVE {IV}, x AS (SELECT min_by(implied_vol, struct_pack(a := abs(moneyness - 1), b := contract_id)) AS atm, avg(implied_vol) FILTER (moneyness <= 0.95) AS otm, count(*) AS n, min(moneyness) AS lo, max(moneyness) AS hi FROM puts) SELECT {r('atm')} AS atm_implied_vol, {r('otm')} AS otm_5pct_implied_vol, n AS n_liquid_puts, {r('lo')} AS min_moneyness, {r('hi')} AS max_moneyness, {r('otm - atm')} AS vol_skew_5pct FROM x",
    "physical_prob": f"WITH {CHAIN}, {PATHS}, {each('paths', 'sim_id')}, {PHYSICAL.format(source='liquid')} SELECT contract_id, {cols('physical_prob_itm physical_expected_payoff')} FROM phys",
    "disagreement": f"WITH RECURSIVE {SCORED} SELECT contract_id, {cols('gap liquidity_score tail_score')}, confidence, interpretation, {r('physical_expected_payoff - mid')} AS payoff_minus_mid, {r('CASE WHEN mid > 0 THEN physical_expected_payoff/mid END')} AS payoff_to_mid_ratio FROM scored",
    "disagreement_summary": f"WITH RECURSIVE {SCORED} {_SUMMARY}",
    "ks_wasserstein": f"WITH {MODEL}, n AS (SELECT DISTINCT model FROM models), bo AS (SELECT model, r, 1 AS a, 0 AS b FROM n CROSS JOIN ret UNION ALL SELECT model, r, 0, 1 FROM models), h AS (SELECT model, r, sum(a) AS a, sum(b) AS b FROM bo GROUP BY 1, 2), f AS (SELECT model, r, sum(a) OVER w/sum(a) OVER (PARTITION BY model) AS f, sum(b) OVER w/sum(b) OVER (PARTITION BY model) AS g, sum(a) OVER (PARTITION BY model) AS na, sum(b) OVER (PARTITION BY model) AS nb, lead(r) OVER w AS nx FROM h WINDOW w AS (PARTITION BY model ORDER BY r)), k AS (SELECT model, max(abs(f - g)) AS ks, sum(abs(f - g)*(nx - r)) AS w1, any_value(na) AS na, any_value(nb) AS nb FROM f GROUP BY 1), x AS (SELECT *, sqrt(na*nb/(na + nb))*ks AS x FROM k) SELECT model, {r('ks')} AS ks_stat, {r('greatest(0, least(1, 2*list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END)*exp(-2*k*k*x*x)))))')} AS ks_pval, {r('w1')} AS wasserstein FROM x",
    "moments": f"WITH {MODEL}, c AS (SELECT model, r, avg(r) OVER (PARTITION BY model) AS mu FROM models), x AS (SELECT model, any_value(mu) AS mu, avg(pow(r - mu, 2)) AS m2, avg(pow(r - mu, 3)) AS m3, avg(pow(r - mu, 4)) AS m4 FROM c GROUP BY 1) SELECT model, {r('mu')} AS mean, {r('sqrt(m2)')} AS sd, {r('m3/pow(m2, 1.5)')} AS skew, {r('m4/(m2*m2) - 3')} AS excess_kurtosis FROM x",
    "tail_mass_quantiles": f"WITH {MODEL}, c AS (SELECT quantile_cont(r, 0.005) AS cut FROM ret), rm AS (SELECT avg(CASE WHEN r <= cut THEN 1.0 ELSE 0.0 END) AS rm FROM ret CROSS JOIN c) SELECT model, {r('avg(CASE WHEN r <= cut THEN 1.0 ELSE 0.0 END)/nullif(any_value(rm), 0)')} AS tail_mass_ratio, {r('(' + ' + '.join(f'abs(quantile_cont(r, {p}) - (SELECT quantile_cont(r, {p}) FROM ret))' for p in QUANTILES) + f')/{len(QUANTILES)}')} AS mean_quantile_error FROM models CROSS JOIN c CROSS JOIN rm GROUP BY model",
    "var_backtest_multi": _BACKTEST,
    "reliability": f"WITH {REL} SELECT bin, {cols('mean_predicted mean_realised')}, n_obs FROM rel",
    "calibration_metrics": f"WITH {REL}, o AS (SELECT count(*) AS n_eval, avg(y) AS b, avg(pow(p - y, 2)) AS brier, count(*) FILTER (p >= 0.15 AND y = 1) AS tp, count(*) FILTER (p >= 0.15 AND y = 0) AS fp, count(*) FILTER (p < 0.15 AND y = 0) AS tn, count(*) FILTER (p < 0.15 AND y = 1) AS fn FROM fc), e AS (SELECT sum(n_obs*abs(mean_predicted - mean_realised)) AS g FROM rel), x AS (SELECT *, g/n_eval AS ece, tp/greatest(tp + fn, 1) AS recall, tp/greatest(tp + fp, 1) AS prec, fp/greatest(fp + tn, 1) AS far FROM o CROSS JOIN e) SELECT n_eval, tp, fp, tn, fn, {r('b')} AS base_rate, {cols('brier ece recall')}, {r('prec')} AS precision, {r('far')} AS false_alarm_rate, {r('1 - brier/nullif(b*(1 - b), 0)')} AS brier_skill, {r('2*recall*prec/greatest(recall + prec, 1e-12)')} AS f1, CASE WHEN ece < 0.05 THEN 'WELL_CALIBRATED' WHEN ece < 0.1 THEN 'MODERATE_CALIBRATION' ELSE 'POORLY_CALIBRATED' END AS verdict FROM x",
    "monitor_tail": f"SELECT ticker, run_timestamp, {r('value')} AS value FROM (SELECT event_type AS ticker, event_id AS run_timestamp, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 10",
    "json_safe": f"SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE {r('value')} END AS v FROM events",
    "breach_transitions": f"WITH {RET}, q AS (SELECT quantile_cont(-r, 0.95) AS q FROM ret), b AS (SELECT *, lag(b) OVER (ORDER BY rn) AS a FROM (SELECT rn, CASE WHEN -r >= q THEN 1 ELSE 0 END AS b FROM ret CROSS JOIN q)) SELECT {', '.join(f'count(*) FILTER (a = {x} AND b = {y}) AS n{x}{y}' for x in (0, 1) for y in (0, 1))} FROM b",
}
