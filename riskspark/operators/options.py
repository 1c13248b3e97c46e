"""Option chains: liquidity, implied volatility, risk-neutral and scenario probabilities, disagreement scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, RiskConfig
from ..functions.columns import bs_put, implied_vol, normal_cdf, normal_pdf
from ..functions.quantiles import quantiles
from ..functions.running import running
from ..store import written
from .scenarios import weight


def with_spot(chain: DataFrame, spots: DataFrame) -> DataFrame:
    """Adds spot to a chain of ticker, last_price and more: the ticker's price in spots (ticker, spot), else the median last price of its contracts."""
    median = quantiles(chain, F.col("last_price"), (0.5,), ("ticker",)).select("ticker", F.col("q")[0].alias("_median"))
    d = chain.join(spots.select("ticker", F.col("spot").alias("_spot")), "ticker", "left").join(median, "ticker", "left")
    return d.withColumn("spot", F.coalesce("_spot", "_median")).drop("_spot", "_median")


def quoted(chain: DataFrame) -> DataFrame:
    """Adds mid, bid_ask, moneyness and bid_ask_pct (null where mid is not positive)."""
    d = chain.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("bid_ask", F.col("ask") - F.col("bid")).withColumn("moneyness", F.col("strike") / F.col("spot"))
    return d.withColumn("bid_ask_pct", F.when(F.col("mid") > 0, F.col("bid_ask") / F.col("mid")))


def liquid(chain: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    c = F.col
    return chain.where((c("mid") >= config.min_mid) & (c("bid") > 0) & (c("ask") > 0) & (c("ask") >= c("bid")) & (F.round(c("bid_ask_pct"), 9) <= config.max_spread) & (F.coalesce(c("open_interest"), F.lit(0)) >= config.min_open_interest))


def bs_metrics(chain: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    """Adds implied_vol, risk_neutral_prob_itm, delta, vega_per_1pct and the price from implied_vol; unsolved rows go."""
    s, k, t, r, v = F.col("spot"), F.col("strike"), F.col("t_years"), F.lit(config.risk_free), F.col("implied_vol")
    # a row of one value: the condition on it stays above, where it does not solve for the volatility once more
    d = chain.select("*", F.explode_outer(F.array(implied_vol(F.col("mid"), s, k, t, r))).alias("implied_vol")).where("implied_vol is not null")
    d = d.withColumn("d1", (F.ln(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t)))
    return d.select("*", normal_cdf(v * F.sqrt(t) - F.col("d1")).alias("risk_neutral_prob_itm"), (normal_cdf(F.col("d1")) - 1).alias("delta"), (s * normal_pdf(F.col("d1")) * F.sqrt(t) * 0.01).alias("vega_per_1pct"), bs_put(s, k, t, r, v).alias("bs_price_from_iv")).drop("d1")


def vol_surface(chain: DataFrame) -> DataFrame:
    near = F.struct(F.abs(F.col("moneyness") - 1), "contract_id")
    d = chain.agg(F.min_by("implied_vol", near).alias("atm_implied_vol"), F.avg(F.when(F.col("moneyness") <= 0.95, F.col("implied_vol"))).alias("otm_5pct_implied_vol"), F.count("*").alias("n_liquid_puts"), F.min("moneyness").alias("min_moneyness"), F.max("moneyness").alias("max_moneyness"))
    return d.withColumn("vol_skew_5pct", F.col("otm_5pct_implied_vol") - F.col("atm_implied_vol"))


def physical(chain: DataFrame, each: DataFrame) -> DataFrame:
    """Adds physical_prob_itm and physical_expected_payoff per strike, from the paths' returns cum (of n simulations each).

    A sorted merge: terminal prices, counted and summed per distinct price before the shuffle, and distinct strikes become one
    table of values, and running sums over its ranges answer every strike. No strike meets a path, and no row or task holds all
    strikes. A chain with several spots, so with several underlyings, is refused.
    """
    single = F.when(F.min("spot") == F.max("spot"), F.min("spot")).when(F.count("spot") > 0, F.raise_error(F.lit("a chain of one underlying is wanted: its spots differ")).cast("double"))
    spot = chain.agg(single.alias("spot"))
    n = weight(each)
    prices = each.select("cum", n.alias("n")).groupBy("cum").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(spot)).select((F.col("spot") * F.exp("cum")).alias("v"), "n")  # one row
    points = prices.select("v", "n", (F.col("v") * F.col("n")).alias("total"), F.lit(0).alias("strike"))
    strikes = chain.select(F.col("strike").alias("v")).distinct().select("v", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(1).alias("strike"))
    merged = points.unionByName(strikes).where("v is not null").groupBy("v").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("strike").alias("strike"))
    merged = written(merged, "merged")
    paths = merged.agg(F.sum("n").alias("paths"))
    d = running(merged, "v", ("n", "total")).where("strike = 1").crossJoin(F.broadcast(paths))  # one row
    below, total = F.col("upto_n") - F.col("n"), F.col("upto_total") - F.col("total")
    d = d.select(F.col("v").alias("strike"), (below / F.col("paths")).alias("physical_prob_itm"), ((F.col("v") * below - total) / F.col("paths")).alias("physical_expected_payoff"))
    return chain.join(d, "strike")


def scored(chain: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    """Adds the probability gap, payoff against mid, liquidity, confidence, score and interpretation. chain is read several times: write it first."""
    n = chain.agg(F.count("*").alias("n_rows"))

    def ranked(d: DataFrame, c: str) -> DataFrame:
        """Adds rank_c, the average rank's share, from the running counts of the distinct values."""
        value = F.coalesce(F.col(c), F.lit(0))
        counts = written(chain.groupBy(value.alias(f"value_{c}")).agg(F.count("*").alias("k")), "ranks")
        counts = running(counts, f"value_{c}", ("k",)).select(f"value_{c}", ((2 * F.col("upto_k") - F.col("k") + 1) / 2).alias(f"rank_{c}"))
        return d.withColumn(f"value_{c}", value).join(counts, f"value_{c}").drop(f"value_{c}").withColumn(f"rank_{c}", F.col(f"rank_{c}") / F.col("n_rows"))

    d = ranked(ranked(chain.crossJoin(F.broadcast(n)), "open_interest"), "volume").withColumn("gap", F.col("physical_prob_itm") - F.col("risk_neutral_prob_itm"))  # one row
    d = d.withColumn("payoff_minus_mid", F.col("physical_expected_payoff") - F.col("mid")).withColumn("payoff_to_mid_ratio", F.when(F.col("mid") > 0, F.col("physical_expected_payoff") / F.col("mid")))
    d = d.withColumn("liquidity_score", (0.6 * F.col("rank_open_interest") + 0.4 * F.col("rank_volume")) / (1 + 10 * F.coalesce("bid_ask_pct", F.lit(1.0))))
    d = d.withColumn("confidence", F.when(F.col("liquidity_score") <= 0.33, "LOW").when(F.col("liquidity_score") <= 0.66, "MEDIUM").when(F.col("liquidity_score").isNotNull(), "HIGH"))
    d = d.withColumn("tail_score", F.abs("gap") * F.col("liquidity_score") * F.sqrt(F.greatest(F.coalesce("open_interest", F.lit(0)), F.lit(1))))
    side = F.when(F.col("gap") >= config.min_gap, "MODEL_SEES_MORE_DOWNSIDE_THAN_OPTIONS").when(F.col("gap") <= -config.min_gap, "OPTIONS_PRICE_MORE_DOWNSIDE_THAN_MODEL").otherwise("NO_MATERIAL_DISAGREEMENT")
    return d.withColumn("interpretation", side).drop("n_rows", "rank_open_interest", "rank_volume")


def summary(d: DataFrame) -> DataFrame:
    top = F.struct(F.col("tail_score"), (-F.col("contract_id")).alias("k"))
    n = lambda v: F.sum((F.col("interpretation") == v).cast("long"))
    return d.agg(
        F.count("*").alias("n_options"), F.max_by("strike", top).alias("top_strike"), F.max_by("moneyness", top).alias("top_moneyness"), F.max_by("physical_prob_itm", top).alias("top_physical_prob"), F.max_by("risk_neutral_prob_itm", top).alias("top_risk_neutral_prob"),
        F.max_by("gap", top).alias("top_gap"), F.coalesce(F.max_by("interpretation", top), F.lit("NO_DATA")).alias("top_interpretation"), F.max_by("confidence", top).alias("top_confidence"),
        n("MODEL_SEES_MORE_DOWNSIDE_THAN_OPTIONS").alias("n_more"), n("OPTIONS_PRICE_MORE_DOWNSIDE_THAN_MODEL").alias("n_less"), n("NO_MATERIAL_DISAGREEMENT").alias("n_none"),
        F.avg("gap").alias("mean_gap"), F.max(F.abs("gap")).alias("max_abs_gap"), F.avg("liquidity_score").alias("mean_liquidity_score"),
    )


def tighter(chain: DataFrame, min_open_interest: int = 250, max_spread: float = 0.10) -> DataFrame:
    """A second filter on top of liquid()."""
    return chain.where((F.coalesce("open_interest", F.lit(0)) >= min_open_interest) & (F.round("bid_ask_pct", 9) <= max_spread))


def spot(prices: DataFrame, days: int = 5) -> DataFrame:
    """ticker, spot: the last close among each ticker's last rows that is not null."""
    w = Window.partitionBy("ticker").orderBy(F.col("dt").desc())
    d = prices.withColumn("back", F.row_number().over(w)).where((F.col("back") <= days) & F.col("close").isNotNull())
    return d.groupBy("ticker").agg(F.max_by("close", "dt").alias("spot"))


def historical_context(scored_chain: DataFrame, ret: DataFrame) -> DataFrame:
    """Adds the historical 95 % loss, how many days went beyond it, and whether a strike's probability exceeds the share of losses above the median probability."""
    loss = ret.select((-F.col("r")).alias("loss"))
    one = loss.agg(F.percentile("loss", F.lit(0.95)).alias("hist_tail_threshold")).crossJoin(scored_chain.agg(F.percentile("physical_prob_itm", F.lit(0.5)).alias("mid_prob")))
    n = lambda c: F.sum((F.col("loss") > F.col(c)).cast("long"))
    one = loss.crossJoin(F.broadcast(one)).agg(F.first("hist_tail_threshold").alias("hist_tail_threshold"), n("hist_tail_threshold").alias("hist_crisis_episode_n"), (n("mid_prob") / F.count("*")).alias("share"))
    d = scored_chain.crossJoin(F.broadcast(one))  # one row
    return d.withColumn("model_exceeds_hist_95pct", F.col("physical_prob_itm") > F.col("share")).drop("share")


def by_strike(scored_chain: DataFrame) -> DataFrame:
    """A chart's table of both probabilities per contract, in the order of strikes: contract_id, strike, moneyness, the probabilities, gap, mid."""
    return scored_chain.select("contract_id", "strike", "moneyness", "physical_prob_itm", "risk_neutral_prob_itm", "gap", "mid").orderBy("strike", "contract_id")


def top(scored_chain: DataFrame, n: int = 20) -> DataFrame:
    """The n rows of the highest score, ties to the lower contract_id."""
    return scored_chain.orderBy(F.col("tail_score").desc(), "contract_id").limit(n)
