"""Column expressions that Catalyst runs without Python, but for implied_vol(), which NumPy takes a batch of rows at a time."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal distribution (Hart 1968, double precision).
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    def of(v: Column) -> Column:
        a = F.abs(v)
        e = F.exp(-a * a / 2)
        tail = F.when(a < 7.07106781186547, e * _horner(a, NUMERATOR) / _horner(a, DENOMINATOR)).otherwise(e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631)
        return F.when(v > 0, 1 - tail).otherwise(tail)

    return let(x, of)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def chi2_tail(x: Column, df: int) -> Column:
    """P(X >= x) for one or two degrees of freedom."""
    x = F.greatest(x, F.lit(0.0))
    return 2 * (1 - normal_cdf(F.sqrt(x))) if df == 1 else F.exp(-x / 2)


def r6(c: Column) -> Column:
    """Rounded for output; never minus zero."""
    return F.round(c, 6) + F.lit(0.0)


def at_least(c: Column | str, cut: Column | str) -> Column:
    """c >= cut at nine places, so that values which differ by rounding alone are ties."""
    return F.round(c, 9) >= F.round(cut, 9)


def over(before: int, after: int = 0, by: str = "series", order: str = "rn") -> Window:
    return Window.partitionBy(by).orderBy(order).rowsBetween(-before, after)


def rolling(fn: Callable[[Column], Column], c: Column, w: int, by: str = "series", order: str = "rn") -> Column:
    """Null until w rows are there."""
    win = over(w - 1, 0, by, order)
    return F.when(F.count(c).over(win) == w, fn(c).over(win))


def ahead(fn: Callable[[Column], Column], c: Column, first: int, last: int) -> Column:
    win = over(-first, last)
    return F.when(F.count(c).over(win) == last - first + 1, fn(c).over(win))


def drawdown(steps: Column) -> Column:
    """Largest fall of the running sum below its running peak; the peak starts at the first step."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(float("-inf")).alias("p"), F.lit(0.0).alias("m"))

    def step(s: Column, x: Column) -> Column:
        c = s["c"] + x
        p = F.greatest(s["p"], c)
        return F.struct(c.alias("c"), p.alias("p"), F.least(s["m"], c - p).alias("m"))

    return F.aggregate(steps, start, step, lambda s: s["m"])


def bs_put(s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    """Black-Scholes put; v must be positive."""
    return let(v * F.sqrt(t), lambda w: let((F.ln(s / k) + r * t) / w + w / 2, lambda d1: k * F.exp(-r * t) * normal_cdf(w - d1) - s * normal_cdf(-d1)))


def implied_vol(price: Column, s: Column, k: Column, t: Column, r: Column, steps: int = 60) -> Column:
    """Volatility in (1e-5, 8) by bisection; null where the price is not above 99.9 % of the discounted intrinsic value or is not bracketed."""
    solve = F.pandas_udf(lambda *a: pd.Series(bisected(*(x.to_numpy("float64", na_value=np.nan) for x in a), steps)), "double")
    return solve(*[c.cast("double") for c in (price, s, k, t, r)])


def bisected(price: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, r: np.ndarray, steps: int) -> np.ndarray:
    """implied_vol() of many rows at once, in the arithmetic of bs_put() and normal_cdf(); NaN for null."""
    with np.errstate(all="ignore"):
        root_t, ahead, paid = np.sqrt(t), np.log(s / k) + r * t, k * np.exp(-r * t)

        def cdf(x: np.ndarray) -> np.ndarray:
            a = np.abs(x)
            e = np.exp(-a * a / 2)
            tail = np.where(a < 7.07106781186547, e * np.polyval(NUMERATOR, a) / np.polyval(DENOMINATOR, a), e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631)
            return np.where(x > 0, 1 - tail, tail)

        def put(v: np.ndarray | float) -> np.ndarray:
            w = v * root_t
            d1 = ahead / w + w / 2
            return paid * cdf(w - d1) - s * cdf(-d1)

        inside = (price > 0.999 * np.maximum(paid - s, 0.0)) & (put(1e-5) < price) & (put(8.0) > price)
        lo, hi = np.full(price.shape, 1e-5), np.full(price.shape, 8.0)
        for _ in range(steps):
            mid = (lo + hi) / 2
            low = put(mid) < price
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        return np.where(inside, (lo + hi) / 2, np.nan)


def log_likelihood(zeros: Column, ones: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return zeros * F.ln(1 - p) + ones * F.ln(p)


def bs_call(s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    """Black-Scholes call; v must be positive."""
    return let(v * F.sqrt(t), lambda w: let((F.ln(s / k) + r * t) / w + w / 2, lambda d1: s * normal_cdf(d1) - k * F.exp(-r * t) * normal_cdf(d1 - w)))


def bs_price(s: Column, k: Column, t: Column, r: Column, v: Column, call: bool = False) -> Column:
    """The price, or the intrinsic value where time or volatility is not positive."""
    done = (t <= 0) | (v <= 0)
    t, v = F.when(done, 1.0).otherwise(t), F.when(done, 1.0).otherwise(v)
    return F.when(done, F.greatest(s - k if call else k - s, F.lit(0.0))).otherwise((bs_call if call else bs_put)(s, k, t, r, v))
