"""Option chains: (quote_date, expiration, strike, right, bid, ask, created)."""

from __future__ import annotations

from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType



_erf = np.vectorize(erf, otypes=[float])


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / np.sqrt(2)))


def black_price(is_call: np.ndarray, forward: np.ndarray, strike: np.ndarray, t: np.ndarray, vol: np.ndarray) -> np.ndarray:
    """Undiscounted Black price; intrinsic where time or volatility is nil."""
    s = vol * np.sqrt(t)
    with np.errstate(divide="ignore", invalid="ignore"):
        d1 = np.log(forward / strike) / s + s / 2
        call = forward * normal_cdf(d1) - strike * normal_cdf(d1 - s)
    call = np.where(s > 0, call, np.maximum(forward - strike, 0))
    return np.where(is_call, call, call - forward + strike)


def implied_vol(price: np.ndarray, is_call: np.ndarray, forward: np.ndarray, strike: np.ndarray, t: np.ndarray, low: float = 1e-4, high: float = 5.0, tol: float = 1e-6, steps: int = 100) -> np.ndarray:
    """Volatility by bisection of all rows together; NaN where the price is out of reach."""
    price, forward, strike, t = (np.asarray(x, float) for x in (price, forward, strike, t))
    lo, hi = np.full(price.shape, low), np.full(price.shape, high)
    ok = (forward > 0) & (strike > 0) & (t > 0) & (price >= black_price(is_call, forward, strike, t, lo)) & (price <= black_price(is_call, forward, strike, t, hi))
    for _ in range(steps):
        mid = (lo + hi) / 2
        below = black_price(is_call, forward, strike, t, mid) < price
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        if (hi - lo).max(initial=0) < tol:
            break
    return np.where(ok, (lo + hi) / 2, np.nan)


@pandas_udf(DoubleType())
def normal_cdf_udf(x: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(x.to_numpy()))


@pandas_udf(DoubleType())
def implied_vol_udf(price: pd.Series, is_call: pd.Series, forward: pd.Series, strike: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series(implied_vol(price, is_call.to_numpy(bool), forward, strike, t)).where(lambda v: v.notna(), None)


def paired_mids(chain: DataFrame) -> DataFrame:
    """(quote_date, expiration, strike, call_mid, put_mid): last live quote of each leg, both legs there."""
    live = chain.where((F.col("bid") > 0) & (F.col("ask") > F.col("bid")))
    key = ["quote_date", "expiration", "strike"]
    mid = lambda r: F.max_by(F.when(F.col("right") == r, (F.col("bid") + F.col("ask")) / 2), F.when(F.col("right") == r, F.col("created")))
    return live.groupBy(*key).agg(mid("C").alias("call_mid"), mid("P").alias("put_mid")).dropna(subset=["call_mid", "put_mid"])


def parity_spot(pairs: DataFrame) -> DataFrame:
    """(quote_date, expiration, spot): strike + call - put where the legs are closest, the lower strike on a tie."""
    gap = F.abs(F.col("call_mid") - F.col("put_mid"))
    spot = F.col("strike") + F.col("call_mid") - F.col("put_mid")
    return pairs.groupBy("quote_date", "expiration").agg(F.min_by(spot, F.struct(gap, "strike")).alias("spot"))


def atm_iv(chain: DataFrame, target: int = 37, tolerance: int = 9, rate: float = 0.04) -> DataFrame:
    """(quote_date, expiration, strike, spot, iv): expiry nearest the target days (ties later), strike nearest the implied spot, mean of both legs' volatilities in (0, 3)."""
    pairs = paired_mids(chain).withColumn("dte", F.datediff("expiration", "quote_date"))
    pairs = pairs.where(F.abs(F.col("dte") - target) <= tolerance)
    w = Window.partitionBy("quote_date")
    best = F.min_by("expiration", F.struct(F.abs(F.col("dte") - target), -F.col("dte"))).over(w)
    pairs = pairs.withColumn("_e", best).where(F.col("expiration") == F.col("_e")).drop("_e")
    j = pairs.join(parity_spot(pairs), ["quote_date", "expiration"]).where("spot > 0")
    at = j.groupBy("quote_date").agg(F.min_by(F.struct("expiration", "strike", "spot", "dte", "call_mid", "put_mid"), F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")).alias("r")).select("quote_date", "r.*")
    t = F.col("dte") / 365.0
    grow = F.exp(rate * t)
    leg = lambda mid, call: implied_vol_udf(F.col(mid) * grow, F.lit(call), F.col("spot"), F.col("strike"), t)
    ok = lambda v: F.when((v > 0) & (v < 3), v)
    at = at.withColumn("_c", leg("call_mid", True)).withColumn("_p", leg("put_mid", False))
    n = ok(F.col("_c")).isNotNull().cast("int") + ok(F.col("_p")).isNotNull().cast("int")
    iv = (F.coalesce(ok(F.col("_c")), F.lit(0.0)) + F.coalesce(ok(F.col("_p")), F.lit(0.0))) / F.nullif(n, F.lit(0))
    return at.select("quote_date", "expiration", "strike", "spot", iv.alias("iv"))


def chance_above(spot: Column, strike: Column, vol: Column, years: Column, slope: Column) -> Column:
    """Implied chance of ending above the strike, with the smile's slope: N(d2) - vega * dvol/dstrike."""
    s = vol * F.sqrt(years)
    d2 = F.ln(spot / strike) / s - s / 2
    vega = spot * F.sqrt(years) * F.exp(-F.pow(d2 + s, F.lit(2.0)) / 2) / F.sqrt(F.lit(2 * np.pi))
    return normal_cdf_udf(d2) - vega * slope


def interpolate(points: DataFrame, grid: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """grid (key, x) with y between the points around it; flat beyond the ends."""
    p = points.select(key, F.col(x).alias("_x"), F.lit(0).alias("_s"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("_p"))
    g = grid.select(key, F.col(x).alias("_x"), F.lit(1).alias("_s"))
    both = g.unionByName(p, allowMissingColumns=True)
    lo = F.last("_p", ignorenulls=True).over(Window.partitionBy(key).orderBy("_x", "_s").rowsBetween(Window.unboundedPreceding, 0))
    hi = F.last("_p", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("_x"), "_s").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("a", lo).withColumn("b", hi).where("_s = 1")
    step = (F.col("_x") - F.col("a.x")) / F.nullif(F.col("b.x") - F.col("a.x"), F.lit(0.0))
    value = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | step.isNull(), F.col("a.y")).otherwise(F.col("a.y") + step * (F.col("b.y") - F.col("a.y")))
    return rows.select(key, F.col("_x").alias(x), value.alias(y))
