"""Looks at event studies and books: halves, paired differences, placebos, fee tiers, decisions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def curve(real: DataFrame, control: DataFrame) -> DataFrame:
    """(k, real, control, excess, n) of paired curves (event_id, k, car)."""
    c = control.select("event_id", "k", F.col("car").alias("_c"))
    return real.join(c, ["event_id", "k"]).groupBy("k").agg(F.avg("car").alias("real"), F.avg("_c").alias("control"), F.avg(F.col("car") - F.col("_c")).alias("excess"), F.count(F.lit(1)).alias("n"))


def paired(real: DataFrame, control: DataFrame, lags: int = 5) -> dict:
    """Mean and Newey-West t of paired differences in entry order; (event_id, entry_date, car) each. One number per event reaches the driver."""
    c = control.select("event_id", F.col("car").alias("_c"))
    d = real.join(c, "event_id").orderBy("entry_date", "event_id").select((F.col("car") - F.col("_c")).alias("d")).toPandas()["d"]
    return {"n": len(d), "mean": float(d.mean()) if len(d) else None, "t": stats.hac_t(d.to_numpy(), lags) if len(d) else None}


def halves(series: DataFrame, lags: int = 32) -> dict[str, dict]:
    """Mean and HAC t of a daily series (date, ret): all of it, and up to and after its middle date."""
    rows = series.orderBy("date").select("date", "ret").toPandas()  # one row per day
    cut = len(rows) // 2
    look = lambda x: {"n": len(x), "mean": float(x.mean()) if len(x) else None, "t": stats.hac_t(x.to_numpy(), lags) if len(x) else None}
    return {"full": look(rows["ret"]), "first": look(rows["ret"][:cut]), "second": look(rows["ret"][cut:])}


def decide(looks: dict[str, dict], bar: float = 2.0) -> bool:
    """The full look's t reaches the bar and both halves are positive."""
    t = lambda k: looks[k]["t"]
    return all(t(k) is not None for k in looks) and t("full") >= bar and t("first") > 0 and t("second") > 0


def permuted(events: DataFrame, prices: DataFrame, seed: int) -> DataFrame:
    """(ticker, date): each ticker's events moved to as many of its priced days (all, if it has fewer), drawn by hash without replacement; reruns agree."""
    k = events.groupBy("ticker").agg(F.count(F.lit(1)).alias("_k"))
    order = F.row_number().over(Window.partitionBy("ticker").orderBy(F.xxhash64(F.lit(seed), "ticker", "date"), "date"))
    days = prices.where("close is not null").select("ticker", "date").distinct().join(k, "ticker").withColumn("_rn", order)
    return days.where("_rn <= _k").select("ticker", "date")


def fee_tiers(daily: DataFrame, tiers_bps: list[float], year_days: int = 365) -> DataFrame:
    """(bps, gross, net, sharpe, turnover) of (date, pnl, traded) under each one-way fee."""
    tiers = F.explode(F.array(*(F.lit(float(b)) for b in tiers_bps))).alias("bps")
    d = daily.select("date", "pnl", "traded", tiers).withColumn("net", F.col("pnl") - F.col("traded") * F.col("bps") / 1e4)
    sd = F.nullif(F.stddev_samp("net"), F.lit(0.0))
    return d.groupBy("bps").agg((F.avg("pnl") * year_days).alias("gross"), (F.avg("net") * year_days).alias("net"), (F.avg("net") / sd * math.sqrt(year_days)).alias("sharpe"), F.avg("traded").alias("turnover"))


def worst_month(daily: DataFrame) -> DataFrame:
    """One row: the calendar month of the lowest summed return."""
    m = daily.groupBy(F.trunc("date", "month").alias("month")).agg(F.sum("ret").alias("ret"))
    return m.orderBy("ret", "month").limit(1)


def top_share(pnl: DataFrame, n: int = 10) -> DataFrame:
    """One row: the share of the total of (ticker, pnl) that the n largest have."""
    total = pnl.agg(F.sum("pnl").alias("total"))
    top = pnl.orderBy(F.desc("pnl"), "ticker").limit(n).agg(F.sum("pnl").alias("top"))
    return top.crossJoin(total).select((F.col("top") / F.nullif("total", F.lit(0.0))).alias("share"))  # one row each
