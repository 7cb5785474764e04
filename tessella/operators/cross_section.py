"""Cross-sectional ranks, information coefficients and quantile books.

Panels are long: (month, ticker, factor columns, target). Only one row per
month ever reaches the driver.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.windows import average_rank

MIN_NAMES = 20
MIN_MONTHS = 12


def add_rank_z(df: DataFrame, cols: list[str], keys: list[str], sector: str | None = None) -> DataFrame:
    """df with z_<col> for each col: rank z within keys, less the sector's mean where a sector is named."""
    w = Window.partitionBy(*keys)
    for c in cols:
        df = df.withColumn("_r", average_rank(c, *keys))
        sd = F.stddev_pop("_r").over(w)
        df = df.withColumn(f"z_{c}", F.when((F.count("_r").over(w) >= 2) & (sd > 0), (F.col("_r") - F.avg("_r").over(w)) / sd)).drop("_r")
    return sector_neutral(df, [f"z_{c}" for c in cols], keys, sector) if sector else df


def sector_neutral(df: DataFrame, cols: list[str], keys: list[str], sector: str = "sector") -> DataFrame:
    """cols less their mean within keys and sector; a null sector is one of its own."""
    w = Window.partitionBy(*keys, F.coalesce(F.col(sector), F.lit("UNKNOWN")))
    return df.select(*(((F.col(c) - F.avg(c).over(w)).alias(c) if c in cols else F.col(c)) for c in df.columns))


def complete(panel: DataFrame, cols: list[str], min_names: int, keys: list[str]) -> DataFrame:
    """Rows without a null in cols, of groups with at least min_names of them."""
    rows = panel.dropna(subset=cols)
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= min_names).drop("_n")


def monthly_ic(panel: DataFrame, factor: str, target: str, min_names: int = MIN_NAMES, keys: tuple[str, ...] = ("month",)) -> DataFrame:
    """Spearman correlation of factor and target per month (and further keys): (keys, ic, n)."""
    keys = list(keys)
    rows = complete(panel.select(*keys, F.col(factor).alias("_x"), F.col(target).alias("_y")), ["_x", "_y"], min_names, keys)
    rows = rows.withColumn("_rx", average_rank("_x", *keys)).withColumn("_ry", average_rank("_y", *keys))
    ok = (F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0)
    return rows.groupBy(*keys).agg(F.when(ok, F.corr("_rx", "_ry")).alias("ic"), F.count(F.lit(1)).alias("n")).where("ic is not null")


def ic_by_candidate(panel: DataFrame, candidates: list[str], target: str, min_names: int = MIN_NAMES) -> DataFrame:
    """monthly_ic of many candidates in one job: (candidate, month, ic, n)."""
    long = panel.select("month", F.col(target).alias("_t"), F.explode(F.array(*(F.struct(F.lit(c).alias("candidate"), F.col(c).cast("double").alias("v")) for c in candidates))).alias("_c"))
    return monthly_ic(long.select("month", "_t", "_c.candidate", "_c.v"), "v", "_t", min_names, ("candidate", "month"))


def moments(panel: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Per group: n, sums and sums of products of cols, all that a regression needs."""
    sums = [F.sum(c).alias(f"s_{c}") for c in cols]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in combinations_with_replacement(cols, 2)]
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def judge(panel: DataFrame, accepted: list[str], candidate: str, target: str, sector: str | None = None, min_names: int = MIN_NAMES, min_months: int = MIN_MONTHS) -> dict:
    """Raw and incremental IC of a candidate over the accepted factors.

    Ranks are made in Spark; a month's regression is solved from its sums of
    products, so rows never leave the executors.
    """
    need = [candidate, target, *accepted]
    rows = add_rank_z(complete(panel, need, min_names, ["month"]), need, ["month"], sector)
    z = [f"z_{c}" for c in need]
    found = moments(rows.dropna(subset=z[:2]), z, ["month"]).orderBy("month").collect()  # one row per month
    raw, inc, r2, names, corr = [], [], [], [], {a: [] for a in accepted}
    for m in found:
        n, k = m["n"], len(z)
        s = np.array([m[f"s_{c}"] or 0.0 for c in z])
        p = np.empty((k, k))
        for i, j in combinations_with_replacement(range(k), 2):
            p[i, j] = p[j, i] = m[f"p_{z[i]}_{z[j]}"] or 0.0
        cov = p / n - np.outer(s, s) / n**2
        if cov[0, 0] <= 1e-12 or cov[1, 1] <= 1e-12:
            continue
        raw.append(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]))
        names.append(n)
        if not accepted:
            r2.append(0.0)
            inc.append(raw[-1])
            continue
        beta = np.linalg.pinv(cov[2:, 2:], rcond=1e-10) @ cov[2:, 0]
        left = cov[0, 0] - beta @ cov[2:, 0]
        r2.append(1 - left / cov[0, 0])
        inc.append((cov[0, 1] - beta @ cov[2:, 1]) / np.sqrt(left * cov[1, 1]) if left > 1e-12 else 0.0)
        for i, a in enumerate(accepted, 2):
            corr[a].append(cov[0, i] / np.sqrt(cov[0, 0] * cov[i, i]) if cov[i, i] > 1e-12 else np.nan)
    if len(raw) < min_months:
        return {"candidate": candidate, "n_months": len(raw), "ok": False}
    t = lambda x: stats.naive_t(x) or 0.0
    return {
        "candidate": candidate, "accepted": list(accepted), "ok": True, "n_months": len(raw), "avg_names": int(np.mean(names)), "spanned_r2": float(np.mean(r2)),
        "corr_to_accepted": {a: float(np.mean(v)) for a, v in corr.items() if v}, "ic_raw": float(np.mean(raw)), "ic_raw_t": t(raw),
        "ic_incremental": float(np.mean(inc)), "ic_incremental_t": t(inc), "ic_incremental_t_hac": stats.hac_t(inc, stats.lag_rule(21, 21, inc)),
    }


def greedy(panel: DataFrame, candidates: list[str], target: str, bar: float, **how) -> list[dict]:
    """Forward selection: each round accepts the candidate of the largest |t| of incremental IC above the bar."""
    accepted, steps, left = [], [], list(candidates)
    while left:
        scored = [s for s in (judge(panel, accepted, c, target, **how) for c in left) if s["ok"]]
        if not scored:
            break
        best = max(scored, key=lambda s: (abs(s["ic_incremental_t"]), s["candidate"]))
        if abs(best["ic_incremental_t"]) <= bar:
            break
        steps.append(best)
        accepted.append(best["candidate"])
        left.remove(best["candidate"])
    return steps


def rank_autocorr(panel: DataFrame, factor: str, least: int = 30) -> DataFrame:
    """Spearman correlation of each month with the next present one, on the tickers of both: (month, rho, n)."""
    rows = panel.where(F.col(factor).isNotNull()).select("month", "ticker", F.col(factor).alias("x"))
    months = panel.select("month").distinct()
    nxt = months.select("month", F.lead("month").over(Window.orderBy("month")).alias("next"))  # one row per month
    a = rows.join(F.broadcast(nxt), "month").select(F.col("month"), "ticker", F.col("x").alias("a"), "next")
    both = a.join(rows.select(F.col("month").alias("next"), "ticker", F.col("x").alias("b")), ["next", "ticker"])
    return monthly_ic(both, "a", "b", least).select("month", F.col("ic").alias("rho"), "n")


def quantile_of_rank(q: int, rank: Column, n: Column) -> Column:
    """The bucket 0..q-1 that equal-count binning of ordinal ranks 1..n gives."""
    return F.greatest(F.ceil((rank - 1) * q / (n - 1)), F.lit(1)) - 1


def quantile_book(panel: DataFrame, factor: str, target: str, q: int = 5, min_names: int = 50) -> DataFrame:
    """(month, ticker, bucket, target) by ordinal rank of (factor, ticker)."""
    rows = complete(panel.select("month", "ticker", F.col(factor).alias("_x"), F.col(target).alias("target")), ["_x", "target"], min_names, ["month"])
    rn = F.row_number().over(Window.partitionBy("month").orderBy("_x", "ticker"))
    n = F.count(F.lit(1)).over(Window.partitionBy("month"))
    return rows.select("month", "ticker", quantile_of_rank(q, rn, n).cast("int").alias("bucket"), "target")


def long_short(book: DataFrame, q: int) -> DataFrame:
    """(month, ls, turnover_top, turnover_bottom): mean target of the top less the bottom bucket; the shares of names new to each."""
    top, bottom = F.col("bucket") == q - 1, F.col("bucket") == 0
    ls = book.groupBy("month").agg((F.avg(F.when(top, F.col("target"))) - F.avg(F.when(bottom, F.col("target")))).alias("ls"))
    months = book.select("month").distinct()
    prev = months.select("month", F.lag("month").over(Window.orderBy("month")).alias("prev"))  # one row per month
    ends = book.where(top | bottom).join(F.broadcast(prev), "month")
    old = ends.select(F.col("month").alias("prev"), "ticker", "bucket", F.lit(1).alias("held"))
    now = ends.join(old, ["prev", "ticker", "bucket"], "left")
    new = F.avg(F.when(F.col("held").isNull(), 1.0).otherwise(0.0))
    side = now.where("prev is not null").groupBy("month", "bucket").agg(new.alias("new"))
    turn = side.groupBy("month").agg(F.max(F.when(top, F.col("new"))).alias("turnover_top"), F.max(F.when(bottom, F.col("new"))).alias("turnover_bottom"))
    return ls.join(turn, "month", "left")


def pooled_correlation(panel: DataFrame, factors: list[str], min_names: int = 30, least: int = 100) -> dict:
    """Effective number of factors from pooled rank-z correlations, pairwise complete."""
    some = F.coalesce(*(F.col(f) for f in factors)).isNotNull()
    rows = panel.where(some).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("month"))).where(F.col("_n") >= min_names)
    rows = add_rank_z(rows, factors, ["month"])
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    both = lambda a, b: F.col(f"z_{a}").isNotNull() & F.col(f"z_{b}").isNotNull()
    aggs = [F.when(F.count(F.when(both(a, b), 1)) >= least, F.corr(f"z_{a}", f"z_{b}")).alias(f"{a}|{b}") for a, b in pairs]
    got = rows.agg(*aggs).first() if aggs else {}
    c = np.eye(len(factors))
    for a, b in pairs:
        i, j = factors.index(a), factors.index(b)
        c[i, j] = c[j, i] = np.nan if got[f"{a}|{b}"] is None else got[f"{a}|{b}"]
    return stats.effective_number(c)


def equal_weight_legs(scores: DataFrame, q: int = 10, direction: int = 1, cap: float = 0.05, key: str = "date") -> DataFrame:
    """(key, ticker, weight): by stable (score, ticker) order, bin floor((rank - 1) q / n); legs of +-1, each name at most cap."""
    w = Window.partitionBy(key)
    rn = F.row_number().over(w.orderBy("score", "ticker"))
    rows = scores.dropna(subset=["score"]).withColumn("_b", F.floor((rn - 1) * q / F.count(F.lit(1)).over(w)))
    rows = rows.where(F.col("_b").isin(0, q - 1))
    n = F.count(F.lit(1)).over(Window.partitionBy(key, "_b"))
    side = F.when(F.col("_b") == q - 1, direction).otherwise(-direction)
    return rows.select(key, "ticker", (side * F.least(1.0 / n, F.lit(cap))).alias("weight"))
