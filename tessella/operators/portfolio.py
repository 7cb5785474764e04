"""Portfolio simulation, reports and factor attribution."""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.windows import known, median, over_time, rolling


@dataclass(frozen=True)
class Costs:
    """Half spread and commission per side in basis points, borrow per year."""

    half_spread_bps: float = 5.0
    commission_bps: float = 10.0
    borrow: float = 0.005
    doubled: bool = False

    @property
    def side(self) -> float:
        return (2 if self.doubled else 1) * (self.half_spread_bps + self.commission_bps) / 1e4

    @property
    def borrow_day(self) -> float:
        return (2 if self.doubled else 1) * self.borrow / 252


def capped(weights: pd.Series, cap: float) -> pd.Series:
    """Positive weights cut at cap, the excess shared in proportion among the rest until none is above."""
    if cap * len(weights) < weights.sum() - 1e-12:
        raise ValueError("the cap leaves no room for the total")
    w, total = weights.astype(float).copy(), float(weights.sum())
    fixed = pd.Series(False, index=w.index)
    while (w[~fixed] > cap + 1e-15).any():
        fixed |= w > cap + 1e-15
        w[fixed] = cap
        rest = w[~fixed].sum()
        if rest <= 0:
            break
        w[~fixed] *= (total - cap * fixed.sum()) / rest
    return w


BOOK = "date date, gross double, net double, long double, short double, turnover double, trading_cost double, borrow_cost double, names int"


def _path(days: int, spans: list[tuple[int, int]], sums: dict[str, np.ndarray], costs: Costs) -> tuple[dict[str, np.ndarray], list[float]]:
    """Daily series (all but what trades cost) and, per span, by what its book's value grows up to the next trade.

    spans: (first day, day of the next trade or ``days``); sums: per span, day and sign of the weights the gain, change
    of value and of names for a book of one at the span's start (columns span, day, up, g, v, n).
    """
    out = {k: np.zeros(days) for k in ("long", "short", "short_value", "names")}
    nav, base, growth = np.ones(days + 1), 1.0, []
    for k, (first, stop) in enumerate(spans):
        own = sums["span"] == k
        by = {}
        for up in (True, False):
            some = own & (sums["up"] == up)
            for c in "gvn":
                by[c, up] = np.zeros(stop - first + 1)
                np.add.at(by[c, up], sums["day"][some] - first, sums[c][some])
        g = by["g", True] + by["g", False]
        for up in (True, False):
            side = "long" if up == (base > 0) else "short"  # a book below nothing holds the other way round
            reach = min(stop + 1, days)  # what the shares earn up to the next trade counts on its day
            out[side][first:reach] += base * by["g", up][: reach - first]
            held = np.cumsum(by["n", up])[:-1]
            out["names"][first:stop] += held
            if side == "short":
                out["short_value"][first:stop] = np.where(held > 0, -base * np.cumsum(by["v", up])[:-1], 0.0)
        nav[first:stop] = base * (1 + np.cumsum(g)[:-1])
        growth.append(1 + float(g.sum()))
        base *= growth[-1]
    nav = nav[:days]
    before = np.concatenate([[1.0], nav[:-1]])
    with np.errstate(divide="ignore", invalid="ignore"):  # a value of nothing has no returns
        borrow = np.concatenate([[0.0], out["short_value"][:-1] / nav[:-1]]) * costs.borrow_day
        return {"gross": (out["long"] + out["short"]) / before, "long": out["long"] / before, "short": out["short"] / before, "borrow_cost": borrow, "names": out["names"].astype(int)}, growth


def share_book(prices: DataFrame, targets: DataFrame, costs: Costs = Costs(), execution: str = "close") -> DataFrame:
    """Daily series of a share-based book, from its first trade on (columns: BOOK).

    prices: (date, ticker, close[, open]), one row per ticker and date. targets:
    (date, ticker, weight), one full set per decision date, traded
    at that day's close or at the next day's open. Shares stay between
    trades, so weights drift; a target equal to the one before is not
    traded; names without a price (or of price 0) at execution get none; a name whose prices
    end turns to cash at its last close without cost. turnover is one way,
    half the traded weight; costs are shares of the value; borrow is charged
    on the short value of the day before.

    Between two trades a name's gain is a constant share of the book's value at
    the first times its price change. So Spark sums these shares per day, from
    one window per ticker, and only the book's value, one number a day, is
    walked on the driver. Runs at once; the tables kept meanwhile are released.
    """
    spark, at_open = prices.sparkSession, execution == "next_open"
    buy = F.nullif(F.col("close"), F.lit(0.0)) if not at_open else F.nullif(known("open"), F.lit(0.0)) if "open" in prices.columns else F.lit(None).cast("double")
    px = prices.withColumn("close", known("close")).where("close is not null").select("ticker", "date", F.col("close").cast("double").alias("close"), buy.alias("buy"))
    wanted = targets.select("ticker", "date", F.col("weight").cast("double").alias("weight")).where("weight is not null and not isnan(weight)").persist()
    kept = [wanted]
    try:
        cal = [r.date for r in prices.select("date").unionByName(targets.select("date")).distinct().orderBy("date").collect()]  # one row per day
        row = {d: i for i, d in enumerate(cal)}
        steps = [(r.date, row[r.date] + at_open) for r in wanted.select("date").distinct().orderBy("date").collect()]
        steps = [(d, cal[i], k) for k, (d, i) in enumerate(steps) if i < len(cal)]
        if not steps:
            return spark.createDataFrame([], BOOK)
        step = F.broadcast(spark.createDataFrame(steps, "date date, at date, idx int"))
        aims = wanted.where("weight <> 0").join(step, "date").select("ticker", F.col("at").alias("date"), "idx", "weight")

        # decisions whose targets differ from those before
        met = px.where("buy is not null").join(step.select(F.col("at").alias("date")), "date", "left_semi").select("ticker", "date")
        by = Window.partitionBy("ticker").orderBy("idx")
        same = (F.lag("idx").over(by) == F.col("idx") - 1) & (F.lag("weight").over(by) == F.col("weight"))
        seen = aims.join(met.hint("merge"), ["ticker", "date"]).withColumn("_s", F.coalesce(same, F.lit(False)).cast("int"))
        n = {r.idx: (r.n, r.same) for r in seen.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.sum("_s").alias("same")).collect()}
        if not n:
            return spark.createDataFrame([], BOOK)
        trades = [at for _, at, k in steps if k == 0 or not n.get(k, (0, 0))[0] == n.get(k, (0, 0))[1] == n.get(k - 1, (0, 0))[0]]

        stops = [*trades[1:], None]
        spans = [(row[a], len(cal) if b is None else row[b]) for a, b in zip(trades, stops)]
        days = []
        for i, d in enumerate(cal):
            k = bisect.bisect_left(trades, d)
            days.append((d, i, trades[k - 1] if k else None, k < len(trades) and trades[k] == d))
        spark._jvm.System.gc()  # lets Spark remove the shuffle files of the jobs above, which nothing refers to any more
        moves = _moves(px, aims, F.broadcast(spark.createDataFrame(days, "date date, day int, hold date, trade boolean")), F.broadcast(spark.createDataFrame(list(zip(trades, stops)), "start date, until date"))).persist()
        kept.append(moves)
        sums = moves.where("day is not null").groupBy("span", "day", "up").agg(F.sum("g").alias("g"), F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()  # at most two rows per day and trade
        at = {d: k for k, d in enumerate(trades)}
        sums = {"span": np.array([at[d] for d in sums["span"]], int), "day": sums["day"].to_numpy(int), "up": sums["up"].to_numpy(bool), **{c: sums[c].to_numpy(float) for c in "gvn"}}
        out, growth = _path(len(cal), spans, sums, costs)

        grown = F.broadcast(spark.createDataFrame(list(zip(trades, [1.0, *growth[:-1]])), "span date, grown double"))
        drift = F.when(F.col("y") == 0, 0.0).otherwise(F.col("y") / F.nullif(F.col("grown"), F.lit(0.0)))
        traded = np.zeros(len(cal))
        for r in moves.where("day is null").join(grown, "span").groupBy("span").agg(F.sum(F.abs(F.col("w") - drift)).alias("x")).collect():
            traded[row[r.span]] = np.nan if r.x is None else r.x
    finally:
        for t in kept:
            t.unpersist()
    trading = traded * costs.side
    book = pd.DataFrame({"date": cal, **out, "turnover": traded / 2, "trading_cost": trading, "net": out["gross"] - trading - out["borrow_cost"]}).iloc[spans[0][0] :]
    names = [c.split()[0] for c in BOOK.split(", ")]
    return spark.createDataFrame([tuple(None if v != v else v for v in x) for x in book[names].astype(object).itertuples(index=False)], BOOK)


def _moves(px: DataFrame, aims: DataFrame, days: DataFrame, spans: DataFrame) -> DataFrame:
    """What a book of one at the start of each span (its date) earns, is worth and trades, in rows.

    Rows with day: gain g, change of value v and of names n, up where the weight is positive. Rows without: at the trade
    on date span, the new weight w and the worth y of the shares held until then. px: (ticker, date, close, buy), aims:
    (ticker, date, weight) by date of execution, days: (date, day, hold: the last trade before it, trade: is it one's
    day), spans: (start, until).
    """
    empty = F.lit(None).cast("double")
    aims = aims.join(spans.select(F.col("start").alias("date")), "date", "left_semi")
    both = px.select("ticker", "date", "close", "buy", empty.alias("weight"), F.lit(1).alias("side"))
    both = both.unionByName(aims.select("ticker", "date", empty.alias("close"), empty.alias("buy"), "weight", F.lit(0).alias("side")))
    w = Window.partitionBy("ticker").orderBy("date", "side")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    aim = F.when((F.lag("side").over(w) == 0) & (F.lag("date").over(w) == F.col("date")) & F.col("buy").isNotNull(), F.lag("weight").over(w))
    rows = both.withColumn("aim", aim).withColumn("u", F.col("aim") / F.col("buy"))
    rows = rows.withColumn("leg", F.last(F.when(F.col("u").isNotNull(), F.struct("date", "u")), ignorenulls=True).over(earlier))
    rows = rows.withColumn("prev", F.last(F.when(F.col("side") == 1, F.struct("date", "close")), ignorenulls=True).over(earlier))
    rows = rows.withColumn("end", F.max(F.when(F.col("side") == 1, F.col("date"))).over(Window.partitionBy("ticker"))).where("side = 1 and (leg is not null or u is not null)")
    rows = rows.join(days, "date").join(spans, F.col("leg.date") == F.col("start"), "left")

    new, old = F.col("u").isNotNull(), F.coalesce(F.col("leg.date") == F.col("hold"), F.lit(False))
    # shares sold at a trade without a price of that day
    late = F.coalesce(~old & (F.col("prev.date") < F.col("until")) & (F.col("until") < F.col("date")), F.lit(False))
    x = F.when(F.col("trade"), F.coalesce("buy", "close")).otherwise(F.col("close"))
    gain, mine = F.col("leg.u") * (x - F.col("prev.close")), F.when(new, F.col("u")).otherwise(F.col("leg.u"))

    def row(when, span, day, u, g, v, n, w=empty, y=empty):
        none = F.lit(None)
        kinds = {"span": (span, "date"), "day": (none if day is None else day, "int"), "up": (none if u is None else u > 0, "boolean"), "g": (g, "double"), "v": (v, "double"), "n": (n, "int"), "w": (w, "double"), "y": (y, "double")}
        return F.when(when, F.struct(*(c.cast(t).alias(k) for k, (c, t) in kinds.items())))

    none, zero = F.lit(None), F.lit(0)
    found = F.array(
        row(old, F.col("hold"), F.col("day"), F.col("leg.u"), gain, gain, zero),
        row(new, F.col("date"), F.col("day"), F.col("u"), F.col("u") * (F.col("close") - F.col("buy")), F.col("u") * F.col("close"), F.lit(1)),
        # the day after the last price: cash
        row((F.col("date") == F.col("end")) & (new | (old & ~F.col("trade"))), F.when(new, F.col("date")).otherwise(F.col("hold")), F.col("day") + 1, mine, zero, -mine * F.col("close"), F.lit(-1)),
        row(F.col("trade") & (old | new), F.col("date"), None, None, none, none, none, F.coalesce("aim", F.lit(0.0)), F.when(old, F.col("leg.u") * x).otherwise(0.0)),
        row(late, F.col("until"), None, None, none, none, none, F.lit(0.0), F.col("leg.u") * F.col("prev.close")),
    )
    return rows.where(old | new | late).select(F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).select("r.*")


def report(daily: DataFrame, year_days: int = 252) -> DataFrame:
    """One row from (date, ret): n, mean, Sharpe, annual return, worst drawdown, best year's share of the total."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    path = daily.withColumn("_w", F.exp(F.sum(F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-12)))).over(w)))
    path = path.withColumn("_dd", F.col("_w") / F.greatest(F.max("_w").over(w), F.lit(0.0)) - 1)
    sd = F.nullif(F.stddev_samp("ret"), F.lit(0.0))
    base = path.agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), (F.avg("ret") / sd * math.sqrt(year_days)).alias("sharpe"), (F.avg("ret") * year_days).alias("ann_return"), F.min("_dd").alias("max_drawdown"))
    years = daily.groupBy(F.year("date").alias("y")).agg(F.sum("ret").alias("s"))
    best = years.agg((F.max("s") / F.nullif(F.sum("s"), F.lit(0.0))).alias("best_year_share"), F.min("s").alias("worst_year"))
    return base.crossJoin(best)  # one row each


def _quintile_grid(signal: DataFrame, rets: DataFrame, q: int, least: int, universe: DataFrame | None, funding: DataFrame | None) -> DataFrame:
    """(symbol, date, w, nr, old): weights, next row's return less next row's funding, weights drifted from the row before.

    signal: (symbol, date, x), rets: (symbol, date, r); universe: the (symbol,
    date) that are ranked; funding: (symbol, date, fund). The quintiles are cut
    at shares of the day's largest average rank, which ties at the top lower.
    Days where it is under ``least`` hold nothing.
    """
    x = Window.partitionBy("date")
    s = signal.where("x is not null")
    if universe is not None:
        s = s.join(universe.select("symbol", "date"), ["symbol", "date"], "left_semi")
    s = s.withColumn("rk", F.rank().over(x.orderBy("x")) + (F.count(F.lit(1)).over(Window.partitionBy("date", "x")) - 1) / 2.0).withColumn("n", F.max("rk").over(x))
    long, short = F.col("rk") >= F.col("n") * (1 - 1.0 / q), F.col("rk") <= F.col("n") / float(q)
    s = s.withColumn("side", F.when(F.col("n") < least, 0).when(long, 1).when(short, -1).otherwise(0))
    s = s.withColumn("w", F.when(F.col("side") != 0, F.col("side") / F.count(F.lit(1)).over(Window.partitionBy("date", "side"))).otherwise(0.0))
    grid = rets.join(s.select("symbol", "date", "w"), ["symbol", "date"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    t = Window.partitionBy("symbol").orderBy("date")
    grid = grid.join(funding, ["symbol", "date"], "left") if funding is not None else grid.withColumn("fund", F.lit(0.0))
    grid = grid.withColumn("nr", F.coalesce(F.lead("r").over(t), F.lit(0.0)) - F.coalesce(F.lead("fund").over(t), F.lit(0.0)))
    return grid.withColumn("old", F.coalesce(F.lag("w").over(t) * (1 + F.col("r")), F.lit(0.0))).select("symbol", "date", "w", "nr", "old")


def rank_quintiles(signal: DataFrame, rets: DataFrame, q: int = 5, least: int = 20, universe: DataFrame | None = None, funding: DataFrame | None = None) -> DataFrame:
    """(date, pnl, traded): equal-weight top less bottom quintile by average rank, of the tables of ``_quintile_grid``; trades against drifted weights."""
    grid = _quintile_grid(signal, rets, q, least, universe, funding)
    return grid.groupBy("date").agg(F.sum(F.col("w") * F.col("nr")).alias("pnl"), F.sum(F.abs(F.col("w") - F.col("old"))).alias("traded"))


def sleeve(signal: DataFrame, rets: DataFrame, betas: DataFrame, cost: float = 5e-4, q: int = 5, least: int = 20, universe: DataFrame | None = None, funding: DataFrame | None = None) -> DataFrame:
    """(date, ret, beta) of the days on which a quintile book holds something: return after ``cost`` a unit traded, and its names' betas (symbol, date, beta), unknown ones 0."""
    grid = _quintile_grid(signal, rets, q, least, universe, funding).join(betas, ["symbol", "date"], "left")
    day = grid.groupBy("date").agg(F.sum(F.col("w") * F.col("nr")).alias("pnl"), F.sum(F.abs(F.col("w") - F.col("old"))).alias("traded"), F.coalesce(F.sum(F.col("w") * F.col("beta")), F.lit(0.0)).alias("beta"), F.sum(F.abs("w")).alias("gross"))
    return day.where("gross > 0").select("date", (F.col("pnl") - F.col("traded") * cost).alias("ret"), "beta")


def rolling_beta(rets: DataFrame, market: DataFrame, n: int = 60, least: int | None = None) -> DataFrame:
    """(symbol, date, beta): framed covariance over variance against market (date, m), on rows where both are known."""
    j = rets.join(F.broadcast(market), "date").withColumn("_r", F.when(F.col("m").isNotNull(), F.col("r"))).withColumn("_m", F.when(F.col("r").isNotNull(), F.col("m")))
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-(n - 1), 0)
    beta = F.covar_samp("_r", "_m").over(w) / F.nullif(F.var_samp("_m").over(w), F.lit(0.0))
    return j.select("symbol", "date", F.when(F.count("_r").over(w) >= (least or n), beta).alias("beta"))


def rolling_skew(rets: DataFrame, n: int = 30) -> DataFrame:
    """(symbol, date, skew): bias-corrected skewness of a full window (population skewness times a factor)."""
    w = over_time("symbol")
    return rets.select("symbol", "date", (rolling(F.skewness, "r", w, n) * (math.sqrt(n * (n - 1)) / (n - 2))).alias("skew"))


def liquid_universe(bars: DataFrame, n: int = 30, top: int = 100) -> DataFrame:
    """(symbol, date) of the names among the top by median traded value of n rows."""
    m = bars.withColumn("_m", rolling(median, "value", over_time("symbol"), n)).where("_m is not null")
    rk = F.rank().over(Window.partitionBy("date").orderBy(F.desc("_m")))
    return m.withColumn("_rk", rk).where(F.col("_rk") <= top).select("symbol", "date")


def attribution(pnl: DataFrame, factors: DataFrame, names: list[str], lags: int = 32) -> dict:
    """OLS of a daily book on factors with Newey-West errors; refuses series that look like per cent."""
    rows = pnl.join(factors, "date").dropna(subset=["ret", *names]).orderBy("date").select("ret", *names).toPandas()  # one row per day
    if len(rows) <= len(names) + 1:
        return {"ok": False, "n": len(rows)}
    if rows["ret"].std() > 0.2:
        raise ValueError("returns look like per cent, decimals are wanted")
    fit = stats.ols_hac(rows["ret"].to_numpy(), rows[names].to_numpy(), lags)
    return {"ok": True, "n": len(rows), "alpha": float(fit["beta"][0]), "alpha_t": float(fit["t"][0]), "loadings": dict(zip(names, fit["beta"][1:].tolist())), "loading_t": dict(zip(names, fit["t"][1:].tolist())), "r2": fit["r2"], "ir": float(fit["beta"][0] / fit["resid_std"] * math.sqrt(252)) if fit["resid_std"] > 0 else None}


def combine_sleeves(sleeves: DataFrame, market: DataFrame, target_vol: float = 0.15, n: int = 30, max_leverage: float = 3.0, cost: float = 5e-4, year_days: int = 365) -> DataFrame:
    """(date, raw, hedged, ret): sleeves (sleeve, date, ret, beta) weighted by inverse volatility, hedged and scaled to a target volatility.

    Only days on which every sleeve has a return count. The hedge sells the
    book's beta in the market (date, m: the market's next return) and pays
    ``cost`` for changes of it; leverage is that of the n hedged days before,
    at most ``max_leverage``, and its changes pay ``cost`` on two units. Days
    before the first leverage, and days without m, are left out of ret.
    """
    rows = sleeves.where("ret is not null")
    every = F.broadcast(rows.agg(F.count_distinct("sleeve").alias("_k")))  # one row
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("date"))).join(every, F.col("_n") == F.col("_k"))
    sd = rows.groupBy("sleeve").agg(F.stddev_samp("ret").alias("_sd"))  # one row per sleeve
    w = sd.where("_sd > 0").select("sleeve", (1 / F.col("_sd")).alias("_i")).withColumn("weight", F.col("_i") / F.sum("_i").over(Window.partitionBy(F.lit(1))))
    day = rows.join(F.broadcast(w), "sleeve").groupBy("date").agg(F.sum(F.col("ret") * F.col("weight")).alias("raw"), F.sum(F.col("beta") * F.col("weight")).alias("_b"))
    day = day.join(F.broadcast(market), "date", "left")
    t = Window.orderBy("date")  # one row per day
    turned = F.coalesce(F.abs(F.col("_b") - F.lag("_b").over(t)), F.lit(0.0))
    day = day.withColumn("hedged", F.col("raw") - F.col("_b") * F.col("m") - turned * cost)
    day = day.withColumn("_v", rolling(F.stddev_samp, "hedged", t, n, lag=1) * math.sqrt(year_days))
    day = day.withColumn("_l", F.when(F.col("_v") > 0, F.least(F.lit(max_leverage), target_vol / F.col("_v"))).when(F.col("_v") == 0, max_leverage))
    paid = F.coalesce(F.abs(F.col("_l") - F.lag("_l").over(t)), F.lit(0.0)) * 2 * cost
    return day.select("date", "raw", "hedged", (F.col("hedged") * F.col("_l") - paid).alias("ret"))
