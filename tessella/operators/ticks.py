"""Tick operators: (symbol, ts, seq, price) and order-book messages."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import rolling


def bins(ticks: DataFrame, width: str) -> DataFrame:
    """(symbol, start, price, n): last price of each tumbling bin that has a tick."""
    return ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.max_by("price", F.struct("ts", "seq")).alias("price"), F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("start"), "price", "n")


def filled_grid(binned: DataFrame, seconds: int) -> DataFrame:
    """Every bin from a symbol's first to its last, the last price carried."""
    b = binned.select("symbol", (F.unix_timestamp("start") / seconds).cast("long").alias("k"), "price")
    span = b.groupBy("symbol").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    grid = span.select("symbol", F.explode(F.sequence("lo", "hi")).alias("k")).join(b, ["symbol", "k"], "left")
    w = Window.partitionBy("symbol").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("symbol", "k", F.last("price", ignorenulls=True).over(w).alias("price"))


def realized_variance(grid: DataFrame, n: int) -> DataFrame:
    """Sum of the last n squared log returns of a filled grid (a full window)."""
    w = Window.partitionBy("symbol").orderBy("k")
    r = grid.withColumn("_r2", F.pow(F.ln(F.col("price") / F.lag("price").over(w)), 2))
    return r.select("symbol", "k", "price", rolling(F.sum, "_r2", w, n).alias("rv"))


def ewma_variance(grid: DataFrame, halflife: float) -> DataFrame:
    """(symbol, k, var): adjusted exponentially weighted mean of squared log returns; a recursion, one symbol per group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        r2 = np.log(pdf["price"]).diff() ** 2
        return pd.DataFrame({"symbol": pdf["symbol"], "k": pdf["k"], "var": r2.ewm(halflife=halflife, adjust=True).mean()})

    return grid.groupBy("symbol").applyInPandas(run, "symbol long, k long, var double")


def lead_lag(grid: DataFrame, a: int, b: int, lags: list[int]) -> DataFrame:
    """(lag, rho, n): correlation of a's change with b's change ``lag`` bins later."""
    w = Window.partitionBy("symbol").orderBy("k")
    r = grid.withColumn("r", F.ln(F.col("price") / F.lag("price").over(w))).where("r is not null")
    x = r.where(F.col("symbol") == a).select(F.col("r").alias("x"), F.explode(F.array(*(F.struct(F.lit(v).alias("lag"), (F.col("k") + v).alias("k")) for v in lags))).alias("s")).select("x", "s.*")
    y = r.where(F.col("symbol") == b).select("k", F.col("r").alias("y"))
    return x.join(y, "k").groupBy("lag").agg(F.corr("x", "y").alias("rho"), F.count(F.lit(1)).alias("n"))


def jump_response(ticks: DataFrame, threshold: float, horizons: list[int]) -> DataFrame:
    """(horizon, n, median): after moves of at least the threshold, the further log move at each horizon (in ticks of the symbol)."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    ahead = F.array(*(F.struct(F.lit(h).alias("horizon"), F.ln(F.lead("price", h).over(w) / F.col("price")).alias("move")) for h in horizons))
    r = ticks.select(F.ln(F.col("price") / F.lag("price").over(w)).alias("_m"), ahead.alias("_h"))
    out = r.select("_m", F.explode("_h").alias("h")).select("_m", F.struct("h.horizon", (F.signum("_m") * F.col("h.move")).alias("move")).alias("h"))
    return out.where(F.abs("_m") >= threshold).where("h.move is not null").groupBy("h.horizon").agg(F.count(F.lit(1)).alias("n"), F.percentile("h.move", F.lit(0.5)).alias("median"))


def cooldown(events: DataFrame, seconds: float) -> DataFrame:
    """(key, ts, seq): events that fire, none within ``seconds`` of the last that did; sequential per key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"])
        keep, last = [], None
        for t in pdf["ts"]:
            fire = last is None or (t - last).total_seconds() > seconds
            keep.append(fire)
            last = t if fire else last
        return pdf[keep][["key", "ts", "seq"]]

    return events.select("key", "ts", "seq").groupBy("key").applyInPandas(run, "key long, ts timestamp, seq long")


def maker_replay(trades: DataFrame, spot: DataFrame, window_s: int = 300, latency_s: float = 0.5, half_width: float = 0.02, cool_s: float = 5.0, vol: float = 1e-4) -> DataFrame:
    """(key, fills, pnl, pickoff): replay of a two-sided quote around a fair chance, per market window.

    trades: (key, ts, seq, px, side) on the chance that the spot ends a
    window above its start; spot: (t, price), t in seconds. The quote sees
    the spot ``latency_s`` before; it fills last in queue (a trade beyond
    it), once per side in ``cool_s`` seconds, from 10 s after the start to
    60 s before the end, and is settled at the end. A fill is a pick-off if
    the fair chance 30 s later has passed it by two cents. Spot levels come
    from one as-of merge of all moments; the cooldown is sequential per key.
    """
    sec = F.unix_micros("ts") / 1e6
    t = trades.withColumn("_t", sec).withColumn("_s", F.floor(sec / window_s) * window_s)
    moments = F.array(*(F.struct(F.lit(n).alias("what"), x.alias("at")) for n, x in (("now", F.col("_t") - latency_s), ("open", F.col("_s").cast("double")), ("end", (F.col("_s") + window_s).cast("double")), ("later", F.col("_t") + 30.0))))
    asked = t.select("key", "seq", F.explode(moments).alias("m")).select("key", "seq", "m.what", F.col("m.at").alias("at"))
    bucket = F.floor(F.col("at") / 86400)  # a day's moments and prices meet; the last price of the day before is carried in
    s = spot.select(F.col("t").alias("at"), "price")
    last = s.groupBy(bucket.alias("_b")).agg(F.max_by("price", "at").alias("price"))
    carry = last.select(((F.col("_b") + 1) * 86400).cast("double").alias("at"), "price")
    both = asked.withColumn("_q", F.lit(1)).unionByName(s.unionByName(carry).withColumn("_q", F.lit(0)), allowMissingColumns=True).withColumn("_b", bucket)
    w = Window.partitionBy("_b").orderBy("at", "_q").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("price", F.last("price", ignorenulls=True).over(w)).where("_q = 1")
    levels = seen.groupBy("key", "seq").agg(*(F.max(F.when(F.col("what") == n, F.col("price"))).alias(f"_{n}") for n in ("now", "open", "end", "later")))
    j = t.join(levels, ["key", "seq"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from .options import normal_cdf

        d = pdf.sort_values(["_t", "seq"])
        left = d["_s"] + window_s - d["_t"]
        chance = lambda level, tau: normal_cdf(np.log(level / d["_open"]) / (vol * np.sqrt(np.maximum(tau, 30))))
        fair, later = chance(d["_now"], left), chance(d["_later"], left - 30)
        won = (d["_end"] >= d["_open"]).to_numpy(float)
        ok = (left <= window_s - 10) & (left >= 60) & (fair > 0.05) & (fair < 0.95)
        fills, pnl, pick, last = 0, 0.0, 0.0, {}
        for i, (px, side, at, good) in enumerate(zip(d["px"], d["side"], d["_t"], ok)):
            quote = fair[i] + half_width if side == "BUY" else fair[i] - half_width
            beyond = px > quote if side == "BUY" else px < quote
            if not (good and beyond and 0 < quote < 1) or at - last.get(side, -1e18) <= cool_s:
                continue
            last[side] = at
            sign = 1 if side == "BUY" else -1
            gain = sign * (quote - won[i])
            fills, pnl = fills + 1, pnl + gain
            pick += gain if sign * (later[i] - quote) > 0.02 else 0.0
        return pd.DataFrame([(pdf["key"].iloc[0], fills, pnl, pick)], columns=["key", "fills", "pnl", "pickoff"])

    return j.dropna(subset=["_now", "_open", "_end", "_later"]).groupBy("key").applyInPandas(run, "key long, fills long, pnl double, pickoff double")


class Book:
    """A two-sided book of price levels, from snapshots and size changes."""

    def __init__(self):
        self.bids: dict[float, float] = {}
        self.asks: dict[float, float] = {}

    def snapshot(self, bids, asks) -> None:
        self.bids, self.asks = ({float(p): float(s) for p, s in x if float(s) > 0} for x in (bids, asks))

    def change(self, side: str, price: float, size: float) -> None:
        levels = self.bids if side == "BUY" else self.asks
        if size > 0:
            levels[float(price)] = float(size)
        else:
            levels.pop(float(price), None)

    def mid(self) -> float | None:
        if not self.bids or not self.asks:
            return None
        bid, ask = max(self.bids), min(self.asks)
        return (bid + ask) / 2 if 0 < bid <= ask < 1 else None


def book_mids(messages: DataFrame) -> DataFrame:
    """(token, ts, mid) after each message with a usable book; messages: (token, ts, seq, kind, body JSON). One token's messages in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        book, out = Book(), []
        for r in pdf.sort_values(["ts", "seq"]).itertuples(index=False):
            body = json.loads(r.body)
            if r.kind == "snapshot":
                book.snapshot(body["bids"], body["asks"])
            else:
                book.change(body["side"], body["price"], body["size"])
            if (m := book.mid()) is not None:
                out.append((r.token, r.ts, m))
        return pd.DataFrame(out, columns=["token", "ts", "mid"])

    return messages.groupBy("token").applyInPandas(run, "token long, ts timestamp, mid double")


def best_quotes(snapshots: DataFrame) -> DataFrame:
    """snapshots (market, ts, yes, no: arrays of [price, size]) with best yes bid and ask (1 - best no bid)."""
    best = lambda c: F.array_max(F.transform(c, lambda x: x[0]))
    return snapshots.select("market", "ts", best("yes").alias("bid"), (1 - best("no")).alias("ask"))
