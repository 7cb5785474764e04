"""Further named signals: dividend prediction, announcement returns, unions of streams, crypto panels, identity checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import over_time, rolling
from .pit import dense_calendar


def predicted_yield(dividends: DataFrame, month_close: DataFrame, lags: DataFrame) -> DataFrame:
    """(ticker, month, yield): dividends of the month that lies ``lag`` months before the next one, over the month-end close.

    Names are payers of the twelve months before the month. dividends:
    (ticker, m, amount) by month index, month_close: (ticker, m, close),
    lags: (ticker, m, lag).
    """
    paid = dividends.groupBy("ticker", "m").agg(F.sum("amount").alias("amount"))
    base = month_close.join(lags, ["ticker", "m"])
    p = paid.select(F.col("ticker").alias("_t"), F.col("m").alias("_m"), F.col("amount").alias("_a"))
    j = base.join(p, (F.col("ticker") == F.col("_t")) & F.col("_m").between(F.col("m") - 12, F.col("m") - 1))
    hit = F.sum(F.when(F.col("_m") == F.col("m") + 1 - F.col("lag"), F.col("_a")))
    return j.groupBy("ticker", "m", "close").agg((F.coalesce(hit, F.lit(0.0)) / F.nullif(F.col("close"), F.lit(0.0))).alias("yield")).drop("close")


def two_day_return(events: DataFrame, prices: DataFrame, cal: DataFrame, cutoff: int = 16) -> DataFrame:
    """(ticker, ts, ret): close before to close after the trading day on which an event is known (accepted from the cutoff hour on: the next)."""
    e = events.withColumn("_late", F.hour("ts") >= cutoff).withColumn("_day", F.to_date("ts"))
    known = F.when(F.col("_late"), F.date_add("_day", 1)).otherwise(F.col("_day"))
    first = dense_calendar(cal).select(F.col("day").alias("_k"), F.col("after").alias("pos"))
    e = e.withColumn("_k", known).join(F.broadcast(first), "_k").where("pos is not null")
    px = prices.join(F.broadcast(cal), "date").select("ticker", F.col("pos").alias("_p"), "close")
    before = px.select("ticker", (F.col("_p") + 1).alias("pos"), F.col("close").alias("_x"))
    after = px.select("ticker", (F.col("_p") - 1).alias("pos"), F.col("close").alias("_y"))
    return e.join(before, ["ticker", "pos"]).join(after, ["ticker", "pos"]).select("ticker", "ts", (F.col("_y") / F.col("_x") - 1).alias("ret"))


def extremes_by_year(df: DataFrame, value: str, lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    """df with signal: -1 up to the year's lower quantile, +1 from the upper, else 0."""
    q = df.groupBy("year").agg(F.percentile(value, F.lit(lo)).alias("_lo"), F.percentile(value, F.lit(hi)).alias("_hi"))
    s = F.when(F.col(value) <= F.col("_lo"), -1).when(F.col(value) >= F.col("_hi"), 1).otherwise(0)
    return df.join(F.broadcast(q), "year").withColumn("signal", s).drop("_lo", "_hi")


def freshest(streams: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of streams in which, on one key, the last-named stream wins."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, (s.withColumn("_src", F.lit(i)) for i, s in enumerate(streams)))
    w = Window.partitionBy(*key).orderBy(F.desc("_src"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_src")


def carry_in_spells(df: DataFrame, value: str, eligible: str) -> DataFrame:
    """df with value carried forward only inside unbroken eligible spells of a ticker."""
    w = over_time("ticker")
    spell = F.sum(F.when(F.col(eligible), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy("ticker", "_spell").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(eligible), F.col(value))
    return df.withColumn("_spell", spell).withColumn("_v", known).withColumn("carried", F.when(F.col(eligible), F.last("_v", ignorenulls=True).over(inside))).drop("_spell", "_v")


def strongest(scores: Column) -> Column:
    """The score of the largest size; of equal sizes the positive one; 0 of none."""
    best = F.array_max(F.transform(scores, lambda s: F.struct(F.abs(s).alias("a"), s.alias("s"))))
    return F.coalesce(best["s"], F.lit(0.0))


def crypto_signals(p: DataFrame) -> DataFrame:
    """Trailing signals of (symbol, date, close, value, r): momentum skipping a row, short reversal, volatility, largest return, distance from the high, illiquidity, relative volume."""
    w = over_time("symbol")
    lag = lambda k: F.lag("close", k).over(w)
    p = p.withColumn("_ill", F.abs("r") / F.nullif("value", F.lit(0.0)))
    return p.select(
        "symbol", "date", (lag(1) / lag(6) - 1).alias("mom"), (-F.col("r")).alias("rev"), rolling(F.stddev_samp, "r", w, 6).alias("vol"), rolling(F.max, "r", w, 6).alias("max_ret"),
        (F.col("close") / rolling(F.max, "close", w, 12)).alias("high"), rolling(F.avg, "_ill", w, 6).alias("illiq"), (F.col("value") / F.nullif(rolling(F.avg, "value", w, 6), F.lit(0.0))).alias("rel_volume"),
    )


def interest_signals(m: DataFrame) -> DataFrame:
    """Of (symbol, date, oi, ratio): log change of open interest, the same over 7 rows, mean crowding over 7, its change."""
    w = over_time("symbol")
    lg = lambda k: F.ln(F.col("oi") / F.nullif(F.lag("oi", k).over(w), F.lit(0.0)))
    c = rolling(F.avg, "ratio", w, 7)
    return m.select("symbol", "date", lg(1).alias("oi_1"), lg(7).alias("oi_7"), c.alias("crowd"), (F.col("ratio") - c).alias("crowd_dev"))


def verify_jumps(jumps: DataFrame, actions: DataFrame, days: int = 3, tolerance: float = 0.15) -> DataFrame:
    """(ticker, date, ret, verdict): split when an action's ratio explains the move within the tolerance, dividend when a fall is its share of the
    prior close within the tolerance of the return, else review.

    actions: (ticker, action_date, kind, value); jumps: (ticker, date, ret, prior_close).
    """
    a = actions.select(F.col("ticker").alias("_t"), "action_date", "kind", F.col("value").alias("_v"))
    j = jumps.join(a, (F.col("ticker") == F.col("_t")) & F.abs(F.datediff("date", "action_date")).between(0, days), "left")
    factor = 1 + F.col("ret")
    split = (F.col("kind") == "split") & (F.abs(factor * F.col("_v") - 1) <= tolerance)
    implied = -F.col("_v") / F.nullif("prior_close", F.lit(0.0))
    paid = (F.col("kind") == "dividend") & (F.col("ret") < 0) & (F.abs(F.col("ret") - implied) <= tolerance * F.abs("ret"))
    rank = F.when(split, 0).when(paid, 1).otherwise(2)
    g = j.groupBy("ticker", "date", "ret").agg(F.min(rank).alias("_r"))
    return g.select("ticker", "date", "ret", F.when(F.col("_r") == 0, "split").when(F.col("_r") == 1, "dividend").otherwise("review").alias("verdict"))


def assign_rows(rows: DataFrame, listings: DataFrame, tolerance: int = 7) -> DataFrame:
    """Rows with the one listing whose span (widened by the tolerance) holds their date; status resolved, none or several."""
    l = listings.select(F.col("ticker").alias("_t"), "listing_id", "first_date", "last_date")  # noqa: E741
    on = (F.col("ticker") == F.col("_t")) & F.col("date").between(F.date_sub("first_date", tolerance), F.date_add("last_date", tolerance))
    g = rows.select("ticker", "date").join(l, on, "left").groupBy("ticker", "date").agg(F.count_distinct("listing_id").alias("n"), F.min("listing_id").alias("listing_id"))
    return g.select("ticker", "date", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "resolved").otherwise("several").alias("status"), F.when(F.col("n") == 1, F.col("listing_id")).alias("listing_id"))


def members_at(anchor: DataFrame, changes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(checkpoint, ticker): membership rebuilt backwards from a current set by undoing later changes.

    anchor: (ticker); changes: (ticker, date, added) alternating per ticker.
    A ticker belongs at a date as its first later change says (removed: it
    was in), or as the anchor says when there is none.
    """
    names = anchor.select("ticker").unionByName(changes.select("ticker")).distinct()
    grid = names.join(F.broadcast(checkpoints.select(F.col("date").alias("checkpoint"))), F.lit(True))  # names x a few stated dates
    c = changes.select(F.col("ticker").alias("_t"), "date", "added")
    nxt = grid.join(c, (F.col("ticker") == F.col("_t")) & (F.col("date") > F.col("checkpoint")), "left").groupBy("checkpoint", "ticker").agg(F.min(F.struct("date", "added")).alias("n"))
    now = anchor.select("ticker", F.lit(True).alias("_in"))
    j = nxt.join(now, "ticker", "left")
    inside = F.when(F.col("n.date").isNotNull(), ~F.col("n.added")).otherwise(F.coalesce("_in", F.lit(False)))
    return j.where(inside).select("checkpoint", "ticker")


# Asset types and tags of disclosures, and words of descriptions.
EQUITY = ("ST", "STOCK", "RS", "PS", "NON-PUBLIC STOCK")
OPTION = ("OP", "STOCK OPTION", "SA")
NON_EQUITY = ("GS", "CS", "AB", "HN", "OI", "OL", "VA", "CT", "WU", "DB", "RP", "MF", "EF", "ET", "OT", "BA", "IH", "FA", "EIF", "5C", "5F", "5P", "4K", "MUNICIPAL SECURITY", "CORPORATE BOND", "GOVERNMENT SECURITY", "COMMODITIES/FUTURES CONTRACT", "CRYPTOCURRENCY", "OTHER", "OTHER SECURITIES")
OPTION_WORDS = r"(?i)\b(puts?|calls?|options?)\b"
NON_EQUITY_WORDS = r"(?i)\b(treasur\w+|t-?bills?|municipal|bonds?|notes? due|cusip|money market|mutual fund|etf|exchange[- ]traded|cryptocurrenc\w+|bitcoin|annuit\w+)\b"


def asset_class(kind: Column, name: Column, ticker: Column) -> Column:
    """A known declared type, else a known bracket tag, else words, else a ticker means equity (see ``asset_inferred``)."""
    low = F.coalesce(name, F.lit(""))
    found = [F.upper(F.trim(kind)), F.upper(F.regexp_extract(low, r"\[(\w{2})\]", 1))]
    by_code = [F.when(c.isin(*codes), label) for c in found for codes, label in ((OPTION, "option"), (EQUITY, "equity"), (NON_EQUITY, "non_equity"))]
    words = F.when(low.rlike(OPTION_WORDS), "option").when(low.rlike(NON_EQUITY_WORDS), "non_equity")
    return F.coalesce(*by_code, words, F.when(F.coalesce(ticker, F.lit("")) != "", "equity"), F.lit("unclassified"))


def asset_inferred(kind: Column, name: Column, ticker: Column) -> Column:
    """Whether only the ticker's presence made it equity."""
    return (asset_class(kind, name, F.lit(None).cast("string")) == "unclassified") & (F.coalesce(ticker, F.lit("")) != "")


def random_controls(events: DataFrame, prices: DataFrame, cal: DataFrame, near: int = 63, hold: int = 21, seed: int = 7) -> DataFrame:
    """(ticker, date, control): for each event the name drawn (by hash) among ``draws`` hashed candidates that is priced through the window and has no event near.

    Candidates come from a hash order of names per event date bucket, so a
    date's names are not multiplied by its events.
    """
    e = events.join(F.broadcast(cal), "date").select("ticker", "date", "pos")
    px = prices.join(F.broadcast(cal), "date").select(F.col("ticker").alias("control"), F.col("pos").alias("p"))
    w = Window.partitionBy("control").orderBy("p")
    full = px.withColumn("_n", F.count(F.lit(1)).over(w.rangeBetween(0, hold))).where(F.col("_n") == hold + 1).select("control", F.col("p").alias("pos"))
    busy = e.select(F.col("ticker").alias("control"), F.explode(F.sequence(F.col("pos") - near, F.col("pos") + near)).alias("pos")).distinct()
    free = full.join(busy, ["control", "pos"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("pos").orderBy(F.xxhash64(F.lit(seed), "control", "pos"), "control"))
    free = free.withColumn("k", rank)
    order = F.row_number().over(Window.partitionBy("pos").orderBy(F.xxhash64(F.lit(seed), "ticker"), "ticker"))
    return e.withColumn("k", order).join(free, ["pos", "k"], "left").select("ticker", "date", "control")


def null_signal(panel: DataFrame, rho: float, seed: int) -> DataFrame:
    """(month, ticker, null): a random signal per ticker with autocorrelation rho; seeded by ticker, so reruns agree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        e = np.random.default_rng([seed, int(pdf["ticker"].iloc[0])]).normal(size=len(pdf))
        x = np.empty(len(e))
        for i, v in enumerate(e):
            x[i] = v if i == 0 else rho * x[i - 1] + math.sqrt(1 - rho * rho) * v
        return pd.DataFrame({"month": pdf["month"], "ticker": pdf["ticker"], "null": x})

    return panel.select("month", "ticker").groupBy("ticker").applyInPandas(run, "month date, ticker long, null double")


def yearly_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(year, both, only_a, only_b) of two membership tables (year, ticker)."""
    x, y = a.distinct().withColumn("_a", F.lit(1)), b.distinct().withColumn("_b", F.lit(1))
    j = x.join(y, ["year", "ticker"], "full")
    n = lambda c: F.count(F.when(c, 1))
    return j.groupBy("year").agg(n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), n(F.col("_b").isNull()).alias("only_a"), n(F.col("_a").isNull()).alias("only_b"))
