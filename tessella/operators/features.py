"""Window features of a long (ticker, date, close, volume) panel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import median, over_time, rolling
from .pit import dense_calendar


def forward_returns(bars: DataFrame, horizons=(1, 5, 21)) -> DataFrame:
    """close h rows ahead over close, less 1; NULL at the end of a history."""
    w = over_time("ticker")
    return bars.select("*", *((F.lead("close", h).over(w) / F.col("close") - 1).alias(f"fwd_{h}d") for h in horizons))


def momentum(bars: DataFrame) -> DataFrame:
    """Past returns over 21 and 5 rows, and from row 252 to 21 back."""
    w = over_time("ticker")
    back = lambda k: F.lag("close", k).over(w)
    return bars.select("*", (F.col("close") / back(21) - 1).alias("momentum_21d"), (F.col("close") / back(5) - 1).alias("momentum_5d"), (back(21) / back(252) - 1).alias("momentum_252_21"))


def risk(bars: DataFrame) -> DataFrame:
    """Annualised 21-day volatility, 63-day volume z, log of the 63-day median dollar volume (zero is missing)."""
    w = over_time("ticker")
    rows = bars.withColumn("_r", F.col("close") / F.lag("close", 1).over(w) - 1).withColumn("_dv", F.nullif(F.col("close") * F.col("volume"), F.lit(0.0)))
    sd = rolling(F.stddev_samp, "volume", w, 63)
    return rows.select(
        *bars.columns,
        (rolling(F.stddev_samp, "_r", w, 21) * math.sqrt(252)).alias("volatility_21d"),
        ((F.col("volume") - rolling(F.avg, "volume", w, 63)) / F.nullif(sd, F.lit(0.0))).alias("volume_zscore"),
        F.ln(rolling(median, "_dv", w, 63)).alias("log_dollar_volume"),
    )


def lagged(df: DataFrame, cols: list[str], rows: int = 1) -> DataFrame:
    """cols shifted by rows of each ticker; to be applied before any membership filter."""
    w = over_time("ticker")
    return df.select(*(F.lag(c, rows).over(w).alias(c) if c in cols else F.col(c) for c in df.columns))


def high_volume_event(bars: DataFrame) -> DataFrame:
    """+1 / -1 / 0: volume above the 90 % / below the 10 % quantile of the 49 rows before."""
    w = over_time("ticker")
    q = lambda p: rolling(lambda c: F.percentile(c, F.lit(p)), "volume", w, 49, lag=1)
    rows = bars.withColumn("_hi", q(0.9)).withColumn("_lo", q(0.1))
    return rows.withColumn("event", F.when(F.col("_hi").isNull(), None).when(F.col("volume") > F.col("_hi"), 1).when(F.col("volume") < F.col("_lo"), -1).otherwise(0)).drop("_hi", "_lo")


def month_index(col="date"):
    return F.year(col) * 12 + F.month(col) - 1


def volume_trend(bars: DataFrame, months: int = 60, least: int = 30, full: int = 15) -> DataFrame:
    """Per ticker and month: slope of monthly volume on calendar months over the trailing window, over its mean.

    A month with fewer than ``full`` days of the ticker, and fewer than any ticker's days of the month, is partial and left out.
    """
    known = bars.where("volume is not null").withColumn("month", F.trunc("date", "month"))
    monthly = known.groupBy("ticker", "month").agg(F.sum("volume").alias("vol"), F.count_distinct("date").alias("_n"))
    days = known.select("month", "date").distinct().groupBy("month").agg(F.count(F.lit(1)).alias("_all"))  # one row per month
    monthly = monthly.join(F.broadcast(days), "month").where(F.col("_n") >= F.least(F.lit(full), F.col("_all")))
    m = monthly.withColumn("_m", month_index("month"))
    w = Window.partitionBy("ticker").orderBy("_m").rangeBetween(-(months - 1), 0)
    ok = (F.count("vol").over(w) >= least) & (F.avg("vol").over(w) > 0)
    return m.select("ticker", "month", F.when(ok, F.regr_slope("vol", "_m").over(w) / F.avg("vol").over(w)).alias("trend"))


def last_of_month(panel: DataFrame) -> DataFrame:
    """The last row of each ticker and month, with month added."""
    w = Window.partitionBy("ticker", F.trunc("date", "month")).orderBy(F.desc("date"))
    return panel.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").withColumn("month", F.trunc("date", "month"))


def event_count_z(events: DataFrame, cal: DataFrame, window: int = 21, base: int = 504, least: int = 126) -> DataFrame:
    """Daily event frequency z of covered tickers: events (ticker, date), cal (date, pos from 0).

    The count of the last ``window`` days against mean and deviation of the
    same count, ``window`` days earlier, over ``base`` days. An event on no
    calendar day counts on the next one; those before the first or after the
    last day are left out. Days without events are zeros, over the whole
    calendar. The grid is made per ticker by a sequence of positions, so it is
    no cross join.
    """
    next_day = dense_calendar(cal).where("before >= 0 and after is not null").select(F.col("day").alias("date"), F.col("after").alias("pos"))
    e = events.join(F.broadcast(next_day), "date").groupBy("ticker", "pos").agg(F.count(F.lit(1)).alias("n"))
    end = cal.agg(F.max("pos").alias("_end"))
    span = e.select("ticker").distinct().crossJoin(F.broadcast(end))  # one row
    grid = span.select("ticker", F.explode(F.sequence(F.lit(0).cast(cal.schema["pos"].dataType), "_end")).alias("pos")).join(e, ["ticker", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("ticker").orderBy("pos")
    grid = grid.withColumn("cnt", rolling(F.sum, "n", w, window)).withColumn("old", F.lag("cnt", window).over(w))
    mean, sd = rolling(F.avg, "old", w, base, least), rolling(F.stddev_samp, "old", w, base, least)
    z = (F.col("cnt") - mean) / F.nullif(sd, F.lit(0.0))
    return grid.withColumn("z", z).join(F.broadcast(cal), "pos").select("ticker", "date", "cnt", "z")


def event_count_z_monthly(events: DataFrame, base: int = 24, least: int = 6) -> DataFrame:
    """Monthly count z against the trailing ``base`` months (current included), from the first to the last month of any ticker, months without events being zeros."""
    e = events.groupBy("ticker", month_index("date").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    ends = e.agg(F.min("m").alias("_lo"), F.max("m").alias("_end"))
    span = e.select("ticker").distinct().crossJoin(F.broadcast(ends))  # one row
    grid = span.select("ticker", F.explode(F.sequence("_lo", "_end")).alias("m")).join(e, ["ticker", "m"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("ticker").orderBy("m")
    z = (F.col("n") - rolling(F.avg, "n", w, base, least)) / F.nullif(rolling(F.stddev_samp, "n", w, base, least), F.lit(0.0))
    stamp = F.last_day(F.make_date(F.floor(F.col("m") / 12).cast("int"), (F.col("m") % 12 + 1).cast("int"), F.lit(1)))
    return grid.select("ticker", stamp.alias("date"), "n", z.alias("z"))
