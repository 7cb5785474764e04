"""Data-quality and identity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_audit(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, rows with a null in the key, rows of keys that occur more than once. Exact, pre-aggregated by key."""
    null = " or ".join(f"{k} is null" for k in key)
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.sum(F.when(F.expr(null), F.col("n")).otherwise(0)).alias("null_rows"), F.sum(F.when(~F.expr(null) & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("duplicate_rows"))


def domain_audit(bars: DataFrame) -> DataFrame:
    """(rule, violations) of open, high, low, close, volume rules, in one pass."""
    num = ["open", "high", "low", "close"]
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    rules = {
        "missing": F.greatest(*(F.col(c).isNull().cast("int") for c in [*num, "volume"])) == 1,
        "not_finite": F.coalesce(F.greatest(*(bad(c).cast("int") for c in num)) == 1, F.lit(False)),
        "not_positive": F.coalesce(F.least(*map(F.col, num)) <= 0, F.lit(False)),
        "high_low": F.coalesce((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")), F.lit(False)),
        "negative_volume": F.coalesce(F.col("volume") < 0, F.lit(False)),
    }
    one = bars.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))).alias("r")).select("r.*")


def resolve_intervals(intervals: DataFrame, listings: DataFrame, tolerance: int = 7) -> DataFrame:
    """(interval_id, status, listing_id): listings of the ticker that cover the interval within the tolerance; one is resolved, none unmatched, more ambiguous."""
    l = listings.select(F.col("ticker").alias("_t"), "listing_id", "first_date", "last_date")  # noqa: E741
    on = (F.col("ticker") == F.col("_t")) & (F.col("valid_from") >= F.date_sub("first_date", tolerance)) & (F.col("valid_to") <= F.date_add("last_date", tolerance))
    j = intervals.join(l, on, "left").groupBy("interval_id").agg(F.count_distinct("listing_id").alias("n"), F.min("listing_id").alias("id"))
    return j.select("interval_id", F.when(F.col("n") == 0, "unmatched").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("listing_id"))


def overlapping_aliases(listings: DataFrame) -> DataFrame:
    """(ticker, a, b): distinct listings of one ticker whose spans overlap."""
    x, y = listings.alias("x"), listings.alias("y")
    on = F.expr("x.ticker = y.ticker and x.listing_id < y.listing_id and x.first_date <= y.last_date and y.first_date <= x.last_date")
    return x.join(y, on).select(F.col("x.ticker").alias("ticker"), F.col("x.listing_id").alias("a"), F.col("y.listing_id").alias("b"))


def coverage(intervals: DataFrame, prices: DataFrame, cal: DataFrame) -> DataFrame:
    """(ticker, year, expected, observed, ratio) of member days on the trading calendar."""
    span = intervals.join(F.broadcast(cal.select(F.col("date").alias("_d"))), F.col("_d").between(F.col("valid_from"), F.col("valid_to")))
    want = span.select("ticker", F.col("_d").alias("date")).distinct()
    have = prices.select("ticker", "date").distinct().withColumn("_h", F.lit(1))
    j = want.join(have, ["ticker", "date"], "left").groupBy("ticker", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("expected"), F.count("_h").alias("observed"))
    return j.withColumn("ratio", F.col("observed") / F.col("expected"))


def price_jumps(bars: DataFrame, actions: DataFrame, threshold: float = 0.5, days: int = 3) -> DataFrame:
    """(ticker, date, ret, actions): moves above the threshold with the kinds of action within so many days."""
    w = Window.partitionBy("ticker").orderBy("date")
    j = bars.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).where(F.abs("ret") > threshold).select("ticker", "date", "ret")
    a = actions.select(F.col("ticker").alias("_t"), F.col("date").alias("_d"), "kind")
    hit = j.join(a, (F.col("ticker") == F.col("_t")) & F.col("_d").between(F.date_sub("date", days), F.date_add("date", days)), "left")
    return hit.groupBy("ticker", "date", "ret").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("actions"))


def mask_seams(bars: DataFrame, seams: DataFrame, horizons=(1, 5, 21)) -> DataFrame:
    """bars with ret_<h> set NULL on the h rows before a seam date's row."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = bars.withColumn("_p", F.row_number().over(w))
    s = rows.join(seams.select("ticker", F.col("date"), F.lit(1).alias("_seam")), ["ticker", "date"], "left")
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    nxt = F.last(F.when(F.col("_seam") == 1, F.col("_p")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_n", nxt)
    for h in horizons:
        s = s.withColumn(f"ret_{h}d", F.when(F.col("_n").isNull() | (F.col("_n") - F.col("_p") > h), F.col(f"ret_{h}d")))
    return s.drop("_p", "_seam", "_n")


def calendar_gaps(cal: DataFrame, start: str, end: str) -> DataFrame:
    """One row: weekdays in the range, trading days on them, share, longest gap in days, digest of the dates."""
    week = cal.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")).where(F.dayofweek("date").between(2, 6))
    days = cal.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("date")
    n = week.agg(F.count(F.lit(1)).alias("weekdays"))
    on = week.join(days, "date", "left_semi").agg(F.count(F.lit(1)).alias("covered"))
    gap = days.withColumn("_g", F.datediff("date", F.lag("date").over(Window.orderBy("date")))).agg(F.max("_g").alias("longest_gap"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("date").cast("string"))), ","), 256).alias("digest"))
    return n.crossJoin(on).crossJoin(gap).withColumn("share", F.col("covered") / F.col("weekdays"))  # one row each


def set_similarity(a: DataFrame, b: DataFrame, by: str, item: str) -> DataFrame:
    """(by, n_a, n_b, common, jaccard) of two exploded sets per group."""
    x, y = a.select(by, item).distinct().withColumn("_a", F.lit(1)), b.select(by, item).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, [by, item], "full").groupBy(by).agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("common"), F.count(F.lit(1)).alias("u"))
    return j.select(by, "n_a", "n_b", "common", (F.col("common") / F.col("u")).alias("jaccard"))


def gate_status(gates: DataFrame) -> DataFrame:
    """One row: FAIL with any high issue, REVIEW with any to review, else PASS; gates: (gate, severity, issues)."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("issues"))), F.lit(0))
    return gates.agg(n("high").alias("high"), n("review").alias("review")).withColumn("status", F.when(F.col("high") > 0, "FAIL").when(F.col("review") > 0, "REVIEW").otherwise("PASS"))


def relisted_trades(trades: DataFrame, key: list[str]) -> DataFrame:
    """Trades listed in several disclosures collapse to the earliest; identical lots of one disclosure stay apart by an occurrence number."""
    occ = F.row_number().over(Window.partitionBy(*key, "disclosure").orderBy("row_id"))
    t = trades.withColumn("occurrence", occ)
    w = Window.partitionBy(*key, "occurrence")
    t = t.withColumn("is_refiled", F.size(F.collect_set("disclosure").over(w)) > 1)
    return t.withColumn("_rn", F.row_number().over(w.orderBy("disclosed", "disclosure", "row_id"))).where("_rn = 1").drop("_rn")
