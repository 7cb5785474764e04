"""Fundamental signals from first-filed facts: (cik, ddate, filed, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import rolling
from .pit import band_self_match, first_filed, last_per


def seasonal_surprise(quarters: DataFrame, target: int = 365, slack: int = 45, n: int = 8, least: int = 6, drift: bool = False) -> DataFrame:
    """Year-on-year change over the deviation of the n changes before (with drift: less their mean). A quarter without a match keeps its place among them, as missing."""
    prior = band_self_match(quarters, "cik", "ddate", "value", target, slack).select("cik", "ddate", "prior_date", "prior_value")
    m = quarters.join(prior, ["cik", "ddate"], "left").withColumn("change", F.col("value") - F.col("prior_value"))
    w = Window.partitionBy("cik").orderBy("ddate")
    sd = F.nullif(rolling(F.stddev_samp, "change", w, n, least, lag=1), F.lit(0.0))
    mean = rolling(F.avg, "change", w, n, least, lag=1)
    return m.withColumn("surprise", (F.col("change") - (mean if drift else F.lit(0.0))) / sd)


def ttm(quarters: DataFrame, max_span: int = 320) -> DataFrame:
    """Sum of four consecutive quarters that span at most max_span days; known when the last of them was."""
    w = Window.partitionBy("cik").orderBy("ddate")
    span = F.datediff("ddate", F.lag("ddate", 3).over(w))
    ok = (F.count("value").over(w.rowsBetween(-3, 0)) == 4) & (span <= max_span)
    frame = w.rowsBetween(-3, 0)
    known = F.when(F.count("filed").over(frame) == 4, F.max("filed").over(frame))
    return quarters.withColumn("ttm", F.when(ok, F.sum("value").over(frame))).withColumn("avail", F.when(ok, known))


def fourth_quarters(annual: DataFrame, quarterly: DataFrame, lo: int = 45, hi: int = 330) -> DataFrame:
    """quarterly plus fourth quarters: the annual value less exactly three quarters that end lo..hi days before, known when the annual one is."""
    q = quarterly.select(F.col("cik").alias("_c"), F.col("ddate").alias("_d"), F.col("value").alias("_v"))
    gap = F.datediff(F.col("ddate"), F.col("_d"))
    years = F.explode(F.array(F.year("ddate"), F.year("ddate") - 1))
    both = annual.withColumn("_y", years).join(q.withColumn("_qy", F.year("_d")), (F.col("cik") == F.col("_c")) & (F.col("_y") == F.col("_qy")) & gap.between(lo, hi))
    made = both.groupBy("cik", "ddate", "value", "filed").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("three"))
    made = made.where("n = 3").select("cik", "ddate", "filed", (F.col("value") - F.col("three")).alias("value"), F.lit(True).alias("derived"))
    new = made.join(quarterly.select("cik", "ddate"), ["cik", "ddate"], "left_anti")
    return quarterly.select("cik", "ddate", "filed", "value", F.lit(False).alias("derived")).unionByName(new)


def undo_cumulation(ytd: DataFrame, target: int = 91, slack: int = 31) -> DataFrame:
    """(cik, ddate, filed, qtrs, value) year-to-date values -> single quarters: own value for one quarter, else the difference to the
    value of one quarter less that ended about a quarter before; a directly reported quarter wins."""
    one = ytd.where("qtrs = 1").select("cik", "ddate", "filed", "value", F.lit(0).alias("rank"))
    old = ytd.select(F.col("cik").alias("_c"), (F.col("qtrs") + 1).alias("_q"), F.col("ddate").alias("_d"), F.col("filed").alias("_f"), F.col("value").alias("_v"), (F.year("ddate") * 12 + F.month("ddate")).alias("_om"))
    month = lambda c: F.year(c) * 12 + F.month(c)
    cur = ytd.where("qtrs > 1").withColumn("_m", F.explode(F.sequence(month(F.date_sub("ddate", target + slack)), month(F.date_sub("ddate", target - slack)))))
    gap = F.datediff(F.col("ddate"), F.col("_d"))
    hit = cur.join(old, (F.col("cik") == F.col("_c")) & (F.col("qtrs") == F.col("_q")) & (F.col("_m") == F.col("_om")) & gap.between(target - slack, target + slack))
    w = Window.partitionBy("cik", "ddate", "qtrs").orderBy(F.abs(gap - target), "_d")
    diff = hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("cik", "ddate", F.greatest("filed", "_f").alias("filed"), (F.col("value") - F.col("_v")).alias("value"), F.col("qtrs").alias("rank"))
    return first_filed(one.unionByName(diff), ["cik", "ddate"], ["rank"]).drop("rank")


def log_growth(df: DataFrame, value: str, target: int = 365, slack: int = 45) -> DataFrame:
    """ln(value / value a year before), both positive."""
    m = band_self_match(df, "cik", "ddate", value, target, slack)
    ok = (F.col(value) > 0) & (F.col("prior_value") > 0)
    return m.withColumn("growth", F.when(ok, F.ln(F.col(value) / F.col("prior_value"))))


def net_issuance(shares: DataFrame, hi: float = 1.9, lo: float = 0.55) -> DataFrame:
    """log_growth of shares, NULL where any step since the prior date looks like a split (running count of such steps)."""
    w = Window.partitionBy("cik").orderBy("ddate")
    step = F.col("shares") / F.lag("shares", 1).over(w)
    rows = shares.withColumn("_jump", F.when((step > hi) | (step < lo), 1).otherwise(0)).withColumn("_cum", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = log_growth(rows, "shares")
    prior = rows.select(F.col("cik").alias("_k"), F.col("ddate").alias("_pd"), F.col("_cum").alias("_pc"))
    m = m.join(prior, (F.col("cik") == F.col("_k")) & (F.col("prior_date") == F.col("_pd")))
    return m.withColumn("issuance", F.when(F.col("_cum") == F.col("_pc"), F.col("growth"))).drop("_k", "_pd", "_pc", "_jump", "_cum", "growth")


def average_of_year(df: DataFrame) -> DataFrame:
    """(value + value a year before) / 2 per (cik, ddate), known when both were."""
    m = band_self_match(df, "cik", "ddate", "value", 365, 45)
    prior = df.select(F.col("cik").alias("_k"), F.col("ddate").alias("_pd"), F.col("filed").alias("_pf"))
    m = m.join(prior, (F.col("cik") == F.col("_k")) & (F.col("prior_date") == F.col("_pd")))
    return m.select("cik", "ddate", F.greatest("filed", "_pf").alias("filed"), ((F.col("value") + F.col("prior_value")) / 2).alias("average"))


def with_fallback(main: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """main plus the rows of other whose key main does not have."""
    return main.unionByName(other.join(main.select(*key).distinct(), key, "left_anti"))


def by_priority(facts: DataFrame, key: list[str], tags: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first of tags that it has, by a total order within."""
    rank = F.coalesce(*(F.when(F.col("tag") == t, i) for i, t in enumerate(tags)))
    rows = facts.withColumn("_rank", rank).where("_rank is not null")
    return first_filed(rows, key, ["_rank", *order]).drop("_rank")


def gross_profit(parts: DataFrame) -> DataFrame:
    """gp, else revenue less cost of revenue, else revenue less cost of goods; known when its parts were.

    parts: (cik, ddate, gp, gp_f, rev, rev_f, cor, cor_f, cogs, cogs_f), missing parts NULL.
    """
    way = [("gp", None), ("rev", "cor"), ("rev", "cogs")]
    value = F.coalesce(*(F.col(a) if b is None else F.col(a) - F.col(b) for a, b in way))
    known = F.coalesce(*(F.when(F.col(a).isNotNull(), F.col(f"{a}_f")) if b is None else F.when((F.col(a) - F.col(b)).isNotNull(), F.greatest(f"{a}_f", f"{b}_f")) for a, b in way))
    return parts.select("cik", "ddate", value.alias("value"), known.alias("filed")).where("value is not null")


def wide_parts(facts: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Full outer join of first-filed tags on (cik, ddate), as one aggregation: name and name_f per tag."""
    name = F.coalesce(*(F.when(F.col("tag") == t, F.lit(n)) for n, t in tags.items()))
    f = first_filed(facts.withColumn("_n", name).where("_n is not null"), ["cik", "ddate", "_n"], ["filed", "adsh"])
    cols = []
    for n in tags:
        cols += [F.max(F.when(F.col("_n") == n, F.col("value"))).alias(n), F.max(F.when(F.col("_n") == n, F.col("filed"))).alias(f"{n}_f")]
    return f.groupBy("cik", "ddate").agg(*cols)


def streaks(surprises: DataFrame, max_gap: int = 190, expiry: int = 182) -> DataFrame:
    """(ticker, avail, sue) of (ticker, ddate, avail, sue): the surprise if its sign repeats that of the period before, which ended at
    most max_gap days earlier, else NULL; and a NULL expiry row after ``expiry`` days if the next announcement comes later. Of rows of
    one day a value stays rather than a NULL, then the later period's. NULL surprises are no periods."""
    w = Window.partitionBy("ticker").orderBy("ddate")
    prev, when = F.lag("sue").over(w), F.lag("ddate").over(w)
    same = (F.signum("sue") == F.signum(prev)) & (F.signum("sue") != 0) & (F.datediff("ddate", when) <= max_gap)
    rows = surprises.where("sue is not null").select("ticker", "ddate", "avail", F.when(same, F.col("sue")).alias("sue"))
    rows = rows.withColumn("_next", F.lead("avail").over(Window.partitionBy("ticker").orderBy("avail", "ddate")))
    end = F.date_add("avail", expiry)
    ends = rows.where("sue is not null").where(F.col("_next").isNull() | (F.col("_next") > end)).select("ticker", "ddate", end.alias("avail"), F.lit(None).cast("double").alias("sue"))
    day = Window.partitionBy("ticker", "avail").orderBy(F.col("sue").isNull(), F.desc("ddate"))
    both = rows.drop("_next").unionByName(ends).withColumn("_rn", F.row_number().over(day))
    return both.where("_rn = 1").select("ticker", "avail", "sue")


def dividend_lag(dividends: DataFrame, month_ends: DataFrame) -> DataFrame:
    """(ticker, month_end, lag): 3, 6 or 12 months from the median gap of ex-dates in the 36 months before; no row under 3 ex-dates."""
    w = Window.partitionBy("ticker", "month_end").orderBy("ex_date")
    span = month_ends.join(dividends, "ticker").where((F.col("ex_date") <= F.col("month_end")) & (F.col("ex_date") > F.add_months("month_end", -36)))
    gaps = span.withColumn("gap", F.datediff("ex_date", F.lag("ex_date").over(w)))
    g = gaps.groupBy("ticker", "month_end").agg(F.percentile("gap", F.lit(0.5)).alias("med"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 3").select("ticker", "month_end", F.when(F.col("med") < 135, 3).when(F.col("med") < 270, 6).otherwise(12).alias("lag"))


def breadth_change(holdings: DataFrame, lo: int = 80, hi: int = 100) -> DataFrame:
    """(ticker, quarter, holders, delta): distinct holders per quarter, change to the quarter lo..hi days before."""
    b = holdings.groupBy("ticker", "quarter").agg(F.count_distinct("holder").alias("holders"))
    w = Window.partitionBy("ticker").orderBy("quarter")
    gap = F.datediff("quarter", F.lag("quarter").over(w))
    return b.withColumn("delta", F.when(gap.between(lo, hi), F.col("holders") - F.lag("holders").over(w)))


def resolve_classes(rows: DataFrame) -> DataFrame:
    """(ticker, end, filed, shares): share classes of one filing added up, the latest accession of a (end, filed) kept."""
    total = rows.groupBy("ticker", "end", "filed", "accn").agg(F.sum("shares").alias("shares"))
    return last_per(total, ["ticker", "end", "filed"], ["accn"]).drop("accn")


def without_scale_outliers(rows: DataFrame, value: str = "shares", key: str = "ticker", decades: float = 2.0) -> DataFrame:
    """Rows with a positive value within so many decades of the key's median."""
    med = rows.groupBy(F.col(key).alias("_k")).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    both = rows.join(med, F.col(key) == F.col("_k"))
    return both.where((F.col(value) > 0) & (F.col("_m") > 0) & (F.abs(F.log10(F.col(value) / F.col("_m"))) <= decades)).drop("_k", "_m")


def split_signature(rows: DataFrame, ratio: float = 50.0, side: int = 4) -> DataFrame:
    """(ticker, signature): some cut whose medians of ``side`` rows before and from it differ by the ratio."""
    w = Window.partitionBy("ticker").orderBy("end")
    before, after = w.rowsBetween(-side, -1), w.rowsBetween(0, side - 1)
    full = (F.count("shares").over(before) == side) & (F.count("shares").over(after) == side)
    a, b = F.percentile("shares", F.lit(0.5)).over(before), F.percentile("shares", F.lit(0.5)).over(after)
    r = F.when(full, F.greatest(a / b, b / a))
    return rows.withColumn("_r", r).groupBy("ticker").agg(F.coalesce(F.max("_r") >= ratio, F.lit(False)).alias("signature"))


def after_announcement(quarters: DataFrame, releases: DataFrame, days: int = 95, cutoff_hour: int = 16) -> DataFrame:
    """quarters with avail: the last release in (ddate, least(filed, ddate + days)], a day later if accepted from cutoff_hour on; else filed."""
    last_day = F.least("filed", F.date_add("ddate", days))
    hit = quarters.join(releases.withColumnRenamed("ticker", "_t"), (F.col("cik") == F.col("_t")) & (F.col("fdate") > F.col("ddate")) & (F.col("fdate") <= last_day))
    best = hit.groupBy("cik", "ddate").agg(F.max(F.struct("fdate", "accepted")).alias("r"))
    late = F.coalesce(F.hour("r.accepted") >= cutoff_hour, F.lit(False))
    best = best.select("cik", "ddate", F.when(late, F.date_add("r.fdate", 1)).otherwise(F.col("r.fdate")).alias("released"))
    return quarters.join(best, ["cik", "ddate"], "left").withColumn("avail", F.coalesce("released", "filed")).drop("released")
