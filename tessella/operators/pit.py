"""Point-in-time operators: what was known when.

All take long tables. A ``key`` column names the entity, dates are DATE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_filed(facts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The earliest filing of each fact, by a total order."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return facts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a total order."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_of_states(events: DataFrame, key: str, avail: str, period: str) -> DataFrame:
    """At most one row per (key, avail), its period never going back.

    Rows that describe an older period than one known before are dropped;
    of those made available on one date the latest period stays.
    """
    order = Window.partitionBy(key).orderBy(avail, period)
    newest = F.max(period).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = events.withColumn("_newest", newest).where(F.col(period) >= F.col("_newest")).drop("_newest")
    return last_per(kept, [key, avail], [period])


def asof_backward(left: DataFrame, right: DataFrame, key: str, on: str, right_on: str, cols: list[str], lag_days: int = 0, carry_nulls: bool = True) -> DataFrame:
    """The latest right row with right_on + lag_days <= on, per key.

    One shuffle: both sides are unioned and the last right struct is carried
    along the order, so a hot key costs a sort, not a product. With
    carry_nulls a NULL right value blanks an older one; without, each column
    keeps its last known value. Right rows of one date: any order is up to
    the caller, who passes at most one (see last_per).
    """
    lcols = left.columns
    payload = F.struct(*(F.col(c).alias(c) for c in cols))
    a = left.select(F.col(key).alias("_k"), F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    r = right.select(F.col(key).alias("_k"), F.date_add(right_on, lag_days).alias("_t") if lag_days else F.col(right_on).alias("_t"), F.lit(0).alias("_side"), payload.alias("_r"))
    both = a.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if carry_nulls:
        seen = both.withColumn("_s", F.last("_r", ignorenulls=True).over(w))
        values = [F.col(f"_s.{c}").alias(c) for c in cols]
    else:
        seen = both
        for c in cols:
            seen = seen.withColumn(f"_s_{c}", F.last(F.col(f"_r.{c}"), ignorenulls=True).over(w))
        values = [F.col(f"_s_{c}").alias(c) for c in cols]
    return seen.where("_side = 1").select(*(F.col(f"_l.{c}").alias(c) for c in lcols), *values)


def asof_backward_many(left: DataFrame, sources: list[tuple[DataFrame, str, list[str], int]], key: str, on: str) -> DataFrame:
    """asof_backward of several (right, right_on, cols, lag_days) at once: one exchange and one sort for all.

    A NULL right value blanks an older one of its source. Rights have at
    most one row per (key, date).
    """
    lcols = left.columns
    both = left.select(F.col(key).alias("_k"), F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    for i, (right, right_on, cols, lag) in enumerate(sources):
        known = F.date_add(right_on, lag) if lag else F.col(right_on)
        r = right.select(F.col(key).alias("_k"), known.alias("_t"), F.lit(0).alias("_side"), F.struct(*cols).alias(f"_r{i}"))
        both = both.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.select("_side", "_l", *(F.last(f"_r{i}", ignorenulls=True).over(w).alias(f"_s{i}") for i in range(len(sources)))).where("_side = 1")
    return seen.select(*(F.col(f"_l.{c}").alias(c) for c in lcols), *(F.col(f"_s{i}.{c}").alias(c) for i, (_, _, cols, _) in enumerate(sources) for c in cols))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, on: str, right_on: str, cols: list[str], tolerance_days: int) -> DataFrame:
    """The nearest right row within tolerance_days; a tie goes to the earlier date."""
    lcols = left.columns
    payload = F.struct(F.col(right_on).alias("_d"), *(F.col(c).alias(c) for c in cols))
    a = left.select(F.col(key).alias("_k"), F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    r = right.select(F.col(key).alias("_k"), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), payload.alias("_r"))
    both = a.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy("_k").orderBy("_t", "_side")
    back = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # looking ahead is looking back in the other order: frames that only grow cost one pass
    fwd = F.last("_r", ignorenulls=True).over(Window.partitionBy("_k").orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = both.withColumn("_b", back).withColumn("_f", fwd).where("_side = 1")
    gap_b, gap_f = F.datediff("_t", "_b._d"), F.datediff("_f._d", "_t")
    use_b = F.coalesce(gap_b <= gap_f, gap_b.isNotNull())
    pick = F.when(use_b, F.col("_b")).otherwise(F.col("_f"))
    seen = seen.withColumn("_p", pick).withColumn("_p", F.when(F.least(gap_b, gap_f) <= tolerance_days, F.col("_p")))
    return seen.select(*(F.col(f"_l.{c}").alias(c) for c in lcols), *(F.col(f"_p.{c}").alias(c) for c in cols))


def band_self_match(df: DataFrame, key: str, date: str, value: str, target: int, slack: int) -> DataFrame:
    """Each row with the older row of its key whose gap is nearest to target days, within slack; a tie goes to the oldest.

    The join is on key and month of the shifted date (at most a few months
    apart), so candidates are bounded by the band, not by the history.
    """
    months = lambda c: F.year(c) * 12 + F.month(c)
    cur = df.withColumn("_m", F.explode(F.sequence(months(F.date_sub(date, target + slack)), months(F.date_sub(date, target - slack)))))
    old = df.select(F.col(key).alias("_k"), F.col(date).alias("prior_date"), F.col(value).alias("prior_value"), months(date).alias("_om"))
    gap = F.datediff(F.col(date), F.col("prior_date"))
    hit = cur.join(old, (F.col(key) == F.col("_k")) & (F.col("_m") == F.col("_om")) & gap.between(target - slack, target + slack))
    w = Window.partitionBy(key, date).orderBy(F.abs(gap - target), "prior_date")
    return hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_k", "_m", "_om")


def membership_intervals(snapshots: DataFrame, carry_days: int = 60) -> DataFrame:
    """(date, ticker) snapshot rows -> (ticker, valid_from, valid_to), both ends included.

    A snapshot holds until the day before the next, the last for carry_days;
    a ticker's consecutive snapshots merge into one spell.
    """
    dates = snapshots.select("date").distinct()
    w = Window.orderBy("date")  # one row per snapshot date
    cal = dates.select("date", F.row_number().over(w).alias("pos"), F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.date_add("date", carry_days)).alias("until"))
    rows = snapshots.select("date", "ticker").distinct().join(F.broadcast(cal), "date")
    t = Window.partitionBy("ticker").orderBy("pos")
    rows = rows.withColumn("island", F.col("pos") - F.row_number().over(t))
    return rows.groupBy("ticker", "island").agg(F.min("date").alias("valid_from"), F.max("until").alias("valid_to")).drop("island")


def member_rows(panel: DataFrame, intervals: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """Panel rows whose date lies in one of the key's intervals (equi-join on the key, then the range)."""
    i = intervals.select(F.col("ticker").alias("_k"), "valid_from", "valid_to")
    on = (F.col(key) == F.col("_k")) & F.col(date).between(F.col("valid_from"), F.col("valid_to"))
    return panel.join(i, on, "left_semi")


def calendar(dates: DataFrame) -> DataFrame:
    """(date, pos) with pos from 0; one row per trading day, so a single sort is bounded by the calendar."""
    return dates.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))


MARGIN = 20_000  # days around a trading calendar that lookups cover


def dense_calendar(cal: DataFrame) -> DataFrame:
    """(day, before, after) for every calendar day in and around a trading calendar: the position of the last trading day
    up to the day (-1 before the first) and of the first from the day on (NULL after the last). Bounded by the calendar,
    so lookups are hash joins against a broadcast of it, not range joins."""
    span = cal.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence(F.date_sub("a", MARGIN), F.date_add("b", MARGIN))).alias("day"))
    w = Window.orderBy("day")
    j = days.join(cal.select(F.col("date").alias("day"), "pos"), "day", "left")
    before = F.coalesce(F.last("pos", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    return j.select("day", before.alias("before"), F.last("pos", ignorenulls=True).over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)).alias("after"))


def positions(df: DataFrame, cal: DataFrame, day: str, name: str) -> DataFrame:
    """df with the position of the last trading day up to ``day`` (-1 before the first)."""
    d = dense_calendar(cal).select(F.col("day").alias("_day"), F.col("before").alias(name))
    return df.join(F.broadcast(d), F.col(day) == F.col("_day"), "left").drop("_day")
