"""Event operators: onsets, trigger rules, windows on a trading calendar, calendar-time books and matched controls.

A calendar is (date, pos), one row per trading day; it is broadcast.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pit import dense_calendar


def _days(col: str = "date"):
    return F.datediff(F.col(col), F.lit("1970-01-01"))


def cluster_onsets(buys: DataFrame, window_days: int = 21, owners: int = 2) -> DataFrame:
    """(ticker, date): dates on which the distinct owners of the trailing window first reach ``owners``.

    The window holds both its ends. An onset needs that the window, without
    the date's own arrivals, was below the bar; a date with its bar reached
    and the window below before is an onset, so re-arming needs no state.
    """
    b = buys.select("ticker", "date", "owner").distinct().withColumn("_d", _days())
    w = Window.partitionBy("ticker").orderBy("_d")
    now = F.size(F.collect_set("owner").over(w.rangeBetween(-window_days, 0)))
    before = F.size(F.collect_set("owner").over(w.rangeBetween(-window_days, -1)))
    rows = b.withColumn("now", now).withColumn("before", before)
    return rows.where((F.col("now") >= owners) & (F.col("before") < owners)).select("ticker", "date").distinct()


def concurrency(events: DataFrame, window_days: int = 21, years: int = 3, pct: float = 0.8, least: int = 30) -> DataFrame:
    """Per event date: events of the whole market in (d - window, d], and whether it reaches the quantile of the counts of the events in (d - years, d)."""
    per = events.groupBy("date").agg(F.count(F.lit(1)).alias("n")).withColumn("_d", _days())
    w = Window.orderBy("_d")  # one row per date
    per = per.withColumn("count", F.sum("n").over(w.rangeBetween(-(window_days - 1), 0)))
    prior = per.select(F.col("date").alias("_pd"), F.col("count").alias("_pc"), F.col("n").alias("_pn"))
    j = per.join(prior, (F.col("_pd") < F.col("date")) & (F.col("_pd") > F.add_months("date", -12 * years)), "left")
    q = j.groupBy("date", "n", "count").agg(F.sum("_pn").alias("prior"), F.percentile("_pc", F.lit(pct), F.coalesce("_pn", F.lit(1))).alias("bar"))
    bar = F.when(F.col("prior") >= least, F.col("bar"))
    return q.select("date", "n", "count", bar.alias("bar"), (F.col("count") >= bar).alias("high"))


def first_or_rare(filings: DataFrame, years: int = 3) -> DataFrame:
    """The first row of a (ticker, date) if no earlier date of the ticker lies within the years before."""
    one = filings.select("ticker", "date").distinct()
    prev = F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))
    return one.withColumn("_p", prev).where(F.col("_p").isNull() | (F.col("_p") < F.add_months("date", -12 * years))).drop("_p")


def trading_windows(triggers: DataFrame, cal: DataFrame, days: int = 126) -> DataFrame:
    """(ticker, veto_from, veto_to): from the first trading day after the trigger, so many trading days, cut at the calendar's end. A trigger known before the calendar starts has no window."""
    first = dense_calendar(cal).where("before >= 0").select(F.date_sub("day", 1).alias("date"), F.col("after").alias("_p"))
    t = triggers.join(F.broadcast(first), "date").where("_p is not null")
    last = cal.agg(F.max("pos").alias("_last"))
    t = t.crossJoin(F.broadcast(last)).withColumn("_e", F.least(F.col("_p") + days - 1, F.col("_last")))  # one row
    end = cal.select(F.col("date").alias("veto_to"), F.col("pos").alias("_e"))
    start = cal.select(F.col("date").alias("veto_from"), F.col("pos").alias("_p"))
    return t.join(F.broadcast(end), "_e").join(F.broadcast(start), "_p").select("ticker", "veto_from", "veto_to")


def not_excluded(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Panel rows outside all windows of their ticker."""
    v = windows.select(F.col("ticker").alias("_k"), "veto_from", "veto_to")
    return panel.join(v, (F.col("ticker") == F.col("_k")) & F.col("date").between(F.col("veto_from"), F.col("veto_to")), "left_anti")


def calendar_book(events: DataFrame, prices: DataFrame, cal: DataFrame, hold: int = 21, offset: int = 1) -> DataFrame:
    """(date, names, ret): each event is held on its days pos + offset .. pos + offset + hold - 1, a ticker once a day; equal weights; 0 on empty days."""
    w = Window.partitionBy("ticker").orderBy("date")
    rets = prices.select("ticker", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("r"))
    held = events.join(F.broadcast(cal), "date").select("ticker", F.explode(F.sequence(F.col("pos") + offset, F.col("pos") + offset + hold - 1)).alias("pos")).distinct()
    book = held.join(F.broadcast(cal), "pos").join(rets, ["ticker", "date"]).where("r is not null")
    day = book.groupBy("date").agg(F.count(F.lit(1)).alias("names"), F.avg("r").alias("ret"))
    return cal.select("date").join(day, "date", "left").select("date", F.coalesce("names", F.lit(0)).alias("names"), F.coalesce("ret", F.lit(0.0)).alias("ret"))


def abnormal_curve(events: DataFrame, prices: DataFrame, cal: DataFrame, offsets=(1, 5, 21, 42, 63)) -> DataFrame:
    """(ticker, date, k, car): close k trading days after the entry (the day after the event) over the entry close; all offsets or none."""
    e = events.select("ticker", "date").distinct().join(F.broadcast(cal), "date").withColumn("entry", F.col("pos") + 1)
    px = prices.join(F.broadcast(cal), "date").select("ticker", F.col("pos").alias("p"), "close")
    base = e.join(px.select("ticker", F.col("p").alias("entry"), F.col("close").alias("base")), ["ticker", "entry"])
    legs = base.withColumn("k", F.explode(F.array(*map(F.lit, offsets)))).withColumn("p", F.col("entry") + F.col("k"))
    legs = legs.join(px, ["ticker", "p"])
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker", "date"))
    return legs.withColumn("_n", n).where(F.col("_n") == len(offsets)).select("ticker", "date", "k", (F.col("close") / F.col("base") - 1).alias("car"))


def shifted_controls(events: DataFrame, prices: DataFrame, cal: DataFrame, shift: int = 252, near: int = 63) -> DataFrame:
    """(ticker, date, control_date, reason): the event's own ticker ``shift`` trading days before; reason is edge, collision or unpriced where there is none."""
    e = events.select("ticker", "date").distinct().join(F.broadcast(cal), "date").withColumn("cp", F.col("pos") - shift)
    other = e.select(F.col("ticker").alias("_t"), F.col("pos").alias("_p"))
    hit = e.join(other, (F.col("ticker") == F.col("_t")) & F.col("_p").between(F.col("cp") - near, F.col("cp") + near), "left_semi").select("ticker", "date", F.lit(True).alias("hit"))
    at = cal.select(F.col("pos").alias("cp"), F.col("date").alias("control_date"))
    px = prices.select("ticker", F.col("date").alias("control_date"), F.lit(True).alias("priced")).distinct()
    j = e.join(F.broadcast(at), "cp", "left").join(hit, ["ticker", "date"], "left").join(px, ["ticker", "control_date"], "left")
    reason = F.when(F.col("control_date").isNull(), "edge").when(F.col("hit"), "collision").when(F.col("priced").isNull(), "unpriced")
    return j.select("ticker", "date", F.when(reason.isNull(), F.col("control_date")).alias("control_date"), reason.alias("reason"))


def greedy_match(events: DataFrame, controls: DataFrame, near: int = 63) -> DataFrame:
    """(event_id, control_id, gap): nearest pairs first, each event and control once, a control's subject not again within ``near`` positions.

    Equal to walking all pairs by gap, event_id and control_id, whatever the
    distance. The global order makes the assignment sequential, so the events
    and controls meet in one task, as rows and not as pairs: a heap holds each
    event's nearest free control. A taken or blocked control never comes free
    again, so it is skipped for all events once it is met.
    """
    e = events.select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("subject"), "pos", F.lit(True).alias("event"))
    c = controls.select(F.col("control_id").alias("id"), F.col("subject").cast("string").alias("subject"), "pos", F.lit(False).alias("event"))
    rows = e.unionByName(c).dropna(subset=["id", "pos"]).withColumn("_one", F.lit(1))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        ev, co = pdf[pdf["event"]], pdf[~pdf["event"]].sort_values(["pos", "id"])
        ids, subjects, at = co["id"].tolist(), co["subject"].tolist(), co["pos"].tolist()
        n = len(at)
        right, left = list(range(n + 1)), list(range(n + 1))  # next free control from i on; of left, up to i - 1

        def root(up: list[int], i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def nearest(p: int):
            k = bisect_left(at, p)
            found = []
            if (r := root(right, k)) < n:
                found.append((at[r] - p, ids[r], r))
            if (i := root(left, k)) > 0:
                i = root(right, bisect_left(at, at[i - 1]))  # the first free one of that position
                found.append((p - at[i], ids[i], i))
            return min(found, default=None)

        heap = [(x[0], e, x[1], x[2], p) for e, p in zip(ev["id"].tolist(), ev["pos"].tolist()) if (x := nearest(p))]
        heapq.heapify(heap)
        done, used, busy, out = set(), set(), {}, []
        while heap:
            gap, e, c, i, p = heapq.heappop(heap)
            if e in done:
                continue
            free = right[i] == i and c not in used and not any(abs(at[i] - q) <= near for q in busy.get(subjects[i], ()))
            if right[i] == i:
                right[i], left[i + 1] = i + 1, i
            if free:
                done.add(e)
                used.add(c)
                busy.setdefault(subjects[i], []).append(at[i])
                out.append((e, c, gap))
            elif x := nearest(p):
                heapq.heappush(heap, (x[0], e, x[1], x[2], p))
        return pd.DataFrame(out, columns=["event_id", "control_id", "gap"])

    return rows.groupBy("_one").applyInPandas(assign, "event_id long, control_id long, gap long")


def rebalance_dates(cal: DataFrame, rule: str = "month", every: int = 21) -> DataFrame:
    """The last trading day per month or week, or every k-th day."""
    if rule == "every":
        return cal.where(F.col("pos") % every == every - 1).select("date")
    return cal.groupBy(F.date_trunc(rule, "date").alias("_p")).agg(F.max("date").alias("date")).select("date")


def equal_weight_book(prices: DataFrame, holdings: DataFrame, cal: DataFrame) -> DataFrame:
    """(date, ret) of a book bought equally at each rebalance close and left to drift; missing closes carry the last one.

    holdings: (rebalance, ticker).
    """
    dates = holdings.select("rebalance").distinct()
    seg = dates.select("rebalance", F.lead("rebalance").over(Window.orderBy("rebalance")).alias("until"))  # one row per rebalance
    days = cal.join(F.broadcast(seg), (F.col("date") >= F.col("rebalance")) & (F.col("until").isNull() | (F.col("date") <= F.col("until")))).select("rebalance", "date")
    grid = holdings.join(F.broadcast(days), "rebalance").join(prices.select("ticker", "date", "close"), ["ticker", "date"], "left")
    w = Window.partitionBy("rebalance", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("px", F.last("close", ignorenulls=True).over(w)).withColumn("base", F.first("close").over(w))
    wealth = grid.where("base is not null").groupBy("rebalance", "date").agg(F.avg(F.col("px") / F.col("base")).alias("wealth"))
    prev = F.lag("wealth").over(Window.partitionBy("rebalance").orderBy("date"))
    return wealth.withColumn("ret", F.col("wealth") / prev - 1).where("ret is not null").select("date", "ret")

