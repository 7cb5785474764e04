"""The flagship: the point-in-time feature panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fundamentals as Q
from ..operators import pit as P
from ..operators.panel import FactorSource, build_panel
from . import roles as R
from .registry import query

INTERVALS = f"""{R.SNAPSHOTS}, sc as (select date, row_number() over (order by date) as pos, coalesce(lead(date) over (order by date) - 1, date + 60) as until from (select distinct date from snaps)),
isl as (select ticker, date, until, pos - row_number() over (partition by ticker order by pos) as island from snaps join sc using (date)), iv as (select ticker, min(date) as valid_from, max(until) as valid_to from isl group by ticker, island)"""


def sources(spark, d):
    q = R.quarters(spark, d)

    def growth():
        return Q.log_growth(q, "value").select(F.col("cik").alias("ticker"), F.col("filed").alias("date"), "growth")

    def states():
        ev = R.facts(spark, d).groupBy("cik", "filed", "ddate").agg(F.round(F.sum("shares"), 2).alias("shares"))
        return P.as_of_states(ev, "cik", "filed", "ddate").select(F.col("cik").alias("ticker"), F.col("filed").alias("date"), "shares")

    return [FactorSource("asset growth", growth, ("growth",)), FactorSource("shares", states, ("shares",))]


def _last(table, cols):
    """One row per (ticker, avail): the last by the columns, as the merge takes it."""
    by = ", ".join(f"{c} desc nulls last" for c in cols)
    return f"(select * from {table} qualify row_number() over (partition by ticker, avail order by {by}) = 1)"


@query(f"""with {R.BARS}, {R.SECTORS}, {R.FACTS}, {R.QUARTERS}, {INTERVALS},
r as (select *, close / lag(close) over w - 1 as r, close / lag(close, 21) over w - 1 as m21, lead(close, 21) over w / close - 1 as f21 from bars window w as (partition by ticker order by date)),
x as (select *, case when count(r) over w21 >= 21 then stddev_samp(r) over w21 * sqrt(252) end as vol from r window w21 as (partition by ticker order by date rows between 20 preceding and current row)),
l as (select ticker, date, f21, lag(m21) over w as m21, lag(vol) over w as vol from x window w as (partition by ticker order by date)),
k as (select l.* from l where exists (select 1 from iv where iv.ticker = l.ticker and l.date between valid_from and valid_to)),
gm as (select q.cik as ticker, q.filed + 1 as avail, case when q.value > 0 and p.value > 0 then ln(q.value / p.value) end as growth, row_number() over (partition by q.cik, q.ddate order by abs(q.ddate - p.ddate - 365), p.ddate) as rk from quarters q join quarters p on p.cik = q.cik and q.ddate - p.ddate between 320 and 410 qualify rk = 1),
gn as (select ticker, avail, growth from gm where growth is not null), ev as (select cik, filed, ddate, round(sum(shares), 2) as shares from facts group by 1, 2, 3),
st as (select cik as ticker, filed + 1 as avail, shares from (select *, max(ddate) over (partition by cik order by filed, ddate rows unbounded preceding) as newest from ev) where ddate >= newest qualify row_number() over (partition by cik, filed order by ddate desc) = 1),
j as (select k.*, g.growth from k asof left join {_last('gn', ['growth'])} g on g.ticker = k.ticker and k.date >= g.avail), h as (select j.*, s.shares from j asof left join st s on s.ticker = j.ticker and j.date >= s.avail)
select h.ticker, date, coalesce(sector, 'UNKNOWN') as sector, round(m21, 6) as momentum_21d, round(vol, 6) as volatility_21d, round(growth, 6) as growth, shares, round(f21, 6) as fwd_21d from h left join sectors using (ticker) where f21 is not null""")
def feature_panel(spark, d):
    rows = build_panel(R.bars(spark, d), R.sectors(spark, d), sources(spark, d), P.membership_intervals(R.snapshots(spark, d)), lag_controls=True)
    return rows.select("ticker", "date", "sector", F.round("momentum_21d", 6).alias("momentum_21d"), F.round("volatility_21d", 6).alias("volatility_21d"), F.round("growth", 6).alias("growth"), "shares", F.round("fwd_21d", 6).alias("fwd_21d"))
