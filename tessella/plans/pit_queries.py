"""Point-in-time layer over the facts, quarters and snapshots views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pit as P
from . import roles as R
from .registry import query, table


@query(f"""with {R.FACTS} select cik, tag, qtrs, ddate, filed, adsh, value from facts qualify row_number() over (partition by cik, tag, qtrs, ddate order by filed, adsh) = 1""")
def first_filed(spark, d):
    f = P.first_filed(R.facts(spark, d), ["cik", "tag", "qtrs", "ddate"], ["filed", "adsh"])
    return f.select("cik", "tag", "qtrs", "ddate", "filed", "adsh", "value")


STATES = """ev as (select cik, filed, ddate, round(sum(value), 2) as value from facts group by 1, 2, 3),
st as (select cik, filed, ddate, value from (select *, max(ddate) over (partition by cik order by filed, ddate rows unbounded preceding) as newest from ev) where ddate >= newest
qualify row_number() over (partition by cik, filed order by ddate desc) = 1)"""


def states(spark, d):
    ev = R.facts(spark, d).groupBy("cik", "filed", "ddate").agg(F.round(F.sum("value"), 2).alias("value"))
    return P.as_of_states(ev, "cik", "filed", "ddate")


@query(f"with {R.FACTS}, {STATES} select * from st")
def as_of_states(spark, d):
    return states(spark, d).select("cik", "filed", "ddate", "value")


def _asof(lag):
    return f"""with {R.BARS}, {R.FACTS}, {STATES} select b.ticker, b.date, s.ddate, s.value from bars b asof left join (select cik, filed + {lag} as at, ddate, value from st) s on b.ticker = s.cik and b.date >= s.at"""


@query(_asof(0))
def asof_backward(spark, d):
    return P.asof_backward(R.bars(spark, d).select("ticker", "date"), states(spark, d).withColumnRenamed("cik", "ticker"), "ticker", "date", "filed", ["ddate", "value"])


@query(_asof(1))
def asof_lagged(spark, d):
    return P.asof_backward(R.bars(spark, d).select("ticker", "date"), states(spark, d).withColumnRenamed("cik", "ticker"), "ticker", "date", "filed", ["ddate", "value"], lag_days=1)


def _blanks(spark, d):
    return states(spark, d).select(F.col("cik").alias("ticker"), "filed", F.when(F.month("filed") % 3 != 0, F.col("value")).alias("value"))


@query(f"""with {R.BARS}, {R.FACTS}, {STATES} select b.ticker, b.date, s.value from bars b asof left join (select cik, filed, case when month(filed) % 3 <> 0 then value end as value from st) s on b.ticker = s.cik and b.date >= s.filed""")
def asof_carry_nulls(spark, d):
    return P.asof_backward(R.bars(spark, d).select("ticker", "date"), _blanks(spark, d), "ticker", "date", "filed", ["value"])


@query(f"""with {R.BARS}, {R.FACTS}, {STATES} select b.ticker, b.date, s.value from bars b asof left join (select * from st where month(filed) % 3 <> 0) s on b.ticker = s.cik and b.date >= s.filed""")
def asof_skip_nulls(spark, d):
    return P.asof_backward(R.bars(spark, d).select("ticker", "date"), _blanks(spark, d), "ticker", "date", "filed", ["value"], carry_nulls=False)


@query(f"""with {R.QUARTERS.replace('quarters as', R.FACTS + ', quarters as', 1)}, {R.FILINGS.replace('filings as', 'fl as', 1)},
j as (select f.ticker, f.fdate, q.ddate, q.value, row_number() over (partition by f.ticker, f.fdate order by abs(f.fdate - q.ddate) nulls last, q.ddate) as rn
  from fl f left join quarters q on q.cik = f.ticker and abs(f.fdate - q.ddate) <= 20) select ticker, fdate, ddate, value from j where rn = 1""")
def asof_nearest_tol(spark, d):
    right = R.quarters(spark, d).select(F.col("cik").alias("ticker"), "ddate", "value")
    return P.asof_nearest(R.filings(spark, d).select("ticker", "fdate"), right, "ticker", "fdate", "ddate", ["ddate", "value"], 20)


INTERVALS = f"""{R.SNAPSHOTS}, cal as (select date, row_number() over (order by date) as pos, coalesce(lead(date) over (order by date) - 1, date + 60) as until from (select distinct date from snaps)),
isl as (select ticker, date, until, pos - row_number() over (partition by ticker order by pos) as island from snaps join cal using (date)),
iv as (select ticker, min(date) as valid_from, max(until) as valid_to from isl group by ticker, island)"""


@query(f"with {INTERVALS} select * from iv")
def membership_spells(spark, d):
    return P.membership_intervals(R.snapshots(spark, d))


@query(f"with {R.BARS}, {INTERVALS} select b.ticker, b.date, b.volume from bars b where exists (select 1 from iv where iv.ticker = b.ticker and b.date between valid_from and valid_to)")
def pit_membership(spark, d):
    return P.member_rows(R.bars(spark, d), P.membership_intervals(R.snapshots(spark, d))).select("ticker", "date", "volume")


@query(f"""with {R.BARS}, {R.FACTS}, {STATES}, cal as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from bars)),
j as (select b.ticker, b.date, s.filed from bars b asof join st s on b.ticker = s.cik and b.date >= s.filed),
p as (select j.*, a.pos - c.pos as stale from j join cal a on a.date = j.date asof join cal c on j.filed >= c.date)
select ticker, date, filed, stale from p where stale between 0 and 40""")
def staleness_filter(spark, d):
    b = R.bars(spark, d)
    cal = P.calendar(b)
    s = states(spark, d).select(F.col("cik").alias("ticker"), "filed")
    rows = P.asof_backward(b.select("ticker", "date"), s.withColumn("seen", F.col("filed")), "ticker", "date", "seen", ["filed"]).where("filed is not null")
    days = P.positions(rows.select("filed").distinct(), cal, "filed", "pf").where("pf >= 0")  # once per filing date
    rows = rows.join(F.broadcast(cal), "date").join(F.broadcast(days), "filed")
    return rows.withColumn("stale", (F.col("pos") - F.col("pf")).cast("long")).where("stale between 0 and 40").select("ticker", "date", "filed", "stale")


@query(f"""with {R.BARS}, {R.FACTS}, ev as (select cik, filed, ddate, round(sum(shares), 2) as shares from facts group by 1, 2, 3),
st as (select * from (select *, max(ddate) over (partition by cik order by filed, ddate rows unbounded preceding) as newest from ev) where ddate >= newest qualify row_number() over (partition by cik, filed order by ddate desc) = 1)
select b.ticker, b.date, round(b.close * s.shares, 7) as cap, round(case when b.close * s.shares > 0 then ln(b.close * s.shares) end, 8) as log_cap from bars b asof left join st s on b.ticker = s.cik and b.date >= s.filed""")
def market_cap_pit(spark, d):
    ev = R.facts(spark, d).groupBy("cik", "filed", "ddate").agg(F.round(F.sum("shares"), 2).alias("shares"))
    st = P.as_of_states(ev, "cik", "filed", "ddate").withColumnRenamed("cik", "ticker")
    rows = P.asof_backward(R.bars(spark, d).select("ticker", "date", "close"), st, "ticker", "date", "filed", ["shares"])
    cap = F.col("close") * F.col("shares")
    return rows.select("ticker", "date", F.round(cap, 7).alias("cap"), F.round(F.when(cap > 0, F.ln(cap)), 8).alias("log_cap"))


@query("""with s as (select s_suppkey as ticker, s_nationkey, case when s_nationkey < 2 then 'AGRICULTURE' when s_nationkey < 5 then 'MINING' when s_nationkey < 9 then 'CONSTRUCTION' when s_nationkey < 16 then 'MANUFACTURING' else 'UNKNOWN' end as division,
  lpad(cast(s_nationkey * 100 // 100 as varchar), 2, '0') as sic2 from supplier) select ticker, division, sic2 from s""")
def sic_division(spark, d):
    ranges = [(0, 1, "AGRICULTURE"), (2, 4, "MINING"), (5, 8, "CONSTRUCTION"), (9, 15, "MANUFACTURING")]
    from ..functions.scalars import division, two_digits

    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("ticker"), division(F.col("s_nationkey"), ranges).alias("division"), two_digits(F.col("s_nationkey") * 100).alias("sic2"))


@query(f"""with {R.BARS}, {R.FACTS}, {R.QUARTERS} select coalesce(q.cik, b.ticker) as ticker, coalesce(q.ddate, b.date) as day, round(q.value, 2) as value, b.volume from quarters q full join bars b on q.cik = b.ticker and q.ddate = b.date""")
def full_outer_states(spark, d):
    q, b = R.quarters(spark, d), R.bars(spark, d)
    j = q.join(b, (F.col("cik") == F.col("ticker")) & (F.col("ddate") == F.col("date")), "full")
    return j.select(F.coalesce("cik", "ticker").alias("ticker"), F.coalesce("ddate", "date").alias("day"), F.round("value", 2).alias("value"), "volume")
