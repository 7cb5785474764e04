"""Looks at event studies and books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import looks as L
from ..operators import portfolio as B
from ..operators.pit import calendar
from . import roles as R
from .event_queries import CAL, CRYPTO, SPIKES, crypto, spikes
from .registry import query, table

WIDE = R.BARS.replace("bars as", "single as", 1) + ", bars as (select ticker % 4 as ticker, date, avg(close) as close, sum(volume) as volume from single group by 1, 2)"


def wide(spark, d):
    return R.bars(spark, d).groupBy((F.col("ticker") % 4).alias("ticker"), "date").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))


@query(f"""with {WIDE}, {CAL}, {SPIKES}, px as (select ticker, pos as p, close from bars join cal using (date)), e as (select ev.ticker, ev.date, pos + 1 as entry from ev join cal using (date)),
l as (select e.ticker, e.date, n.k, x.close / b.close - 1 as car from e join px b on b.ticker = e.ticker and b.p = entry join (select unnest([1, 2, 3]) as k) n on true join px x on x.ticker = e.ticker and x.p = entry + k qualify count(*) over (partition by e.ticker, e.date) = 3),
o as (select *, dense_rank() over (partition by ticker order by date) as i from l), pr as (select a.k, a.car, b.car as c from o a join o b on b.i = a.i and b.k = a.k and b.ticker = (a.ticker + 1) % 4)
select k, round(avg(car), 8) as real, round(avg(c), 8) as control, round(avg(car - c), 8) as excess, count(*) as n from pr group by 1""")
def curve_look(spark, d):
    b = wide(spark, d)
    car = E.abnormal_curve(spikes(spark, d, b), b, calendar(b), (1, 2, 3))
    car = car.withColumn("i", F.dense_rank().over(Window.partitionBy("ticker").orderBy("date")))
    real = car.select(F.concat_ws("|", "ticker", "i").alias("event_id"), "k", "car")
    control = car.select(F.concat_ws("|", (F.col("ticker") + 3) % 4, "i").alias("event_id"), "k", "car")
    return L.curve(real, control).select("k", *(F.round(c, 8).alias(c) for c in ("real", "control", "excess")), "n")


@query()
def placebo_books(spark, d):
    b = wide(spark, d)
    cal, e = calendar(b), spikes(spark, d, wide(spark, d))
    out = []
    for seed in (0, 1, 2):
        looks = L.halves(E.calendar_book(L.permuted(e, b, seed), b, cal))
        out.append((seed, looks["full"]["n"], looks["full"]["mean"], looks["full"]["t"], L.decide(looks)))
    return spark.createDataFrame(out, "seed int, n long, mean double, t double, accepted boolean")


@query(f"""with {CRYPTO}, s as (select symbol, date, round(r, 9) as x from rt where r is not null), k as (select *, max(rk) over (partition by date) as n from (select *, rank() over (partition by date order by x) + (count(*) over (partition by date, x) - 1) / 2.0 as rk from s)),
e as (select *, case when n < 20 then 0 when rk >= n * (1 - 1.0 / 5) then 1 when rk <= n / 5.0 then -1 else 0 end as side from k), w as (select symbol, date, case when side <> 0 then side * 1.0 / count(*) over (partition by date, side) else 0.0 end as w from e),
g as (select rt.symbol, rt.date, r, coalesce(w, 0) as w from rt left join w using (symbol, date)), t as (select *, lead(r) over o as nr, coalesce(lag(w) over o * (1 + r), 0) as old from g window o as (partition by symbol order by date)),
dd as (select date, sum(w * coalesce(nr, 0)) as pnl, sum(abs(w - old)) as traded from t group by 1), f as (select dd.*, b.bps, pnl - traded * b.bps / 10000 as net from dd, (select unnest([0.0::double, 5.0, 20.0]) as bps) b)
select bps, round(avg(pnl) * 12, 6) as gross, round(avg(net) * 12, 6) as net, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(12), 5) as sharpe, round(avg(traded), 6) as turnover from f group by 1""")
def fee_tiers(spark, d):
    p = crypto(spark, d)
    day = B.rank_quintiles(p.select("symbol", "date", F.round("r", 9).alias("x")), p.select("symbol", "date", "r"))
    out = L.fee_tiers(day, [0.0, 5.0, 20.0], 12)
    return out.select("bps", F.round("gross", 6).alias("gross"), F.round("net", 6).alias("net"), F.round("sharpe", 5).alias("sharpe"), F.round("turnover", 6).alias("turnover"))


@query(f"with {CRYPTO}, m as (select cast(date_trunc('month', date) as date) as month, sum(r) as ret from rt group by 1) select month, round(ret, 6) as ret from m where ret is not null order by ret, month limit 1")
def worst_month(spark, d):
    return L.worst_month(crypto(spark, d).where("r is not null").select("date", F.col("r").alias("ret"))).withColumn("ret", F.round("ret", 6))


@query("with p as (select o_custkey as ticker, sum(o_totalprice) as pnl from orders group by 1) select round((select sum(pnl) from (select pnl from p order by pnl desc, ticker limit 10)) / (select sum(pnl) from p), 8) as share")
def top_names_share(spark, d):
    return L.top_share(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.sum("o_totalprice").alias("pnl"))).withColumn("share", F.round("share", 8))
