"""Fundamental signals over the quarters view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fundamentals as Q
from . import roles as R
from .registry import query, table

BASE = f"{R.FACTS}, {R.QUARTERS}"


def _match(cols="", target=365, slack=45, src="quarters"):
    return f"""m as (select q.*, p.ddate as prior_date, p.value as prior_value, p.shares as prior_shares, p.filed as prior_filed, row_number() over (partition by q.cik, q.ddate order by abs(q.ddate - p.ddate - {target}), p.ddate) as rk
  from {src} q join {src} p on p.cik = q.cik and q.ddate - p.ddate between {target - slack} and {target + slack} qualify rk = 1)"""


@query(f"with {BASE}, {_match()} select cik, ddate, prior_date, round(case when value > 0 and prior_value > 0 then ln(value / prior_value) end, 8) as growth from m")
def yoy_band_growth(spark, d):
    return Q.log_growth(R.quarters(spark, d), "value").select("cik", "ddate", "prior_date", F.round("growth", 8).alias("growth"))


def _surprise(mean):
    return f"""with {BASE}, {_match()}, c as (select q.cik, q.ddate, q.value - m.prior_value as ch from quarters q left join m on m.cik = q.cik and m.ddate = q.ddate)
select cik, ddate, round(case when count(ch) over w >= 6 then (ch - {mean}) / nullif(stddev_samp(ch) over w, 0) end, 5) as surprise from c window w as (partition by cik order by ddate rows between 8 preceding and 1 preceding)"""


@query(_surprise("0"))
def sue(spark, d):
    return Q.seasonal_surprise(R.quarters(spark, d)).select("cik", "ddate", F.round("surprise", 5).alias("surprise"))


@query(_surprise("avg(ch) over w"))
def revenue_surprise(spark, d):
    return Q.seasonal_surprise(R.quarters(spark, d), drift=True).select("cik", "ddate", F.round("surprise", 5).alias("surprise"))


@query(f"""with {BASE} select cik, ddate, round(case when count(value) over w = 4 and ddate - lag(ddate, 3) over o <= 320 then sum(value) over w end, 2) as ttm,
case when count(value) over w = 4 and ddate - lag(ddate, 3) over o <= 320 then max(filed) over w end as avail from quarters window o as (partition by cik order by ddate), w as (partition by cik order by ddate rows between 3 preceding and current row)""")
def ttm_sum(spark, d):
    return Q.ttm(R.quarters(spark, d)).select("cik", "ddate", F.round("ttm", 2).alias("ttm"), "avail")


ANNUAL = "an as (select cik, make_date(year(ddate), 12, 31) as ddate, max(filed) as filed, round(sum(value) * 1.1, 5) as value from quarters group by 1, 2), qs as (select * from quarters where not (month(ddate) = 12 and cik % 2 = 0))"


def _annual(spark, d):
    q = R.quarters(spark, d)
    an = q.groupBy("cik", F.make_date(F.year("ddate"), F.lit(12), F.lit(31)).alias("ddate")).agg(F.max("filed").alias("filed"), F.round(F.sum("value") * F.lit(1.1), 5).alias("value"))
    return an, q.where(~((F.month("ddate") == 12) & (F.col("cik") % 2 == 0)))


@query(f"""with {BASE}, {ANNUAL}, t as (select a.cik, a.ddate, a.value, a.filed, count(*) as n, sum(q.value) as three from an a join qs q on q.cik = a.cik and a.ddate - q.ddate between 45 and 330 group by 1, 2, 3, 4 having count(*) = 3)
select cik, ddate, filed, round(value, 2) as value, false as derived from qs union all
select cik, ddate, filed, round(value - three, 5), true from t where not exists (select 1 from qs where qs.cik = t.cik and qs.ddate = t.ddate)""")
def q4_derivation(spark, d):
    an, qs = _annual(spark, d)
    return Q.fourth_quarters(an, qs).withColumn("value", F.round("value", 5))


YTD = "ytd as (select cik, ddate, quarter(ddate)::int as qtrs, filed, round(sum(value) over (partition by cik, year(ddate) order by ddate), 2) as value from quarters)"


@query(f"""with {BASE}, {YTD}, df as (select y.cik, y.ddate, greatest(y.filed, p.filed) as filed, round(y.value - p.value, 2) as value, y.qtrs as rk, row_number() over (partition by y.cik, y.ddate, y.qtrs order by abs(y.ddate - p.ddate - 91), p.ddate) as k
  from ytd y join ytd p on p.cik = y.cik and y.qtrs = p.qtrs + 1 and y.ddate - p.ddate between 60 and 122 where y.qtrs > 1),
u as (select cik, ddate, filed, round(value, 2) as value, 0 as rk from ytd where qtrs = 1 union all select cik, ddate, filed, value, rk from df where k = 1)
select cik, ddate, filed, value from u qualify row_number() over (partition by cik, ddate order by rk) = 1""")
def ytd_differencing(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("cik", F.year("ddate")).orderBy("ddate")
    y = R.quarters(spark, d).select("cik", "ddate", F.quarter("ddate").alias("qtrs"), "filed", F.round(F.sum("value").over(w), 2).alias("value"))
    return Q.undo_cumulation(y).select("cik", "ddate", "filed", F.round("value", 2).alias("value"))


@query(f"""with {BASE}, j as (select *, case when shares / lag(shares) over w > 1.9 or shares / lag(shares) over w < 0.55 then 1 else 0 end as jump from quarters window w as (partition by cik order by ddate)),
c as (select *, sum(jump) over (partition by cik order by ddate rows unbounded preceding) as cum from j), {_match(src='c').replace('p.filed as prior_filed', 'p.cum as prior_cum')}
select cik, ddate, prior_date, round(case when cum = prior_cum and shares > 0 and prior_shares > 0 then ln(shares / prior_shares) end, 8) as issuance from m""")
def net_issuance_split_guard(spark, d):
    return Q.net_issuance(R.quarters(spark, d)).select("cik", "ddate", "prior_date", F.round("issuance", 8).alias("issuance"))


@query(f"""with {BASE}, {_match()}, t as (select cik, ddate, filed, case when count(value) over w = 4 and ddate - lag(ddate, 3) over o <= 320 then sum(value) over w end as ni, case when count(shares) over w = 4 and ddate - lag(ddate, 3) over o <= 320 then sum(shares) over w end as cfo
  from quarters window o as (partition by cik order by ddate), w as (partition by cik order by ddate rows between 3 preceding and current row))
select t.cik, t.ddate, round((ni - cfo) / ((m.value + m.prior_value) / 2), 6) as accruals, greatest(m.filed, m.prior_filed) as known from t join m on m.cik = t.cik and m.ddate = t.ddate where ni is not null and cfo is not null""")
def accruals(spark, d):
    q = R.quarters(spark, d)
    ni = Q.ttm(q).select("cik", "ddate", F.col("ttm").alias("ni"))
    cfo = Q.ttm(q.withColumn("value", F.col("shares"))).select("cik", "ddate", F.col("ttm").alias("cfo"))
    a = Q.average_of_year(q)
    j = ni.join(cfo, ["cik", "ddate"]).join(a, ["cik", "ddate"]).where("ni is not null and cfo is not null")
    return j.select("cik", "ddate", F.round((F.col("ni") - F.col("cfo")) / F.col("average"), 6).alias("accruals"), F.col("filed").alias("known"))


PARTS = """ff as (select cik, ddate, tag, filed, value from facts qualify row_number() over (partition by cik, ddate, tag order by filed, adsh) = 1),
pt as (select cik, ddate, max(value) filter (tag = 'A') as gp, max(filed) filter (tag = 'A') as gp_f, max(value) filter (tag = 'N') as rev, max(filed) filter (tag = 'N') as rev_f, max(value) filter (tag = 'R') as cor, max(filed) filter (tag = 'R') as cor_f from ff group by 1, 2)"""


@query(f"""with {R.FACTS.replace('group by 1, 2, 3, 4, 5, 6', 'and l_linenumber = 1 group by 1, 2, 3, 4, 5, 6')}, {PARTS}
select cik, ddate, round(coalesce(gp, rev - cor), 2) as value, case when gp is not null then gp_f else greatest(rev_f, cor_f) end as filed from pt where coalesce(gp, rev - cor) is not null""")
def gross_profit_ladder(spark, d):
    parts = Q.wide_parts(R.facts(spark, d).where("qtrs = 1"), {"gp": "A", "rev": "N", "cor": "R"})
    parts = parts.withColumn("cogs", F.lit(None).cast("double")).withColumn("cogs_f", F.lit(None).cast("date"))
    return Q.gross_profit(parts).withColumn("value", F.round("value", 2))


@query(f"""with {R.FACTS}, p as (select * from facts where tag in ('R', 'A')) select cik, ddate, qtrs, tag, filed, adsh, value from p qualify row_number() over (partition by cik, ddate, qtrs order by case tag when 'R' then 0 else 1 end, filed, adsh) = 1""")
def merge_by_priority(spark, d):
    return Q.by_priority(R.facts(spark, d), ["cik", "ddate", "qtrs"], ["R", "A"], ["filed", "adsh"]).select("cik", "ddate", "qtrs", "tag", "filed", "adsh", "value")


@query(f"""with {R.FACTS}, ff as (select cik, ddate, tag, filed, value from facts where tag in ('A', 'N') qualify row_number() over (partition by cik, ddate, tag order by filed, adsh) = 1)
select cik, ddate, tag, filed, value from ff where tag = 'A' union all select cik, ddate, tag, filed, value from ff n where tag = 'N' and not exists (select 1 from ff a where a.tag = 'A' and a.cik = n.cik and a.ddate = n.ddate)""")
def book_equity_fallback(spark, d):
    from ..operators.pit import first_filed

    f = first_filed(R.facts(spark, d).where("tag in ('A', 'N')"), ["cik", "ddate", "tag"], ["filed", "adsh"]).select("cik", "ddate", "tag", "filed", "value")
    return Q.with_fallback(f.where("tag = 'A'"), f.where("tag = 'N'"), ["cik", "ddate"])


@query(f"""with {BASE}, {_match()}, s as (select cik as ticker, min(filed) as avail, ddate, round(value - prior_value, 2) as sue from m group by cik, ddate, value, prior_value),
r as (select ticker, avail, ddate, case when sign(sue) = sign(lag(sue) over w) and sign(sue) <> 0 and ddate - lag(ddate) over w <= 190 then sue end as sue, lead(avail) over (partition by ticker order by avail, ddate) as nx from s window w as (partition by ticker order by ddate)),
u as (select ticker, avail, ddate, sue from r union all select ticker, avail + 182, ddate, null from r where sue is not null and (nx is null or nx > avail + 182))
select ticker, avail, sue from u qualify row_number() over (partition by ticker, avail order by sue is null, ddate desc) = 1""")
def streak_expiry(spark, d):
    m = Q.log_growth(R.quarters(spark, d), "value")
    return Q.streaks(m.select(F.col("cik").alias("ticker"), F.col("filed").alias("avail"), "ddate", F.round(F.col("value") - F.col("prior_value"), 2).alias("sue")))


@query("""with dv as (select distinct o_custkey as ticker, cast(o_orderdate as date) as ex_date from orders), me as (select distinct ticker, last_day(ex_date) as month_end from dv),
g as (select me.ticker, month_end, ex_date - lag(ex_date) over (partition by me.ticker, month_end order by ex_date) as gap from me join dv on dv.ticker = me.ticker and ex_date <= month_end and ex_date > cast(month_end - interval 36 month as date))
select ticker, month_end, case when median(gap) < 135 then 3 when median(gap) < 270 then 6 else 12 end as lag from g group by 1, 2 having count(*) >= 3""")
def dividend_freq(spark, d):
    dv = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("ex_date")).distinct()
    return Q.dividend_lag(dv, dv.select("ticker", F.last_day("ex_date").alias("month_end")).distinct())


@query("""with h as (select l_partkey as ticker, cast(date_trunc('quarter', l_shipdate) as date) as quarter, count(distinct l_suppkey) as holders from lineitem group by 1, 2)
select ticker, quarter, holders, case when quarter - lag(quarter) over w between 80 and 100 then holders - lag(holders) over w end as delta from h window w as (partition by ticker order by quarter)""")
def breadth_delta(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_partkey").alias("ticker"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("quarter"), F.col("l_suppkey").alias("holder"))
    return Q.breadth_change(h)


@query("""with r as (select l_suppkey as ticker, l_orderkey as filed, round(sum(l_quantity), 2) as shares from lineitem group by 1, 2), m as (select ticker, median(shares) as med from r group by 1)
select r.ticker, filed, shares from r join m using (ticker) where shares > 0 and abs(log10(shares / med)) <= 0.5""")
def scale_outliers(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_orderkey").alias("filed")).agg(F.round(F.sum("l_quantity"), 2).alias("shares"))
    return Q.without_scale_outliers(r, decades=0.5)


@query(f"""with {BASE}, s as (select cik as ticker, ddate as "end", shares from quarters), k as (select ticker, count(shares) over b as nb, count(shares) over f as nf, quantile_cont(shares, 0.5) over b as mb, quantile_cont(shares, 0.5) over f as mf from s
  window b as (partition by ticker order by "end" rows between 4 preceding and 1 preceding), f as (partition by ticker order by "end" rows between current row and 3 following))
select ticker, coalesce(max(case when nb = 4 and nf = 4 then greatest(mb / mf, mf / mb) end) >= 2.0, false) as signature from k group by 1""")
def split_signature(spark, d):
    return Q.split_signature(R.quarters(spark, d).select(F.col("cik").alias("ticker"), F.col("ddate").alias("end"), "shares"), ratio=2.0)


@query(f"""with {BASE}, rel as (select o_custkey as ticker, cast(o_orderdate as date) as fdate, max(o_orderdate + to_hours(o_orderkey % 24)) as accepted from orders group by 1, 2),
h as (select cik, ddate, max(struct_pack(fdate := fdate, accepted := accepted)) as r from quarters join rel on rel.ticker = cik and fdate > ddate and fdate <= least(filed, ddate + 95) group by 1, 2)
select q.cik, q.ddate, coalesce(case when hour(h.r.accepted) >= 16 then h.r.fdate + 1 else h.r.fdate end, q.filed) as avail from quarters q left join h on h.cik = q.cik and h.ddate = q.ddate""")
def announcement_date(spark, d):
    o = table(spark, d, "orders")
    acc = F.max(F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") % 24) * 3600)).alias("accepted")
    rel = o.groupBy(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("fdate")).agg(acc)
    return Q.after_announcement(R.quarters(spark, d), rel).select("cik", "ddate", "avail")


@query(f"""with {R.BARS}, {R.FACTS}, si as (select l_suppkey as ticker, cast(l_shipdate as date) + 14 as avail, round(sum(l_quantity), 2) as qty from lineitem where l_linenumber = 1 group by 1, 2),
st as (select cik, filed, round(sum(shares), 2) as shares from facts group by 1, 2) select si.ticker, si.avail, round(qty / nullif(shares, 0), 8) as ratio from si asof left join st on st.cik = si.ticker and si.avail >= st.filed""")
def short_interest_xs(spark, d):
    from ..operators.pit import asof_backward

    si = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("ticker"), F.date_add(F.to_date("l_shipdate"), 14).alias("avail")).agg(F.round(F.sum("l_quantity"), 2).alias("qty"))
    st = R.facts(spark, d).groupBy(F.col("cik").alias("ticker"), "filed").agg(F.round(F.sum("shares"), 2).alias("shares"))
    rows = asof_backward(si, st, "ticker", "avail", "filed", ["shares"])
    return rows.select("ticker", "avail", F.round(F.col("qty") / F.nullif("shares", F.lit(0.0)), 8).alias("ratio"))
