"""Events, books, portfolios and attribution over the bars and filings views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cross_section as C
from ..operators import events as E
from ..operators import features as X
from ..operators import portfolio as B
from ..operators.pit import calendar
from . import roles as R
from .evaluation_queries import PANEL, panel
from .registry import query, table

CAL = "cal as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from bars))"
# insider-like buys: an order is a buy of the customer's nation by the customer
BUYS = "buys as (select distinct c_nationkey as ticker, cast(o_orderdate as date) as date, c_custkey as owner from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT')"


def buys(spark, d):
    o, c = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("c_custkey").alias("owner")).distinct()


ONSETS = f"""{BUYS}, onsets as (select distinct a.ticker, a.date from buys a where
  (select count(distinct b.owner) from buys b where b.ticker = a.ticker and b.date between a.date - 21 and a.date) >= 2 and
  (select count(distinct b.owner) from buys b where b.ticker = a.ticker and b.date between a.date - 21 and a.date - 1) < 2)"""


@query(f"with {ONSETS} select * from onsets")
def cluster_onset(spark, d):
    return E.cluster_onsets(buys(spark, d))


@query(f"""with {ONSETS}, p as (select date, count(*) as n from onsets group by 1), c as (select date, n, sum(n) over (order by date range between interval 20 day preceding and current row) as cnt from p),
q as (select c.date, c.n, c.cnt, count(x.cnt) as prior, quantile_cont(x.cnt, 0.8) as bar from c left join (select c.date, c.cnt, unnest(range(c.n)) from c) x on x.date < c.date and x.date > cast(c.date - interval 36 month as date) group by 1, 2, 3)
select date, n, cnt::bigint as count, case when prior >= 30 then round(bar, 6) end as bar, cnt >= case when prior >= 30 then bar end as high from q""")
def concurrency(spark, d):
    return E.concurrency(E.cluster_onsets(buys(spark, d))).withColumn("bar", F.round("bar", 6))


@query("""with f as (select distinct o_custkey as ticker, cast(o_orderdate as date) as date from orders where o_orderpriority = '2-HIGH')
select ticker, date from (select *, lag(date) over (partition by ticker order by date) as p from f) where p is null or p < cast(date - interval 36 month as date)""")
def first_or_rare(spark, d):
    return E.first_or_rare(_high(spark, d))


def _high(spark, d):
    return table(spark, d, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"))


VETO = """f as (select distinct o_custkey as ticker, cast(o_orderdate as date) as date from orders where o_orderpriority = '2-HIGH'),
tr as (select ticker, date from (select *, lag(date) over (partition by ticker order by date) as p from f) where p is null or p < cast(date - interval 36 month as date)),
veto as (select tr.ticker, a.date as veto_from, b.date as veto_to from (select tr.*, (select min(pos) from cal where cal.date > tr.date) as p from tr where tr.date + 1 >= (select min(date) from cal)) tr join cal a on a.pos = p join cal b on b.pos = least(p + 125, (select max(pos) from cal)))"""


@query(f"with {R.BARS}, {CAL}, {VETO} select * from veto")
def veto_windows(spark, d):
    return E.trading_windows(E.first_or_rare(_high(spark, d)), calendar(R.bars(spark, d)))


@query(f"with {R.BARS}, {CAL}, {VETO} select b.ticker, b.date, b.volume from bars b where not exists (select 1 from veto v where v.ticker = b.ticker and b.date between veto_from and veto_to)")
def veto_exclusion(spark, d):
    b = R.bars(spark, d)
    return E.not_excluded(b, E.trading_windows(E.first_or_rare(_high(spark, d)), calendar(b))).select("ticker", "date", "volume")


SPIKES = "ev as (select ticker, date from (select ticker, date, volume, row_number() over (partition by ticker order by volume desc, date) as rn from bars) where rn <= 3)"


def spikes(spark, d, bars=None):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("volume"), "date"))
    return (R.bars(spark, d) if bars is None else bars).withColumn("rn", rn).where("rn <= 3").select("ticker", "date")


@query(f"""with {R.BARS}, {CAL}, {SPIKES}, r as (select ticker, date, close / lag(close) over (partition by ticker order by date) - 1 as r from bars),
h as (select distinct e.ticker, c2.date from ev e join cal c on c.date = e.date join cal c2 on c2.pos between c.pos + 1 and c.pos + 21),
k as (select h.date, count(*) as names, avg(r) as ret from h join r using (ticker, date) where r is not null group by 1) select cal.date, coalesce(names, 0) as names, round(coalesce(ret, 0), 8) as ret from cal left join k using (date)""")
def calendar_time_book(spark, d):
    b = R.bars(spark, d)
    return E.calendar_book(spikes(spark, d), b, calendar(b)).withColumn("ret", F.round("ret", 8))


@query(f"""with {R.BARS.replace('bars as', 'single as', 1)}, bars as (select ticker % 4 as ticker, date, avg(close) as close, sum(volume) as volume from single group by 1, 2), {CAL}, {SPIKES}, px as (select ticker, pos as p, close from bars join cal using (date)), e as (select ev.ticker, ev.date, pos + 1 as entry from ev join cal using (date)),
l as (select e.ticker, e.date, o.k, x.close / b.close - 1 as car from e join px b on b.ticker = e.ticker and b.p = entry join (select unnest([1, 2, 3]) as k) o on true join px x on x.ticker = e.ticker and x.p = entry + k)
select ticker, date, k, round(car, 8) as car from l qualify count(*) over (partition by ticker, date) = 3""")
def event_car(spark, d):
    b = R.bars(spark, d).groupBy((F.col("ticker") % 4).alias("ticker"), "date").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))
    return E.abnormal_curve(spikes(spark, d, b), b, calendar(b), (1, 2, 3)).withColumn("car", F.round("car", 8))


@query(f"""with {R.BARS}, {CAL}, {SPIKES}, e as (select ticker, date, pos, pos - 252 as cp from ev join cal using (date)),
j as (select e.ticker, e.date, c.date as cd, exists (select 1 from e o where o.ticker = e.ticker and o.pos between e.cp - 63 and e.cp + 63) as hit, exists (select 1 from bars b where b.ticker = e.ticker and b.date = c.date) as priced from e left join cal c on c.pos = e.cp),
k as (select *, case when cd is null then 'edge' when hit then 'collision' when not priced then 'unpriced' end as reason from j) select ticker, date, case when reason is null then cd end as control_date, reason from k""")
def matched_control_shift(spark, d):
    b = R.bars(spark, d)
    return E.shifted_controls(spikes(spark, d), b, calendar(b))


@query()
def greedy_match(spark, d):
    b = R.bars(spark, d)
    e = spikes(spark, d).join(F.broadcast(calendar(b)), "date")
    ids = F.col("ticker") * 10000 + F.col("pos")
    return E.greedy_match(e.where("ticker % 2 = 0").select(ids.alias("event_id"), "pos"), e.where("ticker % 2 = 1").select(ids.alias("control_id"), F.col("ticker").alias("subject"), "pos"))


@query(f"with {R.BARS}, {CAL} select max(date) as date from cal group by date_trunc('week', date)")
def rebalance_dates(spark, d):
    return E.rebalance_dates(calendar(R.bars(spark, d)), "week")


@query(f"""with {R.BARS}, {CAL}, rb as (select max(date) as rebalance from cal group by date_trunc('quarter', date)), sg as (select rebalance, lead(rebalance) over (order by rebalance) as until from rb),
h as (select rebalance, ticker from rb join bars on bars.date = rb.rebalance),
g as (select h.rebalance, h.ticker, cal.date, bars.close from h join sg using (rebalance) join cal on cal.date >= rebalance and (until is null or cal.date <= until) left join bars on bars.ticker = h.ticker and bars.date = cal.date),
k as (select rebalance, date, last_value(close ignore nulls) over w / first_value(close) over w as x from g window w as (partition by rebalance, ticker order by date rows unbounded preceding)),
a as (select rebalance, date, avg(x) as wealth from k group by 1, 2), r as (select date, wealth / lag(wealth) over (partition by rebalance order by date) - 1 as ret from a) select date, round(ret, 8) as ret from r where ret is not null""")
def ew_book(spark, d):
    b = R.bars(spark, d)
    cal = calendar(b)
    rb = E.rebalance_dates(cal, "quarter").select(F.col("date").alias("rebalance"))
    hold = b.join(F.broadcast(rb), F.col("date") == F.col("rebalance")).select("rebalance", "ticker")
    return E.equal_weight_book(b, hold, cal).withColumn("ret", F.round("ret", 8))


def _book(spark, d):
    p = panel(spark, d).select("date", "month", "ticker", F.col("momentum_21d").alias("score"))
    w = C.equal_weight_legs(p, key="month")
    cal = calendar(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")))  # the bars' dates, without their making
    ends = E.rebalance_dates(cal).select("date", F.trunc("date", "month").alias("month"))
    return B.share_book(R.bars(spark, d), w.join(F.broadcast(ends), "month").select("date", "ticker", "weight"))


@query()
def ls_book(spark, d):
    return _book(spark, d)


@query(f"""with {R.BARS}, {CAL}, {SPIKES}, r as (select ticker, date, close / lag(close) over (partition by ticker order by date) - 1 as r from bars),
h as (select distinct e.ticker, c2.date from ev e join cal c on c.date = e.date join cal c2 on c2.pos between c.pos + 1 and c.pos + 21),
k as (select h.date, avg(r) as ret from h join r using (ticker, date) where r is not null group by 1), s as (select cal.date, least(greatest(coalesce(ret, 0) / 100, -0.05), 0.05) as ret from cal left join k using (date)),
p as (select *, exp(sum(ln(greatest(1 + ret, 1e-12))) over (order by date)) as w from s), q as (select *, w / max(w) over (order by date) - 1 as dd from p), y as (select year(date) as y, sum(ret) as s from s group by 1)
select count(*) as n, round(avg(ret), 9) as mean, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) as sharpe, round(avg(ret) * 252, 8) as ann_return, round(min(dd), 8) as max_drawdown,
(select round(max(s) / sum(s), 6) from y) as best_year_share, (select round(min(s), 8) from y) as worst_year from q""")
def book_report(spark, d):
    b = R.bars(spark, d)
    daily = E.calendar_book(spikes(spark, d), b, calendar(b)).select("date", F.least(F.greatest(F.col("ret") / 100, F.lit(-0.05)), F.lit(0.05)).alias("ret"))
    digits = {"mean": 9, "sharpe": 6, "ann_return": 8, "max_drawdown": 8, "best_year_share": 6, "worst_year": 8}
    out = B.report(daily)
    return out.select("n", *(F.round(c, k).alias(c) for c, k in digits.items()))


CRYPTO = "px as (select o_custkey % 60 as symbol, cast(date_trunc('month', o_orderdate) as date) as date, sum(o_totalprice) as value, avg(o_totalprice) as close from orders group by 1, 2), rt as (select *, close / lag(close) over (partition by symbol order by date) - 1 as r from px)"


def crypto(spark, d):
    from ..functions.windows import over_time

    o = table(spark, d, "orders")
    px = o.groupBy((F.col("o_custkey") % 60).alias("symbol"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.sum("o_totalprice").alias("value"), F.avg("o_totalprice").alias("close"))
    return px.withColumn("r", F.col("close") / F.lag("close").over(over_time("symbol")) - 1)


@query(f"""with {CRYPTO}, u as (select symbol, date from rt qualify rank() over (partition by date order by value desc) <= 50),
s as (select symbol, date, round(r, 9) as x from rt semi join u using (symbol, date) where r is not null), k as (select *, max(rk) over (partition by date) as n from (select *, rank() over (partition by date order by x) + (count(*) over (partition by date, x) - 1) / 2.0 as rk from s)),
e as (select *, case when n < 20 then 0 when rk >= n * (1 - 1.0 / 5) then 1 when rk <= n / 5.0 then -1 else 0 end as side from k), w as (select symbol, date, case when side <> 0 then side * 1.0 / count(*) over (partition by date, side) else 0.0 end as w from e),
fu as (select o_custkey % 60 as symbol, cast(date_trunc('month', o_orderdate) as date) as date, avg(o_orderkey % 7 - 3) / 1000 as fund from orders group by 1, 2),
g as (select rt.symbol, rt.date, r, fund, coalesce(w, 0) as w from rt left join w using (symbol, date) left join fu using (symbol, date)), t as (select *, coalesce(lead(r) over o, 0) - coalesce(lead(fund) over o, 0) as nr, coalesce(lag(w) over o * (1 + r), 0) as old from g window o as (partition by symbol order by date))
select date, round(sum(w * nr), 6) + 0.0 as pnl, round(sum(abs(w - old)), 6) as traded from t group by 1""")
def crypto_ls(spark, d):
    p = crypto(spark, d)
    from pyspark.sql import Window

    top = p.withColumn("rk", F.rank().over(Window.partitionBy("date").orderBy(F.desc("value")))).where("rk <= 50").select("symbol", "date")
    o = table(spark, d, "orders")
    fund = o.groupBy((F.col("o_custkey") % 60).alias("symbol"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg((F.avg(F.col("o_orderkey") % 7 - 3) / 1000).alias("fund"))
    out = B.rank_quintiles(p.select("symbol", "date", F.round("r", 9).alias("x")), p.select("symbol", "date", "r"), universe=top, funding=fund)
    return out.select("date", (F.round("pnl", 6) + 0.0).alias("pnl"), F.round("traded", 6).alias("traded"))


@query(f"""with {CRYPTO}, m as (select date, r as m from rt where symbol = 0), j as (select rt.symbol, date, case when m is not null then r end as r, case when r is not null then m end as m from rt join m using (date))
select symbol, date, round(case when count(r) over w >= 12 then covar_samp(r, m) over w / nullif(var_samp(m) over w, 0) end, 6) as beta from j window w as (partition by symbol order by date rows between 11 preceding and current row)""")
def rolling_beta(spark, d):
    p = crypto(spark, d)
    return B.rolling_beta(p.select("symbol", "date", "r"), p.where("symbol = 0").select("date", F.col("r").alias("m")), 12).withColumn("beta", F.round("beta", 6))


@query(f"""with {CRYPTO} select symbol, date, round(case when count(r) over w >= 30 then skewness(r) over w end, 5) as skew from rt window w as (partition by symbol order by date rows between 29 preceding and current row)""")
def rolling_skew_adj(spark, d):
    return B.rolling_skew(crypto(spark, d)).withColumn("skew", F.round("skew", 5))


@query(f"""with {CRYPTO}, m as (select *, case when count(value) over w >= 12 then quantile_cont(value, 0.5) over w end as med from px window w as (partition by symbol order by date rows between 11 preceding and current row))
select symbol, date from m where med is not null qualify rank() over (partition by date order by med desc) <= 20""")
def liquid_universe(spark, d):
    return B.liquid_universe(crypto(spark, d), 12, 20)


@query(f"""with {CRYPTO}, a as (select date, avg(r) as mkt, avg(r) filter (symbol < 20) as smb, avg(r) filter (symbol = 7) as ret from rt group by 1), f as (select * from a where ret is not null and mkt is not null and smb is not null),
c as (select count(*) as n, covar_pop(mkt, ret) as ym, covar_pop(smb, ret) as ys, var_pop(mkt) as mm, var_pop(smb) as ss, covar_pop(mkt, smb) as ms, avg(ret) as y, avg(mkt) as m, avg(smb) as s, var_pop(ret) as yy from f),
b as (select *, (ym * ss - ys * ms) / (mm * ss - ms * ms) as b1, (ys * mm - ym * ms) / (mm * ss - ms * ms) as b2 from c)
select n, round(y - b1 * m - b2 * s, 7) as alpha, round(b1, 6) as mkt, round(b2, 6) as smb, round((b1 * ym + b2 * ys) / yy, 6) as r2 from b""")
def ff_ols(spark, d):
    p = crypto(spark, d)
    f = p.groupBy("date").agg(F.avg("r").alias("mkt"), F.avg(F.when(F.col("symbol") < 20, F.col("r"))).alias("smb"), F.avg(F.when(F.col("symbol") == 7, F.col("r"))).alias("ret"))
    scale = 0.01  # the driver table's returns are far larger than decimals of a day
    a = B.attribution(f.select("date", (F.col("ret") * scale).alias("ret")), f.select("date", (F.col("mkt") * scale).alias("mkt"), (F.col("smb") * scale).alias("smb")), ["mkt", "smb"], 6)
    row = (a["n"], round(a["alpha"] / scale, 7), round(a["loadings"]["mkt"], 6), round(a["loadings"]["smb"], 6), round(a["r2"], 6))
    return spark.createDataFrame([row], "n long, alpha double, mkt double, smb double, r2 double")


@query(f"""with {CRYPTO}, m as (select date, r as m from rt where symbol = 0),
j as (select rt.symbol, date, case when m is not null then r end as r, case when r is not null then m end as m from rt join m using (date)),
bt as (select symbol, date, case when count(r) over w >= 12 then covar_samp(r, m) over w / nullif(var_samp(m) over w, 0) end as beta from j window w as (partition by symbol order by date rows between 11 preceding and current row)),
s as (select 'reversal' as sleeve, symbol, date, round(-r, 9) as x from rt where r is not null union all select 'size', symbol, date, round(value, 2) from rt),
k as (select *, max(rk) over (partition by sleeve, date) as n from (select *, rank() over (partition by sleeve, date order by x) + (count(*) over (partition by sleeve, date, x) - 1) / 2.0 as rk from s)),
e as (select *, case when n < 20 then 0 when rk >= n * (1 - 1.0 / 5) then 1 when rk <= n / 5.0 then -1 else 0 end as side from k),
h as (select sleeve, symbol, date, case when side <> 0 then side * 1.0 / count(*) over (partition by sleeve, date, side) else 0.0 end as w from e),
g as (select l.sleeve, rt.symbol, rt.date, r, coalesce(w, 0) as w, beta from rt cross join (values ('reversal'), ('size')) l(sleeve) left join h on h.sleeve = l.sleeve and h.symbol = rt.symbol and h.date = rt.date left join bt on bt.symbol = rt.symbol and bt.date = rt.date),
t as (select *, coalesce(lead(r) over o, 0) as nr, coalesce(lag(w) over o * (1 + r), 0) as old from g window o as (partition by sleeve, symbol order by date)),
b as (select sleeve, date, sum(w * nr) - 0.0005 * sum(abs(w - old)) as ret, coalesce(sum(w * beta), 0) as beta from t group by 1, 2 having sum(abs(w)) > 0),
f as (select * from b qualify count(*) over (partition by date) = (select count(distinct sleeve) from b)),
iv as (select sleeve, (1 / stddev_samp(ret)) / sum(1 / stddev_samp(ret)) over () as v from f group by 1),
d as (select date, sum(ret * v) as raw, sum(beta * v) as bb from f join iv using (sleeve) group by 1),
nm as (select date, lead(m) over (order by date) as m from m),
z as (select date, raw, raw - bb * m - coalesce(abs(bb - lag(bb) over (order by date)), 0) * 0.0005 as hedged from d left join nm using (date)),
v as (select *, case when count(hedged) over w = 12 then stddev_samp(hedged) over w * sqrt(12) end as vol from z window w as (order by date rows between 12 preceding and 1 preceding)),
l as (select *, case when vol > 0 then least(3.0, 0.15 / vol) when vol = 0 then 3.0 end as lev from v)
select date, round(raw, 6) + 0.0 as raw, round(hedged, 6) + 0.0 as hedged, round(hedged * lev - coalesce(abs(lev - lag(lev) over (order by date)), 0) * 2 * 0.0005, 6) + 0.0 as ret from l""")
def sleeve_combo(spark, d):
    from pyspark.sql import Window

    p = crypto(spark, d)
    rets, market = p.select("symbol", "date", "r"), p.where("symbol = 0").select("date", F.col("r").alias("m"))
    betas = B.rolling_beta(rets, market, 12)
    legs = [B.sleeve(p.select("symbol", "date", x.alias("x")), rets, betas).select(F.lit(n).alias("sleeve"), "date", "ret", "beta") for n, x in (("reversal", F.round(-F.col("r"), 9)), ("size", F.round("value", 2)))]
    after = market.select("date", F.lead("m").over(Window.orderBy("date")).alias("m"))  # one row per date
    out = B.combine_sleeves(legs[0].unionByName(legs[1]), after, n=12, year_days=12)
    return out.select("date", *((F.round(c, 6) + 0.0).alias(c) for c in ("raw", "hedged", "ret")))
