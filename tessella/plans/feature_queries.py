"""Window features over the bars view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators.pit import calendar
from . import roles as R
from .registry import query, table


def _r(df, keys, cols, digits=6):
    return df.select(*keys, *(F.round(c, digits).alias(c) for c in cols))


@query(f"""with {R.BARS} select ticker, date, round(lead(close, 1) over w / close - 1, 6) as fwd_1d, round(lead(close, 5) over w / close - 1, 6) as fwd_5d,
round(lead(close, 21) over w / close - 1, 6) as fwd_21d from bars window w as (partition by ticker order by date)""")
def forward_returns(spark, d):
    return _r(X.forward_returns(R.bars(spark, d)), ["ticker", "date"], ["fwd_1d", "fwd_5d", "fwd_21d"])


@query(f"""with {R.BARS} select ticker, date, round(close / lag(close, 21) over w - 1, 6) as momentum_21d, round(close / lag(close, 5) over w - 1, 6) as momentum_5d,
round(lag(close, 21) over w / lag(close, 252) over w - 1, 6) as momentum_252_21 from bars window w as (partition by ticker order by date)""")
def momentum_features(spark, d):
    return _r(X.momentum(R.bars(spark, d)), ["ticker", "date"], ["momentum_21d", "momentum_5d", "momentum_252_21"])


RISK = f"""{R.BARS}, rets as (select *, close / lag(close, 1) over (partition by ticker order by date) - 1 as r, nullif(close * volume, 0) as dv from bars),
risk as (select ticker, date, close, volume,
  case when count(r) over w21 >= 21 then stddev_samp(r) over w21 * sqrt(252) end as volatility_21d,
  case when count(volume) over w63 >= 63 then (volume - avg(volume) over w63) / nullif(stddev_samp(volume) over w63, 0) end as volume_zscore,
  case when count(dv) over w63 >= 63 then ln(quantile_cont(dv, 0.5) over w63) end as log_dollar_volume
  from rets window w21 as (partition by ticker order by date rows between 20 preceding and current row), w63 as (partition by ticker order by date rows between 62 preceding and current row))"""


@query(f"with {RISK} select ticker, date, round(volatility_21d, 6) as volatility_21d, round(volume_zscore, 6) as volume_zscore, round(log_dollar_volume, 6) as log_dollar_volume from risk")
def risk_features(spark, d):
    return _r(X.risk(R.bars(spark, d)), ["ticker", "date"], ["volatility_21d", "volume_zscore", "log_dollar_volume"])


@query(f"""with {RISK} select ticker, date, round(lag(volatility_21d) over w, 6) as volatility_21d, round(lag(volume_zscore) over w, 6) as volume_zscore
from risk window w as (partition by ticker order by date)""")
def lag_controls(spark, d):
    cols = ["volatility_21d", "volume_zscore"]
    return _r(X.lagged(X.risk(R.bars(spark, d)).select("ticker", "date", *cols), cols), ["ticker", "date"], cols)


@query(f"""with {R.BARS}, q as (select *, count(volume) over w as n, quantile_cont(volume, 0.9) over w as hi, quantile_cont(volume, 0.1) over w as lo
from bars window w as (partition by ticker order by date rows between 49 preceding and 1 preceding))
select ticker, date, case when n < 49 then null when volume > hi then 1 when volume < lo then -1 else 0 end as event from q""")
def high_volume_event(spark, d):
    return X.high_volume_event(R.bars(spark, d)).select("ticker", "date", "event")


@query(f"""with {R.BARS}, m as (select ticker, cast(date_trunc('month', date) as date) as month, sum(volume) as vol, year(min(date)) * 12 + month(min(date)) - 1 as k, count(distinct date) as nd from bars group by 1, 2),
a as (select cast(date_trunc('month', date) as date) as month, count(distinct date) as every from bars group by 1)
select ticker, month, round(case when count(vol) over w >= 30 and avg(vol) over w > 0 then regr_slope(vol, k) over w / avg(vol) over w end, 6) as trend
from m join a using (month) where nd >= least(5, every) window w as (partition by ticker order by k range between 59 preceding and current row)""")
def volume_trend(spark, d):
    return _r(X.volume_trend(R.bars(spark, d), full=5), ["ticker", "month"], ["trend"])


@query(f"""with {R.BARS} select ticker, cast(date_trunc('month', date) as date) as month, max(date) as date, round(arg_max(close, date), 6) as close from bars group by 1, 2""")
def month_last_row(spark, d):
    return X.last_of_month(R.bars(spark, d)).select("ticker", "month", "date", F.round("close", 6).alias("close"))


@query("""with e as (select user_id as ticker, cast(ts as date) as date, count(*) as n from events group by 1, 2),
cal as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from e where isodow(date) < 6)),
k as (select e.ticker, cal.pos, sum(e.n) as n from e asof join cal on e.date <= cal.date where e.date >= (select min(date) from cal) group by 1, 2),
g as (select t.ticker, cal.pos, cal.date, coalesce(k.n, 0) as n from (select distinct ticker from k) t cross join cal left join k on k.ticker = t.ticker and k.pos = cal.pos),
c as (select *, case when count(n) over w >= 3 then sum(n) over w end as cnt from g window w as (partition by ticker order by pos rows between 2 preceding and current row)),
o as (select *, lag(cnt, 3) over (partition by ticker order by pos) as old from c)
select ticker, date, cnt::bigint as cnt, round(case when count(old) over w >= 5 then (cnt - avg(old) over w) / nullif(stddev_samp(old) over w, 0) end, 6) as z
from o window w as (partition by ticker order by pos rows between 9 preceding and current row)""")
def freq_z_daily(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"))
    return _r(X.event_count_z(e, calendar(e.where("weekday(date) < 5")), 3, 10, 5), ["ticker", "date", "cnt"], ["z"])


@query("""with e as (select o_custkey as ticker, year(o_orderdate) * 12 + month(o_orderdate) - 1 as m, count(*) as n from orders group by 1, 2),
g as (select t.ticker, k.m, coalesce(e.n, 0) as n from (select distinct ticker from e) t cross join (select unnest(range((select min(m) from e), (select max(m) + 1 from e))) as m) k left join e on e.ticker = t.ticker and e.m = k.m)
select ticker, last_day(make_date((m // 12)::int, (m % 12 + 1)::int, 1)) as date, n, round(case when count(n) over w >= 6 then (n - avg(n) over w) / nullif(stddev_samp(n) over w, 0) end, 6) as z
from g window w as (partition by ticker order by m rows between 23 preceding and current row)""")
def freq_z_monthly(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"))
    return _r(X.event_count_z_monthly(e), ["ticker", "date", "n"], ["z"])
