"""Cross-sectional evaluation over the monthly panel of the bars view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import cross_section as C
from ..operators import features as X
from . import roles as R
from .registry import query

FACTORS = ["momentum_21d", "momentum_5d", "volatility_21d", "volume_zscore"]

# month-end rows with factors, sector and the 21-row forward return; factors rounded so that ties agree
PANEL = f"""{R.BARS}, {R.SECTORS}, b as (select *, close / lag(close, 1) over w - 1 as r, close / lag(close, 21) over w - 1 as m21, close / lag(close, 5) over w - 1 as m5, lead(close, 21) over w / close - 1 as f21
  from bars window w as (partition by ticker order by date)),
f as (select *, case when count(r) over w21 >= 21 then stddev_samp(r) over w21 * sqrt(252) end as vol, case when count(volume) over w63 >= 63 then (volume - avg(volume) over w63) / nullif(stddev_samp(volume) over w63, 0) end as vz
  from b window w21 as (partition by ticker order by date rows between 20 preceding and current row), w63 as (partition by ticker order by date rows between 62 preceding and current row)),
panel as (select f.ticker, cast(date_trunc('month', date) as date) as month, date, round(m21, 9) as momentum_21d, round(m5, 9) as momentum_5d, round(vol, 9) as volatility_21d, round(vz, 9) as volume_zscore, round(f21, 9) as fwd_21d, sector
  from f left join sectors s on s.ticker = f.ticker qualify row_number() over (partition by f.ticker, date_trunc('month', date) order by date desc) = 1)"""


def panel(spark, d):
    """(ticker, month, date, factors, fwd_21d, sector)."""
    b = R.bars(spark, d)
    rows = X.risk(X.momentum(X.forward_returns(b)))
    rows = X.last_of_month(rows).join(F.broadcast(R.sectors(spark, d)), "ticker", "left")
    return rows.select("ticker", "month", "date", *(F.round(c, 9).alias(c) for c in [*FACTORS, "fwd_21d"]), "sector")


def avg_rank(col, by="month"):
    return f"(rank() over (partition by {by} order by {col}) + (count(*) over (partition by {by}, {col}) - 1) / 2.0)"


IC = f"""ic as (select month, corr(rx, ry) as ic, count(*) as n from (select month, {avg_rank('momentum_21d')} as rx, {avg_rank('fwd_21d')} as ry from panel
  where momentum_21d is not null and fwd_21d is not null qualify count(*) over (partition by month) >= 20) group by 1)"""


@query(f"with {PANEL}, {IC} select month, round(ic, 6) as ic, n from ic")
def monthly_ic(spark, d, min_names=20):
    return C.monthly_ic(panel(spark, d), "momentum_21d", "fwd_21d", min_names).select("month", F.round("ic", 6).alias("ic"), "n")


Z = f"""z as (select ticker, month, sector, (r - avg(r) over (partition by month)) / nullif(stddev_pop(r) over (partition by month), 0) as z from (
  select ticker, month, sector, {avg_rank('momentum_21d')} as r from panel where momentum_21d is not null))"""


@query(f"with {PANEL}, {Z} select ticker, month, round(z, 6) as z from z where z is not null")
def xs_rank_z(spark, d):
    rows = C.add_rank_z(panel(spark, d).where("momentum_21d is not null"), ["momentum_21d"], ["month"])
    return rows.where("z_momentum_21d is not null").select("ticker", "month", F.round("z_momentum_21d", 6).alias("z"))


@query(f"with {PANEL}, {Z} select ticker, month, round(z - avg(z) over (partition by month, coalesce(sector, 'UNKNOWN')), 6) + 0.0 as z from z where z is not null")
def sector_neutral(spark, d):
    rows = C.add_rank_z(panel(spark, d).where("momentum_21d is not null"), ["momentum_21d"], ["month"], "sector")
    return rows.where("z_momentum_21d is not null").select("ticker", "month", (F.round("z_momentum_21d", 6) + 0.0).alias("z"))


def _long(col, min_names=20):
    return f"select month, '{col}' as candidate, {avg_rank(col)} as rx, {avg_rank('fwd_21d')} as ry from panel where {col} is not null and fwd_21d is not null qualify count(*) over (partition by month) >= {min_names}"


@query(f"with {PANEL}, l as ({' union all '.join(f'({_long(c)})' for c in FACTORS)}) select candidate, month, round(corr(rx, ry), 6) as ic, count(*) as n from l group by 1, 2")
def ic_by_candidate(spark, d):
    return C.ic_by_candidate(panel(spark, d), FACTORS, "fwd_21d").select("candidate", "month", F.round("ic", 6).alias("ic"), "n")


@query(f"""with {PANEL}, q as (select ticker, month, momentum_21d, {avg_rank('volatility_21d')} as rv, {avg_rank('momentum_21d')} as rm, {avg_rank('fwd_21d')} as rf from panel
  where momentum_21d is not null and fwd_21d is not null and volatility_21d is not null qualify count(*) over (partition by month) >= 20),
c as (select month, corr(rm, rf) as mf, corr(rm, rv) as mv, corr(rf, rv) as fv, count(*) as n from q group by 1),
i as (select month, mf as raw, (mf - mv * fv) / sqrt(1 - mv * mv) as inc, mv * mv as r2, n from c)
select 'momentum_21d' as candidate, count(*) as n_months, round(avg(raw), 6) as ic_raw, round(avg(raw) / (stddev_samp(raw) / sqrt(count(*))), 5) as ic_raw_t, round(avg(inc), 6) as ic_incremental,
round(avg(inc) / (stddev_samp(inc) / sqrt(count(*))), 5) as ic_incremental_t, round(avg(r2), 6) as spanned_r2 from i""")
def incremental_ic(spark, d):
    got = C.judge(panel(spark, d), ["volatility_21d"], "momentum_21d", "fwd_21d")
    digits = {"ic_raw": 6, "ic_raw_t": 5, "ic_incremental": 6, "ic_incremental_t": 5, "spanned_r2": 6}
    row = (got["candidate"], got["n_months"], *(round(got[k], n) if got["ok"] else None for k, n in digits.items()))
    return spark.createDataFrame([row], "candidate string, n_months long, ic_raw double, ic_raw_t double, ic_incremental double, ic_incremental_t double, spanned_r2 double")


@query()
def greedy_selection(spark, d):
    steps = C.greedy(panel(spark, d).cache(), FACTORS, "fwd_21d", 0.5, sector="sector")
    rows = [(i, s["candidate"], s["n_months"], s["ic_incremental"], s["ic_incremental_t"]) for i, s in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "step int, candidate string, n_months long, ic_incremental double, t double")


_H = (5, 10, 21, 42, 63, 126)


@query(f"""with {PANEL}, px as (select ticker, date, {', '.join(f'round(lead(close, {h}) over w / close - 1, 9) as f{h}' for h in _H)} from bars window w as (partition by ticker order by date)),
l as ({' union all '.join(f"select month, {h} as horizon, momentum_21d as x, f{h} as y from panel join px using (ticker, date)" for h in _H)}),
k as (select month, horizon, {avg_rank('x', 'month, horizon')} as rx, {avg_rank('y', 'month, horizon')} as ry from l where x is not null and y is not null qualify count(*) over (partition by month, horizon) >= 20),
i as (select horizon, month, corr(rx, ry) as ic from k group by 1, 2) select horizon, count(*) as n_months, round(avg(ic), 6) as mean_ic from i group by 1""")
def ic_decay(spark, d):
    px = X.forward_returns(R.bars(spark, d), _H)
    long = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.round(f"fwd_{h}d", 9).alias("y")) for h in _H)))
    rows = panel(spark, d).select("ticker", "date", "month", "momentum_21d").join(px.select("ticker", "date", long.alias("h")).select("ticker", "date", "h.*"), ["ticker", "date"])
    ic = C.monthly_ic(rows, "momentum_21d", "y", 20, ("horizon", "month"))
    return ic.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_months"), F.round(F.avg("ic"), 6).alias("mean_ic"))


BOOK = """book as (select month, ticker, cast(greatest(ceil((rn - 1) * 5.0 / (n - 1)), 1) - 1 as int) as bucket, fwd_21d as target from (
  select *, row_number() over (partition by month order by momentum_21d, ticker) as rn, count(*) over (partition by month) as n from panel where momentum_21d is not null and fwd_21d is not null) where n >= 50)"""


@query(f"""with {PANEL}, {BOOK}, pm as (select month, lag(month) over (order by month) as prev from (select distinct month from book)),
e as (select book.*, prev from book join pm using (month) where bucket in (0, 4)),
t as (select e.month, e.bucket, avg(case when o.ticker is null then 1.0 else 0.0 end) as new from e left join e o on o.month = e.prev and o.ticker = e.ticker and o.bucket = e.bucket where e.prev is not null group by 1, 2)
select b.month, round(avg(b.target) filter (b.bucket = 4) - avg(b.target) filter (b.bucket = 0), 6) as ls, round(max(tt.new), 6) as turnover_top, round(max(tb.new), 6) as turnover_bottom
from book b left join t tt on tt.month = b.month and tt.bucket = 4 left join t tb on tb.month = b.month and tb.bucket = 0 group by 1""")
def quantile_ls(spark, d):
    out = C.long_short(C.quantile_book(panel(spark, d), "momentum_21d", "fwd_21d"), 5)
    return out.select("month", *(F.round(c, 6).alias(c) for c in ("ls", "turnover_top", "turnover_bottom")))


@query(f"""with {PANEL}, pm as (select month, lead(month) over (order by month) as next from (select distinct month from panel)),
j as (select a.month, a.volatility_21d as x, b.volatility_21d as y from panel a join pm using (month) join panel b on b.month = pm.next and b.ticker = a.ticker where a.volatility_21d is not null and b.volatility_21d is not null),
k as (select month, {avg_rank('x')} as rx, {avg_rank('y')} as ry from j qualify count(*) over (partition by month) >= 30) select month, round(corr(rx, ry), 6) as rho, count(*) as n from k group by 1""")
def rank_autocorr(spark, d):
    return C.rank_autocorr(panel(spark, d), "volatility_21d").select("month", F.round("rho", 6).alias("rho"), "n")


def _series(spark, d):
    return [r.ic for r in C.monthly_ic(panel(spark, d), "momentum_21d", "fwd_21d").orderBy("month").collect()]


@query(f"""with {PANEL}, {IC}, s as (select month, ic - avg(ic) over () as e, avg(ic) over () as mu, count(*) over () as n from ic),
g as (select k, sum(a.e * b.e) as c from (select unnest(range(0, 4)) as k) join (select row_number() over (order by month) as i, * from s) a on true join (select row_number() over (order by month) as i, * from s) b on a.i = b.i + k group by 1)
select max(n) as n, round(max(mu), 6) as mean, round(max(mu) / sqrt((select sum(case when k = 0 then 1 else 2 * (1 - k / 4.0) end * c) from g) / max(n) / max(n)), 5) as t_hac from s""")
def hac_t(spark, d):
    x = _series(spark, d)
    t = stats.hac_t(x, 3)
    row = (len(x), round(sum(x) / len(x), 6), None if t is None else round(t, 5)) if x else (None, None, None)
    return spark.createDataFrame([row], "n long, mean double, t_hac double")


@query(f"""with {PANEL}, {IC} select month <= date '1998-06-01' as first_half, count(*) as n, round(avg(ic), 6) as mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 5) as t from ic group by 1""")
def split_halves(spark, d):
    ic = C.monthly_ic(panel(spark, d), "momentum_21d", "fwd_21d").withColumn("first_half", F.col("month") <= F.lit("1998-06-01").cast("date"))
    return ic.groupBy("first_half").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ic"), 6).alias("mean"), F.round(F.avg("ic") / (F.stddev_samp("ic") / F.sqrt(F.count(F.lit(1)))), 5).alias("t"))


@query()
def ic_summary(spark, d):
    s = stats.summary(_series(spark, d), 21, 21, trials=40)
    row = (*(s.get(k) for k in ("n", "mean", "std", "icir", "hit_rate", "t_naive", "hac_lags", "t_hac")), s.get("deflated", {}).get("margin"))
    return spark.createDataFrame([row], "n long, mean double, std double, icir double, hit_rate double, t_naive double, hac_lags long, t_hac double, deflated_margin double")


@query()
def effective_n(spark, d):
    e = C.pooled_correlation(panel(spark, d), FACTORS)
    return spark.createDataFrame([(e["li_ji"], e["capped"], e["nyholt"])], "li_ji double, capped double, nyholt double")


@query(f"""with {PANEL}, s as (select month, ticker, momentum_21d as score, row_number() over (partition by month order by momentum_21d, ticker) as rn, count(*) over (partition by month) as n from panel where momentum_21d is not null),
bn as (select *, (rn - 1) * 10 // n as bin from s) select month, ticker, round(case when bin = 9 then 1 else -1 end * least(1.0 / count(*) over (partition by month, bin), 0.05), 9) as weight from bn where bin in (0, 9)""")
def quantile_weights(spark, d):
    s = panel(spark, d).select("month", "ticker", F.col("momentum_21d").alias("score"))
    return C.equal_weight_legs(s, key="month").select("month", "ticker", F.round("weight", 9).alias("weight"))
