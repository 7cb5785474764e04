"""Further signals over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cross_section as C
from ..operators import fundamentals as Q
from ..operators import quality as A
from ..operators import signals as G
from ..operators.features import month_index
from ..operators.pit import asof_backward, calendar
from . import roles as R
from .evaluation_queries import panel
from .event_queries import CAL, CRYPTO, SPIKES, crypto, spikes
from .quality_queries import LIST, _listings
from .registry import query, table


@query("""with dv as (select o_custkey as ticker, year(o_orderdate) * 12 + month(o_orderdate) - 1 as m, sum(o_totalprice) / 1000 as amount from orders group by 1, 2),
mc as (select distinct ticker, k.m, 100.0 + ticker % 50 as close from dv, (select unnest([23963, 23969, 23975]) as m) k), lg as (select ticker, m, case when ticker % 3 = 0 then 3 when ticker % 3 = 1 then 6 else 12 end as lag from mc),
j as (select mc.ticker, mc.m, close, lag, dv.m as pm, amount from mc join lg on lg.ticker = mc.ticker and lg.m = mc.m join dv on dv.ticker = mc.ticker and dv.m between mc.m - 12 and mc.m - 1)
select ticker, m, round(coalesce(sum(case when pm = m + 1 - lag then amount end), 0) / close, 6) + 0.0 as yield from j group by ticker, m, close""")
def div_yield_st(spark, d):
    o = table(spark, d, "orders")
    dv = o.groupBy(F.col("o_custkey").alias("ticker"), month_index("o_orderdate").alias("m")).agg((F.sum("o_totalprice") / 1000).alias("amount"))
    mc = dv.select("ticker").distinct().select("ticker", F.explode(F.array(*map(F.lit, (23963, 23969, 23975)))).alias("m"), (F.lit(100.0) + F.col("ticker") % 50).alias("close"))
    t = F.col("ticker") % 3
    lags = mc.select("ticker", "m", F.when(t == 0, 3).when(t == 1, 6).otherwise(12).alias("lag"))
    return G.predicted_yield(dv, mc, lags).withColumn("yield", F.round("yield", 6) + 0.0)


@query(f"""with {R.BARS.replace('bars as', 'single as', 1)}, bars as (select ticker % 4 as ticker, date, avg(close) as close, sum(volume) as volume from single group by 1, 2), {CAL},
ev as (select distinct o_custkey % 4 as ticker, o_orderdate + to_hours(o_orderkey % 24) as ts from orders),
k as (select ev.*, case when hour(ts) >= 16 then ts::date + 1 else ts::date end as kd from ev), p as (select k.ticker, k.ts, cal.pos from k asof join cal on k.kd <= cal.date), px as (select ticker, pos, close from bars join cal using (date))
select p.ticker, p.ts, round(a.close / b.close - 1, 6) as ret from p join px b on b.ticker = p.ticker and b.pos = p.pos - 1 join px a on a.ticker = p.ticker and a.pos = p.pos + 1""")
def announcement_return(spark, d):
    b = R.bars(spark, d).groupBy((F.col("ticker") % 4).alias("ticker"), "date").agg(F.avg("close").alias("close"))
    o = table(spark, d, "orders")
    ts = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") % 24) * 3600)
    ev = o.select((F.col("o_custkey") % 4).alias("ticker"), ts.alias("ts")).distinct()
    return G.two_day_return(ev, b, calendar(b)).withColumn("ret", F.round("ret", 6))


@query("""with x as (select o_orderkey, year(o_orderdate)::int as year, o_totalprice as v from orders), q as (select year, quantile_cont(v, 0.2) as lo, quantile_cont(v, 0.8) as hi from x group by 1)
select o_orderkey, x.year, case when v <= lo then -1 when v >= hi then 1 else 0 end as signal from x join q using (year)""")
def year_quintile_signal(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"))
    return G.extremes_by_year(x, "v").select("o_orderkey", "year", "signal")


@query(f"""with {R.FILINGS}, a as (select ticker, fdate, 1.0::double as v, 0 as src from filings), b as (select ticker, fdate, 2.0::double as v, 1 as src from filings where flag = 1), u as (select * from a union all select * from b)
select ticker, fdate, v from u qualify row_number() over (partition by ticker, fdate order by src desc) = 1""")
def fresh_stream(spark, d):
    f = R.filings(spark, d)
    return G.freshest([f.select("ticker", "fdate", F.lit(1.0).alias("v")), f.where("flag = 1").select("ticker", "fdate", F.lit(2.0).alias("v"))], ["ticker", "fdate"])


@query(f"""with {R.BARS}, e as (select *, volume > 10 as ok, case when volume > 40 then close end as v from bars), s as (select *, sum(case when ok then 0 else 1 end) over (partition by ticker order by date) as spell from e)
select ticker, date, round(case when ok then last_value(case when ok then v end ignore nulls) over (partition by ticker, spell order by date) end, 6) as carried from s""")
def spell_carry(spark, d):
    e = R.bars(spark, d).withColumn("ok", F.col("volume") > 10).withColumn("v", F.when(F.col("volume") > 40, F.col("close")))
    return G.carry_in_spells(e, "v", "ok").select("ticker", "date", F.round("carried", 6).alias("carried"))


@query("""with x as (select p_partkey as k, list_filter([case when p_size > 10 then -2.0 end, case when p_size > 30 then 2.0 end, case when p_size < 5 then 1.5 end], lambda v: v is not null) as s from part)
select k, coalesce(list_sort(list_transform(s, lambda v: {'a': abs(v), 's': v}), 'DESC')[1].s, 0.0)::double as score from x""")
def filing_score(spark, d):
    n = F.col("p_size")
    s = F.filter(F.array(F.when(n > 10, -2.0), F.when(n > 30, 2.0), F.when(n < 5, 1.5)), lambda v: v.isNotNull())
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), G.strongest(s).alias("score"))


@query(f"""with {CRYPTO}, i as (select *, abs(r) / nullif(value, 0) as ill from rt)
select symbol, date, round(lag(close, 1) over o / lag(close, 6) over o - 1, 6) as mom, round(-r, 6) + 0.0 as rev, round(case when count(r) over w >= 6 then stddev_samp(r) over w end, 6) as vol, round(case when count(r) over w >= 6 then max(r) over w end, 6) as max_ret,
round(close / case when count(close) over y >= 12 then max(close) over y end, 6) as high, round(1e9 * case when count(ill) over w >= 6 then avg(ill) over w end, 4) as illiq, round(value / case when count(value) over w >= 6 then nullif(avg(value) over w, 0) end, 6) as rel_volume
from i window o as (partition by symbol order by date), w as (partition by symbol order by date rows between 5 preceding and current row), y as (partition by symbol order by date rows between 11 preceding and current row)""")
def crypto_signals(spark, d):
    s = G.crypto_signals(crypto(spark, d))
    r = lambda c, n=6: F.round(c, n).alias(c)
    return s.select("symbol", "date", r("mom"), (F.round("rev", 6) + 0.0).alias("rev"), r("vol"), r("max_ret"), r("high"), F.round(F.col("illiq") * 1e9, 4).alias("illiq"), r("rel_volume"))


@query("""with m as (select user_id % 20 as symbol, cast(ts as date) as date, sum(value) + 1 as oi, avg(value) as ratio from events group by 1, 2)
select symbol, date, round(ln(oi / lag(oi) over o), 6) as oi_1, round(ln(oi / lag(oi, 7) over o), 6) as oi_7, round(case when count(ratio) over w >= 7 then avg(ratio) over w end, 6) as crowd, round(ratio - case when count(ratio) over w >= 7 then avg(ratio) over w end, 6) + 0.0 as crowd_dev
from m window o as (partition by symbol order by date), w as (partition by symbol order by date rows between 6 preceding and current row)""")
def interest_signals(spark, d):
    m = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("symbol"), F.to_date("ts").alias("date")).agg((F.sum("value") + 1).alias("oi"), F.avg("value").alias("ratio"))
    s = G.interest_signals(m)
    return s.select("symbol", "date", *(F.round(c, 6).alias(c) for c in ("oi_1", "oi_7", "crowd")), (F.round("crowd_dev", 6) + 0.0).alias("crowd_dev"))


@query(f"""with {R.BARS}, j as (select ticker, date, close / lag(close) over w - 1 as ret, lag(close) over w as pc from bars window w as (partition by ticker order by date)), jj as (select * from j where abs(ret) > 0.3),
a as (select distinct o_custkey as ticker, cast(o_orderdate as date) as ad, case when o_orderkey % 2 = 0 then 'split' else 'dividend' end as kind, case when o_orderkey % 2 = 0 then 0.5 else 300.0 end as v from orders),
m as (select jj.ticker, jj.date, ret, min(case when kind = 'split' and abs((1 + ret) * v - 1) <= 0.15 then 0 when kind = 'dividend' and ret < 0 and abs(ret + v / pc) <= 0.15 * abs(ret) then 1 else 2 end) as r from jj left join a on a.ticker = jj.ticker and abs(jj.date - ad) <= 3 group by 1, 2, 3)
select ticker, date, round(ret, 6) as ret, case r when 0 then 'split' when 1 then 'dividend' else 'review' end as verdict from m""")
def verified_jumps(spark, d):
    from ..functions.windows import over_time

    w = over_time("ticker")
    b = R.bars(spark, d).withColumn("prior_close", F.lag("close").over(w)).withColumn("ret", F.col("close") / F.col("prior_close") - 1).where("abs(ret) > 0.3")
    o, even = table(spark, d, "orders"), F.col("o_orderkey") % 2 == 0
    a = o.select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("action_date"), F.when(even, "split").otherwise("dividend").alias("kind"), F.when(even, 0.5).otherwise(300.0).alias("value")).distinct()
    return G.verify_jumps(b.select("ticker", "date", "ret", "prior_close"), a).withColumn("ret", F.round("ret", 6))


@query(f"""with {R.BARS}, {LIST}, j as (select b.ticker, b.date, count(distinct listing_id) as n, min(listing_id) as id from bars b left join ls on ls.ticker = b.ticker and b.date between first_date - 7 and last_date + 7 group by 1, 2)
select ticker, date, case when n = 0 then 'none' when n = 1 then 'resolved' else 'several' end as status, case when n = 1 then id end as listing_id from j""")
def row_identity(spark, d):
    return G.assign_rows(R.bars(spark, d), _listings(spark, d))


@query("""with c as (select o_custkey as ticker, cast(o_orderdate as date) as date, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) % 2 = 1 as added from orders qualify row_number() over (partition by o_custkey, o_orderdate order by o_orderkey) = 1),
cc as (select ticker, date, row_number() over (partition by ticker order by date) % 2 = 1 as added from c), a as (select ticker from cc group by 1 having count(*) % 2 = 1), k as (select unnest([date '1996-06-30', date '1999-06-30']) as checkpoint),
n as (select distinct ticker from cc), g as (select k.checkpoint, n.ticker, (select min(struct_pack(d := date, a := added)) from cc where cc.ticker = n.ticker and cc.date > k.checkpoint) as nx from n, k)
select checkpoint, ticker from g where case when nx is not null then not nx.a else ticker in (select ticker from a) end""")
def members_by_replay(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date")).distinct()
    c = o.withColumn("added", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) % 2 == 1)
    anchor = c.groupBy("ticker").count().where("count % 2 = 1").select("ticker")
    days = spark.createDataFrame([("1996-06-30",), ("1999-06-30",)], "date string").select(F.to_date("date").alias("date"))
    return G.members_at(anchor, c, days)


_IN = {k: ", ".join(f"'{x}'" for x in v) for k, v in (("o", G.OPTION), ("e", G.EQUITY), ("n", G.NON_EQUITY))}


@query(rf"""with x as (select p_partkey as k, case p_partkey % 6 when 0 then 'Stock Option' when 1 then ' stock' when 2 then 'Corporate Bond' when 3 then 'Stocks' end as kind, case p_partkey % 5 when 0 then p_name || ' [OP]' when 1 then p_name || ' [sT]' when 2 then p_name || ' call option' when 3 then p_name || ' bonds' else p_name || ' [XX]' end as name, case when p_partkey % 7 > 2 then p_brand end as tk from part),
y as (select *, upper(trim(kind)) as t, upper(regexp_extract(name, '\[(\w{{2}})\]', 1)) as tag from x),
z as (select *, case when t in ({_IN["o"]}) then 'option' when t in ({_IN["e"]}) then 'equity' when t in ({_IN["n"]}) then 'non_equity' when tag in ({_IN["o"]}) then 'option' when tag in ({_IN["e"]}) then 'equity' when tag in ({_IN["n"]}) then 'non_equity'
when regexp_matches(name, '(?i)\b(puts?|calls?|options?)\b') then 'option' when regexp_matches(name, '(?i)\b(treasur\w+|municipal|bonds?|etf|bitcoin)\b') then 'non_equity' end as found from y)
select k, coalesce(found, case when tk is not null then 'equity' else 'unclassified' end) as class, found is null and tk is not null as inferred from z""".replace("\\\\", "\\"))
def asset_class(spark, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    kind = F.when(k % 6 == 0, "Stock Option").when(k % 6 == 1, " stock").when(k % 6 == 2, "Corporate Bond").when(k % 6 == 3, "Stocks")
    name = F.when(k % 5 == 0, F.concat(n, F.lit(" [OP]"))).when(k % 5 == 1, F.concat(n, F.lit(" [sT]"))).when(k % 5 == 2, F.concat(n, F.lit(" call option"))).when(k % 5 == 3, F.concat(n, F.lit(" bonds"))).otherwise(F.concat(n, F.lit(" [XX]")))
    ticker = F.when(k % 7 > 2, F.col("p_brand"))
    return table(spark, d, "part").select(k.alias("k"), G.asset_class(kind, name, ticker).alias("class"), G.asset_inferred(kind, name, ticker).alias("inferred"))


@query("""with a as (select distinct year(l_shipdate)::int as year, l_suppkey as ticker from lineitem where l_quantity > 45), b as (select distinct year(l_shipdate)::int as year, l_suppkey as ticker from lineitem where l_discount > 0.09),
j as (select coalesce(a.year, b.year) as year, a.ticker as x, b.ticker as y from a full join b on a.year = b.year and a.ticker = b.ticker) select year, count(*) filter (x is not null and y is not null) as both, count(*) filter (y is null) as only_a, count(*) filter (x is null) as only_b from j group by 1""")
def adjudication(spark, d):
    li = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("ticker"), "l_quantity", "l_discount")
    return G.yearly_differences(li.where("l_quantity > 45").select("year", "ticker"), li.where("l_discount > 0.09").select("year", "ticker"))


@query(f"""with {R.BARS}, {SPIKES}, v as (select ticker, date, case when count(volume) over w >= 20 then avg(close * volume) over w end as adv from bars window w as (partition by ticker order by date rows between 19 preceding and current row))
select e.ticker, e.date, round(v.adv, 4) as adv from ev e asof left join v on v.ticker = e.ticker and e.date >= v.date""")
def adv_diagnostic(spark, d):
    from ..functions.windows import over_time, rolling

    b = R.bars(spark, d).withColumn("dv", F.col("close") * F.col("volume"))
    v = b.select("ticker", F.col("date").alias("on"), rolling(F.avg, "dv", over_time("ticker"), 20).alias("adv"))
    return asof_backward(spikes(spark, d), v, "ticker", "date", "on", ["adv"]).withColumn("adv", F.round("adv", 4))


@query("""with r as (select l_suppkey as ticker, cast(date_trunc('quarter', l_shipdate) as date) as "end", cast(date_trunc('year', l_shipdate) as date) as filed, l_orderkey % 5 as accn, sum(l_quantity) as shares from lineitem group by 1, 2, 3, 4)
select ticker, "end", filed, round(shares, 2) as shares from r qualify row_number() over (partition by ticker, "end", filed order by accn desc) = 1""")
def multiclass_shares(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("end"), F.to_date(F.date_trunc("year", "l_shipdate")).alias("filed"), (F.col("l_orderkey") % 5).alias("accn"), F.col("l_quantity").alias("shares"))
    return Q.resolve_classes(li).withColumn("shares", F.round("shares", 2))


@query("""select o_orderpriority, count(*) filter (year(o_orderdate) = 1996) as y1996, count(*) filter (year(o_orderdate) = 1997) as y1997, count(*) filter (year(o_orderdate) = 1998) as y1998 from orders group by 1""")
def year_form_counts(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.concat(F.lit("y"), F.year("o_orderdate").cast("string")))
    return o.groupBy("o_orderpriority").pivot("y", ["y1996", "y1997", "y1998"]).count().na.fill(0)


@query()
def random_controls(spark, d):
    b = R.bars(spark, d)
    return G.random_controls(spikes(spark, d), b, calendar(b), hold=0)


@query()
def judge_null(spark, d):
    p = panel(spark, d)
    out = []
    for rho in (0.0, 0.5, 0.95):
        n = p.join(G.null_signal(p, rho, 11), ["month", "ticker"])
        j = C.judge(n, [], "null", "fwd_21d")
        out.append((rho, j["n_months"], j.get("ic_raw_t")))
    return spark.createDataFrame(out, "rho double, n_months long, t double")


@query("""with g as (select 'pk' as gate, count(*) as n from (select l_orderkey from lineitem group by l_orderkey, l_linenumber having count(*) > 1)) select gate, n > 0 as open from g""")
def gate_open(spark, d):
    k = A.key_audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return k.select(F.lit("pk").alias("gate"), (F.col("duplicate_rows") > 0).alias("open"))
