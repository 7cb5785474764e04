"""Data quality, identity and scalar parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import pit as P
from ..operators import quality as A
from . import roles as R
from .registry import query, table


@query("""with g as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2) select sum(n)::bigint as rows, coalesce(sum(n) filter (l_orderkey is null or l_linenumber is null), 0)::bigint as null_rows, sum(n) filter (n > 1)::bigint as duplicate_rows from g""")
def pk_audit(spark, d):
    return A.key_audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


OHLC = "o as (select o_custkey as ticker, cast(date_trunc('month', o_orderdate) as date) as date, min(o_totalprice) - 150000 as open, max(o_totalprice) as high, min(o_totalprice) as low, case when count(*) > 1 then avg(o_totalprice) end as close, count(*) - 1 as volume from orders group by 1, 2)"


@query(f"""with {OHLC}, c as (select count(*) filter (open is null or high is null or low is null or close is null or volume is null) as missing, count(*) filter (isinf(close) or isnan(close)) as not_finite,
count(*) filter (least(open, high, low, close) <= 0) as not_positive, count(*) filter (high < greatest(open, close, low) or low > least(open, close, high)) as high_low, count(*) filter (volume < 0) as negative_volume from o)
unpivot c on missing, not_finite, not_positive, high_low, negative_volume into name rule value violations""")
def ohlc_domain_audit(spark, d):
    o = table(spark, d, "orders")
    p = "o_totalprice"
    x = o.groupBy("o_custkey", F.date_trunc("month", "o_orderdate")).agg((F.min(p) - 150000).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.when(F.count(p) > 1, F.avg(p)).alias("close"), (F.count(p) - 1).alias("volume"))
    return A.domain_audit(x)


LIST = "ls as (select o_custkey % 50 as ticker, o_orderkey % 7 + (o_custkey % 50) * 10 as listing_id, min(cast(o_orderdate as date)) as first_date, max(cast(o_orderdate as date)) as last_date from orders group by 1, 2)"
IV = "iv as (select row_number() over (order by t, q) as interval_id, t as ticker, min(dt) as valid_from, max(dt) as valid_to from (select o_custkey % 60 as t, cast(date_trunc('year', o_orderdate) as date) as q, cast(o_orderdate as date) as dt from orders) group by t, q)"


def _listings(spark, d):
    o = table(spark, d, "orders").withColumn("dt", F.to_date("o_orderdate"))
    t = F.col("o_custkey") % 50
    return o.groupBy(t.alias("ticker"), (F.col("o_orderkey") % 7 + t * 10).alias("listing_id")).agg(F.min("dt").alias("first_date"), F.max("dt").alias("last_date"))


def _intervals(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").withColumn("dt", F.to_date("o_orderdate"))
    g = o.groupBy((F.col("o_custkey") % 60).alias("ticker"), F.trunc("dt", "year").alias("q")).agg(F.min("dt").alias("valid_from"), F.max("dt").alias("valid_to"))
    return g.withColumn("interval_id", F.row_number().over(Window.orderBy("ticker", "q")).cast("long")).drop("q")


@query(f"""with {LIST}, {IV}, j as (select interval_id, count(distinct listing_id) as n, min(listing_id) as id from iv left join ls on ls.ticker = iv.ticker and valid_from >= first_date - 7 and valid_to <= last_date + 7 group by 1)
select interval_id, case when n = 0 then 'unmatched' when n = 1 then 'resolved' else 'ambiguous' end as status, case when n = 1 then id end as listing_id from j""")
def interval_identity(spark, d):
    return A.resolve_intervals(_intervals(spark, d), _listings(spark, d))


@query(f"with {LIST} select x.ticker, x.listing_id as a, y.listing_id as b from ls x join ls y on x.ticker = y.ticker and x.listing_id < y.listing_id and x.first_date <= y.last_date and y.first_date <= x.last_date")
def interval_overlap(spark, d):
    return A.overlapping_aliases(_listings(spark, d))


INTERVALS = f"""{R.SNAPSHOTS}, sc as (select date, row_number() over (order by date) as pos, coalesce(lead(date) over (order by date) - 1, date + 60) as until from (select distinct date from snaps)),
isl as (select ticker, date, until, pos - row_number() over (partition by ticker order by pos) as island from snaps join sc using (date)), iv as (select ticker, min(date) as valid_from, max(until) as valid_to from isl group by ticker, island)"""


@query(f"""with {R.BARS}, {INTERVALS}, cal as (select distinct date from bars), w as (select distinct iv.ticker, cal.date from iv join cal on cal.date between valid_from and valid_to)
select w.ticker, year(w.date)::int as year, count(*) as expected, count(b.date) as observed, round(count(b.date) / count(*), 6) as ratio from w left join bars b on b.ticker = w.ticker and b.date = w.date group by 1, 2""")
def member_day_coverage(spark, d):
    b = R.bars(spark, d)
    return A.coverage(P.membership_intervals(R.snapshots(spark, d)), b, P.calendar(b)).withColumn("ratio", F.round("ratio", 6))


@query(f"""with {R.BARS}, j as (select *, close / lag(close) over (partition by ticker order by date) - 1 as ret from bars), a as (select distinct o_custkey as ticker, cast(o_orderdate as date) as date, o_orderstatus as kind from orders)
select j.ticker, j.date, round(ret, 6) as ret, coalesce(string_agg(distinct kind, ',' order by kind), '') as actions from j left join a on a.ticker = j.ticker and a.date between j.date - 3 and j.date + 3 where abs(ret) > 0.5 group by 1, 2, 3""")
def price_jumps(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("kind")).distinct()
    return A.price_jumps(R.bars(spark, d), a).withColumn("ret", F.round("ret", 6))


@query(f"""with {R.BARS}, r as (select *, row_number() over w as p, lead(close, 1) over w / close - 1 as r1, lead(close, 5) over w / close - 1 as r5 from bars window w as (partition by ticker order by date)),
s as (select r.*, min(case when year(date) in (1996, 1999) and month(date) = 6 and volume > 30 then p end) over (partition by ticker order by date rows between 1 following and unbounded following) as nx from r)
select ticker, date, round(case when nx is null or nx - p > 1 then r1 end, 6) as ret_1d, round(case when nx is null or nx - p > 5 then r5 end, 6) as ret_5d from s""")
def seam_mask(spark, d):
    from ..operators.features import forward_returns

    b = R.bars(spark, d)
    rows = forward_returns(b, (1, 5)).withColumnRenamed("fwd_1d", "ret_1d").withColumnRenamed("fwd_5d", "ret_5d")
    seams = b.where("year(date) in (1996, 1999) and month(date) = 6 and volume > 30").select("ticker", "date")
    return A.mask_seams(rows, seams, (1, 5)).select("ticker", "date", F.round("ret_1d", 6).alias("ret_1d"), F.round("ret_5d", 6).alias("ret_5d"))


@query(f"""with {R.BARS}, cal as (select distinct date from bars where date between date '1996-01-01' and date '1998-12-31'), wk as (select unnest(generate_series(date '1996-01-01', date '1998-12-31', interval 1 day))::date as date),
g as (select date - lag(date) over (order by date) as g from cal) select (select count(*) from wk where dayofweek(date) between 1 and 5) as weekdays, (select count(*) from cal where dayofweek(date) between 1 and 5) as covered, (select max(g) from g)::int as longest_gap,
(select sha256(string_agg(date::varchar, ',' order by date)) from cal) as digest, round((select count(*) from cal where dayofweek(date) between 1 and 5) / (select count(*) from wk where dayofweek(date) between 1 and 5), 6) as share""")
def calendar_quality(spark, d):
    return A.calendar_gaps(P.calendar(R.bars(spark, d)), "1996-01-01", "1998-12-31").withColumn("share", F.round("share", 6))


@query("""with a as (select distinct cast(date_trunc('month', l_shipdate) as date) as month, l_suppkey as id from lineitem where l_returnflag = 'R'), b as (select distinct cast(date_trunc('month', l_shipdate) as date) as month, l_suppkey as id from lineitem where l_linestatus = 'F'),
j as (select coalesce(a.month, b.month) as month, a.id as x, b.id as y from a full join b on a.month = b.month and a.id = b.id) select month, count(x) as n_a, count(y) as n_b, count(*) filter (x is not null and y is not null) as common, round(count(*) filter (x is not null and y is not null) / count(*), 6) as jaccard from j group by 1""")
def jaccard_monthly(spark, d):
    li = table(spark, d, "lineitem").select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"), F.col("l_suppkey").alias("id"), "l_returnflag", "l_linestatus")
    return A.set_similarity(li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'F'"), "month", "id").withColumn("jaccard", F.round("jaccard", 6))


@query("""with t as (select row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) as row_id, l_suppkey as who, l_partkey % 20 as what, l_returnflag as kind, l_orderkey % 5 as disclosure from lineitem where l_linenumber = 2),
o as (select *, row_number() over (partition by who, what, kind, disclosure order by row_id) as occurrence from t), n as (select who, what, kind, occurrence, count(distinct disclosure) as n from o group by all)
select o.row_id, o.who, o.what, o.kind, o.disclosure, o.occurrence, n.n > 1 as is_refiled from o join n using (who, what, kind, occurrence) qualify row_number() over (partition by who, what, kind, occurrence order by disclosure, row_id) = 1""")
def relisted_trades(spark, d):
    from pyspark.sql import Window

    li = table(spark, d, "lineitem")
    rid = F.row_number().over(Window.orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"))
    t = li.where("l_linenumber = 2").select(rid.alias("row_id"), F.col("l_suppkey").alias("who"), (F.col("l_partkey") % 20).alias("what"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") % 5).alias("disclosure"))
    out = A.relisted_trades(t.withColumn("disclosed", F.col("disclosure")), ["who", "what", "kind"]).drop("disclosed")
    return out.withColumns({c: F.col(c).cast("long") for c in ("row_id", "occurrence")})


@query("""with g as (select 'pk' as gate, 'review' as severity, (select coalesce(sum(n), 0) from (select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1)) as issues union all select 'price', 'high', (select count(*) from part where p_retailprice <= 0))
select coalesce(sum(issues) filter (severity = 'high'), 0)::bigint as high, coalesce(sum(issues) filter (severity = 'review'), 0)::bigint as review, case when coalesce(sum(issues) filter (severity = 'high'), 0) > 0 then 'FAIL' when coalesce(sum(issues) filter (severity = 'review'), 0) > 0 then 'REVIEW' else 'PASS' end as status from g""")
def gate_status(spark, d):
    pk = A.key_audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.lit("pk").alias("gate"), F.lit("review").alias("severity"), F.col("duplicate_rows").alias("issues"))
    price = table(spark, d, "part").where("p_retailprice <= 0").agg(F.count(F.lit(1)).alias("issues")).select(F.lit("price").alias("gate"), F.lit("high").alias("severity"), "issues")
    return A.gate_status(pk.unionByName(price))


@query(r"""with a as (select o_orderkey as k, case o_orderkey % 3 when 0 then '$1,001 - $15,000' when 1 then 'Over $' || (o_custkey * 1000) else 'n/a' end as label from orders), n as (select k, label, list_transform(regexp_extract_all(replace(label, ',', ''), '\$\s*([0-9]+)', 1), lambda x: x::bigint) as v from a)
select k, case when lower(label) like 'over%' then v[1] + 1 else v[1] end as low, case when lower(label) not like 'over%' then v[2] end as high from n""")
def amount_labels(spark, d):
    k = F.col("o_orderkey")
    label = F.when(k % 3 == 0, "$1,001 - $15,000").when(k % 3 == 1, F.concat(F.lit("Over $"), (F.col("o_custkey") * 1000).cast("string"))).otherwise("n/a")
    lo, hi = S.amount_range(label)
    return table(spark, d, "orders").select(k.alias("k"), lo.alias("low"), hi.alias("high"))


@query("""with x as (select p_partkey as k, ' brk.' || lower(p_brand) || ' ' as s, p_retailprice / 1500 - 0.2 as c, p_size as n, p_size || '.5% of sales' as t from part)
select k, upper(replace(trim(s), '.', '-')) as ticker, round(least(greatest(c, 0.0), 1.0), 8) as confidence, n::varchar as vendor_id, case when n + 0.5 <= 100 then n + 0.5 end::double as percent from x""")
def scalar_codes(spark, d):
    p = table(spark, d, "part")
    n = F.col("p_size")
    return p.select(F.col("p_partkey").alias("k"), S.ticker(F.concat(F.lit(" brk."), F.lower("p_brand"), F.lit(" "))).alias("ticker"), F.round(S.confidence(F.col("p_retailprice") / 1500 - 0.2), 8).alias("confidence"), S.vendor_id(n).alias("vendor_id"), S.percent(F.concat(n.cast("string"), F.lit(".5% of sales"))).alias("percent"))
