"""Options, ticks, streaming twins and the walk-forward combiner."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import combiner as M
from ..operators import options as O
from ..operators import ticks as K
from ..streaming import twins as T
from .evaluation_queries import FACTORS, panel
from .event_queries import ONSETS, buys
from .registry import query, table

CHAIN = """chain as (select date '2024-01-02' + (p_partkey % 3)::int as quote_date, date '2024-02-05' + (p_partkey % 2 * 7)::int as expiration, 80.0::double + p_size as strike, case when (p_partkey // 6) % 2 = 0 then 'C' else 'P' end as "right",
  case when (p_partkey // 6) % 2 = 0 then greatest(100 - (80.0 + p_size), 0) else greatest((80.0 + p_size) - 100, 0) end + 1 + (p_partkey % 7) / 10.0 as bid, case when (p_partkey // 6) % 2 = 0 then greatest(100 - (80.0 + p_size), 0) else greatest((80.0 + p_size) - 100, 0) end + 1.2 + (p_partkey % 5) / 5.0 as ask, p_partkey as created from part)"""
MIDS = """live as (select * from chain where bid > 0 and ask > bid), mids as (select quote_date, expiration, strike, arg_max((bid + ask) / 2, created) filter ("right" = 'C') as call_mid, arg_max((bid + ask) / 2, created) filter ("right" = 'P') as put_mid from live group by 1, 2, 3),
pm as (select * from mids where call_mid is not null and put_mid is not null)"""


def chain(spark, d):
    k, strike = F.col("p_partkey"), F.lit(80.0) + F.col("p_size")
    call = F.floor(k / 6) % 2 == 0
    intrinsic = F.when(call, F.greatest(100 - strike, F.lit(0.0))).otherwise(F.greatest(strike - 100, F.lit(0.0)))
    day = lambda base, n: F.date_add(F.lit(base).cast("date"), n.cast("int"))
    return table(spark, d, "part").select(day("2024-01-02", k % 3).alias("quote_date"), day("2024-02-05", k % 2 * 7).alias("expiration"), strike.alias("strike"), F.when(call, "C").otherwise("P").alias("right"), (intrinsic + 1 + (k % 7) / 10.0).alias("bid"), (intrinsic + 1.2 + (k % 5) / 5.0).alias("ask"), k.alias("created"))


@query(f"with {CHAIN}, {MIDS} select quote_date, expiration, strike, round(call_mid, 6) as call_mid, round(put_mid, 6) as put_mid from pm")
def paired_mids(spark, d):
    return O.paired_mids(chain(spark, d)).select("quote_date", "expiration", "strike", F.round("call_mid", 6).alias("call_mid"), F.round("put_mid", 6).alias("put_mid"))


@query(f"with {CHAIN}, {MIDS} select quote_date, expiration, round(strike + call_mid - put_mid, 6) as spot from pm qualify row_number() over (partition by quote_date, expiration order by round(abs(call_mid - put_mid), 9), strike) = 1")
def parity_forward(spark, d):
    p = O.paired_mids(chain(spark, d)).select("quote_date", "expiration", "strike", F.round("call_mid", 9).alias("call_mid"), F.round("put_mid", 9).alias("put_mid"))
    return O.parity_spot(p).withColumn("spot", F.round("spot", 6))


@query()
def atm_iv(spark, d):
    return O.atm_iv(chain(spark, d))


@query("""with x as (select p_partkey as k, [1.2 + p_size / 20.0, 2.0 + (p_partkey % 9) / 3.0, 3.0 + (p_partkey % 4)] as o from part), i as (select k, list_transform(o, lambda v: 1 / v) as v from x)
select k, case when list_sum(v) > 0.9 and list_sum(v) < 1.3 then list_transform(v, lambda y: round(y / list_sum(v), 8)) end as fair, round(0.07 * v[1] * (1 - v[1]), 8) as fee from i""")
def devig(spark, d):
    k = F.col("p_partkey")
    odds = F.array(F.lit(1.2) + F.col("p_size") / 20.0, F.lit(2.0) + (k % 9) / 3.0, (F.lit(3.0) + k % 4).cast("double"))
    fair = S.devig(odds)
    return table(spark, d, "part").select(k.alias("k"), F.transform(fair, lambda x: F.round(x, 8)).alias("fair"), F.round(S.taker_fee(1 / odds[0]), 8).alias("fee"))


@query("""with s as (select p_size as k, avg(p_retailprice) as y from part where p_size % 5 = 0 group by 1), g as (select distinct p_size as k from part where p_size between 5 and 50),
j as (select g.k, (select max(s.k) from s where s.k <= g.k) as a, (select min(s.k) from s where s.k >= g.k) as b from g)
select j.k::double as x, round(case when a = b then sa.y else sa.y + (j.k - a) * (sb.y - sa.y) / (b - a) end, 6) as y from j join s sa on sa.k = a join s sb on sb.k = b""")
def smile_interpolation(spark, d):
    p = table(spark, d, "part").withColumn("x", F.col("p_size").cast("double")).withColumn("g", F.lit(1))
    pts = p.where("p_size % 5 = 0").groupBy("g", "x").agg(F.avg("p_retailprice").alias("y"))
    grid = p.where("p_size between 5 and 50").select("g", "x").distinct()
    return O.interpolate(pts, grid, "g", "x", "y").select("x", F.round("y", 6).alias("y"))


TICKS = "tk as (select user_id % 20 as symbol, ts, event_id as seq, value + 1 as price from events)"


def ticks(spark, d, source=None):
    e = table(spark, d, "events") if source is None else source
    return e.select((F.col("user_id") % 20).alias("symbol"), "ts", F.col("event_id").alias("seq"), (F.col("value") + 1).alias("price"))


BINS = f"with {TICKS} select symbol, time_bucket(interval '1 hour', ts) as start, round(arg_max(price, (ts, seq)), 6) as price, count(*) as n from tk group by 1, 2"


@query(BINS)
def tick_bins(spark, d):
    return K.bins(ticks(spark, d), "1 hour").withColumn("price", F.round("price", 6))


@query(BINS)
def tick_bins_streaming(spark, d):
    s = T.bins(ticks(spark, d, T.read_stream(spark, d, "events")), "1 hour")
    return T.run_available(s, "complete").withColumn("price", F.round("price", 6))


GRID = f"""{TICKS}, b as (select symbol, epoch(time_bucket(interval '1 hour', ts))::bigint // 3600 as k, arg_max(price, (ts, seq)) as price from tk group by 1, 2),
gr as (select s.symbol, k.k from (select symbol, min(k) as lo, max(k) as hi from b group by 1) s, unnest(range(lo, hi + 1)) as k(k)), fg as (select gr.symbol, gr.k, last_value(b.price ignore nulls) over (partition by gr.symbol order by gr.k) as price from gr left join b on b.symbol = gr.symbol and b.k = gr.k)"""


def grid(spark, d):
    return K.filled_grid(K.bins(ticks(spark, d), "1 hour"), 3600)


@query(f"""with {GRID}, r as (select *, power(ln(price / lag(price) over (partition by symbol order by k)), 2) as r2 from fg) select symbol, k, round(case when count(r2) over w >= 24 then sum(r2) over w end, 6) as rv from r window w as (partition by symbol order by k rows between 23 preceding and current row)""")
def realized_variance(spark, d):
    return K.realized_variance(grid(spark, d), 24).select("symbol", "k", F.round("rv", 6).alias("rv"))


@query(f"""with {GRID}, r as (select symbol, k, ln(price / lag(price) over (partition by symbol order by k)) as r from fg) select l.lag, round(corr(x.r, y.r), 6) as rho, count(*) as n from r x cross join (select unnest([-2, -1, 0, 1, 2]) as lag) l join r y on y.symbol = 4 and y.k = x.k + l.lag and y.r is not null where x.symbol = 3 and x.r is not null group by 1""")
def lead_lag(spark, d):
    return K.lead_lag(grid(spark, d), 3, 4, [-2, -1, 0, 1, 2]).withColumn("rho", F.round("rho", 6))


@query(f"""with {TICKS}, m as (select *, ln(price / lag(price) over w) as m, [ln(lead(price, 1) over w / price), ln(lead(price, 2) over w / price), ln(lead(price, 5) over w / price)] as f from tk window w as (partition by symbol order by ts, seq)),
u as (select m, unnest([1, 2, 5]) as horizon, unnest(f) as f from m where abs(m) >= 1) select horizon, count(*) as n, round(median(sign(m) * f), 6) as median from u where f is not null group by 1""")
def jump_latency(spark, d):
    return K.jump_response(ticks(spark, d), 1.0, [1, 2, 5]).withColumn("median", F.round("median", 6))


@query()
def ewma_variance(spark, d):
    return K.ewma_variance(grid(spark, d), 24.0)


@query()
def cooldown_fills(spark, d):
    e = table(spark, d, "events")
    return K.cooldown(e.select((F.col("user_id") % 20).alias("key"), "ts", F.col("event_id").alias("seq")), 1800)


@query()
def maker_replay(spark, d):
    e = table(spark, d, "events")
    spot = e.where("user_id % 20 = 0").groupBy((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).agg((F.avg("value") + 100).alias("price"))
    t = e.where("user_id % 20 <> 0").select((F.col("user_id") % 20).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), ((F.col("event_id") % 97) / 97.0).alias("px"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"))
    return K.maker_replay(t, spot, window_s=6 * 3600, vol=1e-3)


@query()
def book_reconstruction(spark, d):
    e = table(spark, d, "events")
    side = F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL")
    price = F.round(F.when(F.col("event_id") % 2 == 0, 0.30 + (F.col("event_id") % 17) / 100).otherwise(0.52 + (F.col("event_id") % 19) / 100), 2)
    change = F.to_json(F.struct(side.alias("side"), price.alias("price"), (F.col("event_id") % 5).cast("double").alias("size")))
    snap = F.lit('{"bids": [[0.4, 10], [0.39, 5]], "asks": [[0.6, 7], [0.62, 1]]}')
    first = F.col("event_id") % 50 == 0
    m = e.select((F.col("user_id") % 20).alias("token"), "ts", F.col("event_id").alias("seq"), F.when(first, "snapshot").otherwise("change").alias("kind"), F.when(first, snap).otherwise(change).alias("body"))
    return K.book_mids(m)


@query(f"with {ONSETS} select * from onsets")
def cluster_onset_streaming(spark, d):
    at = T.scratch(spark)
    buys(spark, d).repartition(1).write.parquet(f"{at}/buys")  # one file: one batch, in which dates are sorted per ticker
    s = spark.readStream.schema("ticker int, date date, owner long").parquet(f"{at}/buys")
    return T.run_available(T.onsets(s.withColumn("ticker", F.col("ticker").cast("long")))).withColumn("ticker", F.col("ticker").cast("int"))


@query("""with r as (select user_id as key, ts, event_id, case event_type when 'purchase' then 0 else 1 end as side, value from events) select a.key, a.ts, round(b.value, 6) as value from (select key, ts from r where side = 1) a
asof left join (select key, ts, max(value) as value from r where side = 0 group by 1, 2) b on a.key = b.key and a.ts >= b.ts""")
def asof_state_streaming(spark, d):
    e = T.read_stream(spark, d, "events")
    rows = e.select(F.col("user_id").alias("key"), "ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("side"), "value")
    return T.run_available(T.latest_state(rows)).withColumn("value", F.round("value", 6))


@query()
def walk_forward(spark, d):
    return M.walk_forward(panel(spark, d), FACTORS, "fwd_21d", every=12)
