"""Views that give the driver tables the roles of the point-in-time domain.

Each role is a DataFrame function and a SQL common table expression of the
same rows. Grains are made unique before any order-sensitive window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

BARS = "bars as (select l_suppkey as ticker, cast(l_shipdate as date) as date, avg(l_extendedprice / l_quantity) as close, sum(l_quantity) as volume from lineitem group by 1, 2)"


def bars(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, date, close, volume), one row per supplier and ship date."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


SECTORS = "sectors as (select s_suppkey as ticker, r_name as sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


def sectors(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    both = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))


# bitemporal facts: month of the period end, filing date, value; only filed after the period
FACTS = """facts as (select l_suppkey as cik, l_returnflag as tag, l_linenumber as qtrs, last_day(cast(date_trunc('month', o_orderdate) as date)) as ddate,
  cast(l_shipdate as date) as filed, l_orderkey as adsh, round(sum(l_extendedprice), 2) as value, round(sum(l_quantity), 2) as shares
  from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= last_day(cast(date_trunc('month', o_orderdate) as date)) group by 1, 2, 3, 4, 5, 6)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    """(cik, tag, qtrs, ddate, filed, adsh, value, shares)."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    ddate = F.last_day(F.to_date("o_orderdate"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(F.to_date("l_shipdate") >= ddate)
    key = [F.col("l_suppkey").alias("cik"), F.col("l_returnflag").alias("tag"), F.col("l_linenumber").alias("qtrs"), ddate.alias("ddate"), F.to_date("l_shipdate").alias("filed"), F.col("l_orderkey").alias("adsh")]
    return rows.groupBy(*key).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.round(F.sum("l_quantity"), 2).alias("shares"))


# quarterly series: first-filed total per supplier and quarter end
QUARTERS = """quarters as (select cik, ddate, filed, value, shares from (
  select cik, cast(date_trunc('quarter', ddate) + interval 3 month - interval 1 day as date) as ddate, filed, round(sum(value), 2) as value, round(sum(shares), 2) as shares,
    row_number() over (partition by cik, cast(date_trunc('quarter', ddate) + interval 3 month - interval 1 day as date) order by filed) as rn
  from facts where filed > cast(date_trunc('quarter', ddate) + interval 3 month - interval 1 day as date) group by 1, 2, 3) where rn = 1)"""


def quarters(spark: SparkSession, d: str) -> DataFrame:
    """(cik, ddate, filed, value, shares): the first filing after each quarter's end."""
    from ..operators.pit import first_filed

    f = facts(spark, d)
    qend = F.last_day(F.add_months(F.trunc("ddate", "quarter"), 2))
    rows = f.withColumn("ddate", qend).where(F.col("filed") > F.col("ddate")).groupBy("cik", "ddate", "filed").agg(F.round(F.sum("value"), 2).alias("value"), F.round(F.sum("shares"), 2).alias("shares"))
    return first_filed(rows, ["cik", "ddate"], ["filed"])


# supplier -> customer edges, one per line
EDGES = """edges as (select l_suppkey as source, o_custkey as target, case o_orderpriority when '1-URGENT' then 'customer' when '2-HIGH' then 'supplier' when '3-MEDIUM' then 'competitor' when '4-NOT SPECIFIED' then 'partner' else 'other' end as relation, round(1 - l_discount * 5, 6) as confidence, cast(o_orderdate as date) as filing_date
  from lineitem join orders on l_orderkey = o_orderkey)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    relation = F.when(p == "1-URGENT", "customer").when(p == "2-HIGH", "supplier").when(p == "3-MEDIUM", "competitor").when(p == "4-NOT SPECIFIED", "partner").otherwise("other")
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("source"), F.col("o_custkey").alias("target"), relation.alias("relation"), F.round(1 - F.col("l_discount") * 5, 6).alias("confidence"), F.to_date("o_orderdate").alias("filing_date"))


# quarter-start snapshots of suppliers with enough lines in the quarter before
SNAPSHOTS = """snaps as (select cast(date_trunc('quarter', l_shipdate) + interval 3 month as date) as date, l_suppkey as ticker from lineitem group by 1, 2 having count(*) >= 20)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    rows = li.groupBy(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 3).alias("date"), F.col("l_suppkey").alias("ticker")).count()
    return rows.where("count >= 20").select("date", "ticker")


# filings: one row per customer and order date
FILINGS = "filings as (select o_custkey as ticker, cast(o_orderdate as date) as fdate, min(o_orderkey) as accession, max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as flag from orders group by 1, 2)"


def filings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    flag = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("flag")
    return o.groupBy(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("fdate")).agg(F.min("o_orderkey").alias("accession"), flag)
