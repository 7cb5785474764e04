"""Directed, dated, weighted edges: (source, target, relation, confidence, filing_date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pit import last_per

# The relation seen from the other end.
REVERSED = {"supplier": "customer", "customer": "supplier", "partner": "partner", "competitor": "competitor"}


def latest_edges(edges: DataFrame, as_of=None, least: float = 0.5) -> DataFrame:
    """The last edge of each (source, target) up to as_of, then those of at least the confidence (in this order)."""
    known = edges if as_of is None else edges.where(F.col("filing_date") <= F.lit(as_of).cast("date"))
    return last_per(known, ["source", "target"], ["filing_date", "confidence", "relation"]).where(F.col("confidence") >= least)


def neighbor_signal(edges: DataFrame, values: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(ticker, signal, neighbors): mean of the neighbours' known values over edges both ways, weighted by relation and confidence.

    The relation of an incoming edge is reversed; one that has no reverse counts as partner.
    """
    out = edges.select(F.col("source").alias("ticker"), F.col("target").alias("other"), "relation", "confidence")
    back = F.coalesce(*(F.when(F.col("relation") == a, F.lit(b)) for a, b in REVERSED.items()), F.lit("partner"))
    inc = edges.select(F.col("target").alias("ticker"), F.col("source").alias("other"), back.alias("relation"), "confidence")
    w = F.coalesce(*(F.when(F.col("relation") == r, F.lit(float(v))) for r, v in weights.items()), F.lit(0.0)) * F.col("confidence")
    j = out.unionByName(inc).withColumn("w", w).join(values.select(F.col("ticker").alias("other"), "value"), "other").where("value is not null")
    total = F.sum(F.abs("w"))
    return j.groupBy("ticker").agg(F.when(total > 0, F.sum(F.col("w") * F.col("value")) / total).alias("signal"), F.count(F.lit(1)).alias("neighbors"))


def customers_of(edges: DataFrame, least: float = 0.8) -> DataFrame:
    """edges of at least the confidence as (ticker, customer, ...): targets of customer edges, and sources of supplier edges."""
    rest = [c for c in edges.columns if c not in ("source", "target", "relation")]
    e = edges.where(F.col("confidence") >= least)
    out = e.where("relation = 'customer'").select(F.col("source").alias("ticker"), F.col("target").alias("customer"), *rest)
    inc = e.where("relation = 'supplier'").select(F.col("target").alias("ticker"), F.col("source").alias("customer"), *rest)
    return out.unionByName(inc)


def edge_spans(edges: DataFrame) -> DataFrame:
    """edges with valid_from and valid_to (excluded): each holds until the pair's next filing."""
    one = last_per(edges, ["source", "target", "filing_date"], ["confidence", "relation"])
    nxt = F.lead("filing_date").over(Window.partitionBy("source", "target").orderBy("filing_date"))
    return one.withColumn("valid_from", F.col("filing_date")).withColumn("valid_to", nxt)


def customer_momentum(edges: DataFrame, momentum: DataFrame, days: DataFrame, least: float = 0.8) -> DataFrame:
    """(ticker, date, signal): per day the confidence-weighted mean momentum of the customers by edges then valid.

    Validity intervals replace a rebuild per day; momentum is (ticker, date, value).
    """
    spans = customers_of(edge_spans(edges), least).select("ticker", "customer", "confidence", "valid_from", "valid_to")
    m = momentum.join(F.broadcast(days), "date").where("value is not null").select(F.col("ticker").alias("customer"), "date", "value")
    j = spans.join(m, "customer").where((F.col("date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("date") < F.col("valid_to"))))
    return j.groupBy("ticker", "date").agg((F.sum(F.col("confidence") * F.col("value")) / F.sum("confidence")).alias("signal"))


def disclosure_validity(edges: DataFrame, inventory: DataFrame) -> DataFrame:
    """(supplier, customer, valid_from, valid_to): an edge ends at the supplier's first later known filing that does not name the customer.

    inventory: (supplier, filing_date, known); edges: (supplier, customer, filing_date).
    """
    e = edges.select("supplier", "customer", "filing_date").distinct()
    later = inventory.where("known").select("supplier", F.col("filing_date").alias("_f")).distinct()
    cand = e.join(later, "supplier").where(F.col("_f") > F.col("filing_date"))
    again = e.select("supplier", "customer", F.col("filing_date").alias("_f"))
    end = cand.join(again, ["supplier", "customer", "_f"], "left_anti").groupBy("supplier", "customer", "filing_date").agg(F.min("_f").alias("valid_to"))
    return e.join(end, ["supplier", "customer", "filing_date"], "left").select("supplier", "customer", F.col("filing_date").alias("valid_from"), "valid_to")


def decayed_score(events: DataFrame, grid: DataFrame, months: int = 12, decay: float = 0.9) -> DataFrame:
    """(ticker, date, score): mean of event scores in the trailing months, weighted by decay ** (days / 30.44); 0 without an event.

    grid: (ticker, date) of covered tickers; events: (ticker, event_date, score).

    A ticker's dates and its events, summed by day, are sorted together, so a date reads its own window only and
    nothing is joined. In (year, month, day) counted as one number with 32 days a month the trailing months are
    a range of fixed length, also where add_months would cut the day.
    """
    place = lambda c: (F.year(c) * 12 + F.month(c)) * 32 + F.dayofmonth(c)
    day = events.where("ticker is not null and event_date is not null").groupBy("ticker", F.col("event_date").alias("date"))
    day = day.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("ticker").orderBy("_at").rangeBetween(1 - 32 * months, 0)
    rows = grid.select("ticker", "date").unionByName(day, allowMissingColumns=True).withColumn("_at", place("date"))
    rows = rows.withColumn("_seen", F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("date", "_s", "_n"))).over(w)).where("_n is null")
    total = lambda c: F.aggregate("_seen", F.lit(0.0), lambda a, x: a + F.pow(F.lit(decay), F.datediff("date", x["date"]) / 30.44) * x[c])
    out = rows.select("ticker", "date", F.coalesce(total("_s") / F.nullif(total("_n"), F.lit(0.0)), F.lit(0.0)).alias("score"))
    return out.groupBy("ticker", "date").agg(F.first("score").alias("score"))  # a date asked twice; dealt out by ticker already
