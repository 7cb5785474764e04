"""Walk-forward combination of factors by boosted trees."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cross_section as C


def walk_forward(panel: DataFrame, factors: list[str], target: str, train_months: int = 12, purge_days: int = 31, every: int = 1, least: int = 50) -> DataFrame:
    """(month, ticker, prediction, signal): trees trained on the months before, up to purge_days before the test month begins.

    A model serves ``every`` months from its first test month on. The signal
    is twice the percent rank within the month, less 1. Missing factors are
    replaced by 0 after ranking (the middle). One fit per model, on Spark.
    """
    rows = C.add_rank_z(panel, factors, ["month"]).select("month", "date", "ticker", *(F.coalesce(f"z_{f}", F.lit(0.0)).alias(f) for f in factors), F.col(target).alias("label"))
    rows = VectorAssembler(inputCols=factors, outputCol="features").transform(rows).cache()
    months = [r.month for r in rows.select("month").distinct().orderBy("month").collect()]
    out = None
    for i in range(train_months + math.ceil(purge_days / 31), len(months), every):
        test = months[i : i + every]
        first = F.lit(test[0])
        train = rows.where((F.col("month") >= F.add_months(first, -train_months)) & (F.col("date") < F.date_sub(first, purge_days)) & F.col("label").isNotNull())
        if train.count() < least:
            continue
        model = GBTRegressor(maxIter=8, maxDepth=3, stepSize=0.1, seed=7, maxBins=16).fit(train)
        made = model.transform(rows.where(F.col("month").isin(test))).select("month", "ticker", "prediction")
        out = made if out is None else out.unionByName(made)
    if out is None:
        return panel.sparkSession.createDataFrame([], "month date, ticker long, prediction double, signal double")
    n = F.count(F.lit(1)).over(Window.partitionBy("month"))
    pct = C.average_rank("prediction", "month") / n
    return out.withColumn("signal", (pct - 0.5) * 2)


def signal_metrics(signal: DataFrame, panel: DataFrame, target: str, least: int = 10) -> DataFrame:
    """(month, ic, n) of a signal (month, ticker, signal)."""
    return C.monthly_ic(signal.join(panel.select("month", "ticker", target), ["month", "ticker"]), "signal", target, least)


def latest_signal(signal: DataFrame) -> DataFrame:
    """The last row per ticker."""
    return signal.groupBy("ticker").agg(F.max_by(F.struct("month", "prediction", "signal"), "month").alias("r")).select("ticker", "r.*")
