"""Sinks: tables, reports and hourly raw logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, by: str = "month") -> None:
    """Parquet partitioned by month, one file per partition and task; Spark's commit makes it atomic."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def hourly_log(stream: DataFrame, path: str, state: str):
    """A stream (t_local micros, src, msg) as JSON lines, gz, in folders by hour; each row once."""
    rows = stream.withColumn("hour", F.date_format(F.timestamp_micros("t_local"), "yyyy-MM-dd-HH"))
    return rows.writeStream.format("json").option("compression", "gzip").partitionBy("hour").option("path", path).option("checkpointLocation", state).outputMode("append")
