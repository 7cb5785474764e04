"""Structured Streaming forms of batch operators; with availableNow they equal them.

Late data: rows up to the watermark's delay after the newest event time are
taken in their place; older ones are dropped by the engine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, or a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tessella-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def bins(ticks: DataFrame, width: str, delay: str = "10 minutes") -> DataFrame:
    """Streaming tumbling last prices: as operators.ticks.bins."""
    agg = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("w")).agg(F.max_by("price", F.struct("ts", "seq")).alias("price"), F.count(F.lit(1)).alias("n"))
    return agg.select("symbol", F.col("w.start").alias("start"), "price", "n")


def onsets(buys: DataFrame, window_days: int = 21, owners: int = 2) -> DataFrame:
    """Streaming cluster onsets of (ticker, date, owner): state is the trailing window's (day, owner) pairs per ticker."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x.split("|")) for x in (state.get[0] or "").split(",") if x] if state.exists else []
        held = [(int(a), b) for a, b in held]
        rows = pd.concat(list(frames))
        rows["day"] = (pd.to_datetime(rows["date"]) - pd.Timestamp(0)).dt.days
        out = []
        for day, g in rows.groupby("day"):
            held = [(a, b) for a, b in held if a >= day - window_days]
            before = {b for a, b in held if a < day}
            held += [(int(day), str(o)) for o in sorted(set(g["owner"]))]
            if len(before) < owners <= len({b for _, b in held}):
                out.append((key[0], g["date"].iloc[0]))
        state.update((",".join(f"{a}|{b}" for a, b in sorted(set(held))),))
        yield pd.DataFrame(out, columns=["ticker", "date"])

    return buys.groupBy("ticker").applyInPandasWithState(run, "ticker long, date date", "held string", "append", GroupStateTimeout.NoTimeout)


def latest_state(rows: DataFrame) -> DataFrame:
    """Streaming backward as-of: rows (key, ts, side, value), side 0 sets the key's value, side 1 asks for it; a null set blanks."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "side"]).itertuples(index=False):
            if r.side == 0:
                value = None if pd.isna(r.value) else float(r.value)
            else:
                out.append((key[0], r.ts, value))
        state.update((value,))
        yield pd.DataFrame(out, columns=["key", "ts", "value"]).astype({"value": "float64"})

    return rows.groupBy("key").applyInPandasWithState(run, "key long, ts timestamp, value double", "value double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its result as a table."""
    spark = stream.sparkSession
    at = scratch(spark)
    out, schema = f"{at}/out", stream.schema
    write = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        q = write.format("parquet").outputMode("append").start(out)
    else:
        q = write.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
