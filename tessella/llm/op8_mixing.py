"""Mixing sources to target weights by pivotal dependent rounding.

Targets: the sources, by code point and null last, weigh 3, 1, 2, repeating,
and share 150 % of all words; a target stops at twice its source's words and
the excess is shared again by weight (the water level that this ends at is
computed directly). A document of a source whose target is ``r`` times its
words is taken ``floor(r)`` times, and once more with probability
``r - floor(r)``.

The extra copies are decided by weighted pivotal rounding: an undecided
document meets the next, and words (probability times size) pass from one
to the other, at random but fair, until one of the two is decided. The sum
of words stays, so a leaf (a bounded, hashed share of a source) leaves at
most one undecided document; a reduction tree pairs these, level by level,
down to one per source, which a draw decides. A source's words so miss its
target by less than one document, whatever the partitions. Draws are hashes
of seed and documents: reruns agree.

Cases: null and wordless texts have size 0 and are never taken; a null
source is a source of its own, last; repeated rows and equal doc_ids are
documents of their own; a null doc_id is an id like others; extra columns
pass through ``mix`` untouched; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import kernels as K
from .staging import BROADCAST_BYTES, Staged, bounded, partitions, release

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
LEAF_ROWS = 2_000
FAN = 64
SEED = 20240611
_TINY = 1e-9


def targets(sizes: list[float]) -> list[float]:
    """Targets of sources in their order: min(CAP * size, level * weight), of SHARE times all."""
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), SHARE * sum(sizes), sum(weight)
    for i in sorted(range(len(sizes)), key=lambda i: (CAP * sizes[i] / weight[i], i)):
        out[i] = min(CAP * sizes[i], left * weight[i] / open_)
        left -= out[i]
        open_ -= weight[i]
    return out


def _hash01(*parts: int) -> float:
    x = SEED
    for p in parts:
        x = (x ^ p & 0xFFFFFFFFFFFFFFFF) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
    return ((x >> 11) + 0.5) / (1 << 53)


def pivot(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """Moves words between probabilities p and q of sizes a and b until one is 0 or 1."""
    up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
    if u * (up + down) < down:
        p, q = p + up / a, q - up / b
    else:
        p, q = p - down / a, q + down / b
    return tuple(0.0 if x < _TINY else 1.0 if x > 1 - _TINY else x for x in (p, q))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in K.slices(batch.column(3)):
            n = np.diff(K.words(buf, off)[2])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(n.astype(np.int64))], ["doc_id", "source", "h", "size"])


def _round(level: int):
    """Pivots the rows of each (source, block), which come together and in order; at most one stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = held = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["source"], row["block"]) != group:
                    if held:
                        out.append(held)
                    group, held = (row["source"], row["block"]), None
                if row["p"] <= 0 or row["p"] >= 1 or row["size"] == 0:
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    u = _hash01(level, held["doc_id"] or 0, held["h"], row["doc_id"] or 0, row["h"])
                    held["p"], row["p"] = pivot(held["p"], held["size"], row["p"], row["size"], u)
                    done = [x for x in (held, row) if x["p"] in (0.0, 1.0)]
                    out += done
                    held = next((x for x in (held, row) if x["p"] not in (0.0, 1.0)), None)
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
            schema = batch.schema
        if held:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    return run


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, h, size, source_size, target, copies of each row of docs (doc_id, source, text)."""
    return _copies(docs)[0]


def _copies(docs: DataFrame) -> tuple[DataFrame, list[Staged]]:
    """As ``copies``, and the tables that it reads."""
    spark = bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("h"), "text")
    sized = Staged(rows.mapInArrow(_sizes, "doc_id long, source string, h long, size long"), "sizes")
    # one row per source
    found = sized.df().groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    aim = targets([float(r.size) for r in found])
    plan = [(r.source, r.size, t, min(2.0, t / r.size) if r.size else 0.0) for r, t in zip(found, aim)]
    plan = [(s, n, t, float(int(x + _TINY)), max(0.0, x - int(x + _TINY))) for s, n, t, x in plan]
    sources = spark.createDataFrame(plan, "source string, source_size long, target double, base double, p double")
    blocks = max(1, -(-sum(r.n for r in found) // LEAF_ROWS))
    level = 0
    order = F.xxhash64(F.lit(SEED), "doc_id", "h")
    now = sized.df().join(F.broadcast(sources.withColumnRenamed("source", "_s")), F.expr("source <=> _s")).drop("_s")
    now = now.withColumn("p", F.when(F.col("p") < _TINY, 0.0).otherwise(F.col("p"))).withColumn("block", F.pmod(order, F.lit(blocks)))
    decided = []
    while True:
        dealt = now.repartition(partitions(spark), "source", "block").sortWithinPartitions("source", "block", order, "doc_id", "h", "size")
        done = Staged(dealt.mapInArrow(_round(level), dealt.schema), "rounded")
        decided.append(done)
        if blocks == 1:
            break
        now, blocks, level = done.df().where("p > 0 and p < 1 and size > 0"), -(-blocks // FAN), level + 1
        now = now.withColumn("block", F.floor(F.col("block") / FAN))
    closed = [d.df().where("p <= 0 or p >= 1 or size = 0") for d in decided]
    # one open row per source is left: a draw decides it
    last = decided[-1].df().where("p > 0 and p < 1 and size > 0")
    draw = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    out = last.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0))
    for c in closed:
        out = out.unionByName(c)
    taken = F.when(F.col("size") == 0, 0).otherwise(F.col("base") + F.col("p")).cast("int")
    return out.select("doc_id", "source", "h", "size", "source_size", "target", taken.alias("copies")), [sized, *decided]


def mix(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it, all columns kept."""
    names = docs.columns
    found, read = _copies(docs)
    made = Staged(found, "copies")
    for t in read:
        t.drop()
    release(docs.sparkSession)
    key = ["doc_id", "source", "h"]
    grouped = made.df().groupBy(*key).agg(F.sort_array(F.collect_list("copies")).alias("_copies"))  # identical rows only
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.col("source").cast("string").alias("_s"), F.xxhash64("text").alias("_h"))
    if grouped.where("size(_copies) > 1").isEmpty():
        rows = rows.withColumn("_n", F.lit(1))
    else:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_i", "_s", "_h").orderBy(F.lit(0))))
    side = F.broadcast(grouped) if made.rows() * 96 <= BROADCAST_BYTES else grouped
    both = rows.join(side, rows["_i"].eqNullSafe(side["doc_id"]) & rows["_s"].eqNullSafe(side["source"]) & (rows["_h"] == side["h"]))
    n = F.element_at("_copies", F.col("_n"))
    return both.select("_row", F.explode(F.array_repeat(F.lit(0), n)).alias("_k")).select(*(F.col("_row").getField(c).alias(c) for c in names))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLE: dict[str, str] = {}  # sequential random rounding; tests/llm/test_op8.py checks its law
