"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree of regions, racks and shards; each level draws one child per row by
weighted rendezvous: child ``c`` of weight ``w`` waits ``-ln(u) / w`` for a
``u`` hashed from the key and ``c``'s name, and the shortest wait wins. A
child whose weight grows only gains rows and one that shrinks only loses
rows, so a change moves rows between the subtrees whose weights change. The
default topology opens a new region for what goes beyond the full ones: one
more shard is a subtree of its own and only takes rows.

Slots are gapless in each shard by doc_id. They come from two levels (counts
of sub-ranges, then places inside them), so no task holds a whole shard.

Cases: null text has size 1 and the crc of no bytes; a null doc_id hashes as
the word null; repeated rows and equal doc_ids go to one shard and get slots
of their own (in order of size and crc); extra columns are ignored; an empty
table stays empty. No shard depends on text or partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 16
RACK_SHARDS = 4
REGION_RACKS = 2
SUB_ROWS = 50_000  # about so many rows of a shard are numbered by one task

Tree = dict[str, dict[str, dict[int, float]]]


def topology(shards: int, full: int = SHARDS) -> Tree:
    """Regions of racks of equal shards; every shard from ``full`` on opens a region of its own."""
    tree: Tree = {}
    for s in range(shards):
        r = f"r{s // (RACK_SHARDS * REGION_RACKS)}" if s < full else f"x{s}"
        k = f"{r}.k{s // RACK_SHARDS % REGION_RACKS}" if s < full else f"{r}.k0"
        tree.setdefault(r, {}).setdefault(k, {})[s] = 1.0
    return tree


def _wait(key: Column, name: str, weight: float) -> Column:
    """Exponential waiting time of a child; 48 bits of a hash, never 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 48))) / F.lit(weight)


def _draw(key: Column, children: dict, weights: dict) -> Column:
    """The name of the child that wins; ties go to the first name."""
    names = sorted(children)
    if len(names) == 1:
        return F.lit(names[0])
    waits = F.array(*(F.struct(_wait(key, str(n), weights[n]).alias("t"), F.lit(n).alias("n")) for n in names))
    return F.array_min(waits)["n"]


def place(df: DataFrame, key: str, tree: Tree, to: str) -> DataFrame:
    """Adds the shard (int) of the key column, by descending the tree."""
    rack_w = {k: sum(s.values()) for racks in tree.values() for k, s in racks.items()}
    region_w = {r: sum(rack_w[k] for k in racks) for r, racks in tree.items()}
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    out = df.withColumn("_region", _draw(k, tree, region_w))
    rack = F.coalesce(*(F.when(F.col("_region") == r, _draw(k, racks, rack_w)) for r, racks in sorted(tree.items())))
    out = out.withColumn("_rack", rack)
    shard = F.coalesce(*(F.when(F.col("_rack") == n, _draw(k, s, s)) for racks in tree.values() for n, s in sorted(racks.items())))
    return out.withColumn(to, shard.cast("int")).drop("_region", "_rack")


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of docs (doc_id long, text string)."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = place(place(rows, "doc_id", topology(shards, shards), "shard"), "doc_id", topology(shards + 1, shards), "grown_shard")
    # sub-ranges of doc_id, about SUB_ROWS rows of each shard, whatever gaps the ids have
    n = docs.count()
    parts = max(1, n // (SUB_ROWS * shards))
    cuts = sorted(set(docs.select(F.col("doc_id").cast("long").alias("i")).approxQuantile("i", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    sub = F.size(F.filter(F.array(*(F.lit(int(c)) for c in cuts)), lambda c: c <= F.coalesce("doc_id", F.lit(-(1 << 63))))) if cuts else F.lit(0)
    rows = rows.withColumn("sub", sub)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n")).select("shard", "sub", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "sub").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")) - 1
    out = rows.withColumn("inside", inside).join(F.broadcast(counts), ["shard", "sub"])  # shards x sub-ranges rows
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"), "grown_shard")


def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_hash_tree": op6_hash_tree}
ORACLE: dict[str, str] = {}  # crc32 is not in DuckDB; tests/llm/test_op6.py has the plain version
