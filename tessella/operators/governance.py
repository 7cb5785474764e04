"""Bindings of approvals to data, snapshot manifests and coverage of departed names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(df: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """(key, digest): SHA-256 of each group's rows as canonical JSON (sorted, fixed column order)."""
    rows = F.array_sort(F.collect_list(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})))
    return df.groupBy(*key).agg(F.sha2(F.array_join(rows, "\n"), 256).alias("digest"))


def reviewed(items: DataFrame, approvals: DataFrame, key: str) -> DataFrame:
    """items (key, digest, verified) with status: auto_verified, approved (an approval names the same digest) or review_required."""
    a = approvals.select(key, "digest", F.lit(True).alias("_ok")).distinct()
    j = items.join(a, [key, "digest"], "left")
    return j.select(*items.columns, F.when(F.col("verified"), "auto_verified").when(F.col("_ok"), "approved").otherwise("review_required").alias("status"))


def manifest_issues(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, issue) of files that a manifest (path, sha256) lacks, names in vain, or whose content differs. Files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    have = files.select(name.alias("path"), F.sha2("content", 256).alias("actual"))
    j = have.join(manifest, "path", "full")
    issue = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "changed")
    return j.select("path", issue.alias("issue")).where("issue is not null")


def departed_coverage(intervals: DataFrame, present: DataFrame, least: float = 0.98) -> DataFrame:
    """(listing_id, spells, least_ratio, covered) of identities that are not in the present set: all spells covered to the bar."""
    gone = intervals.join(present.select("listing_id"), "listing_id", "left_anti")
    return gone.groupBy("listing_id").agg(F.count(F.lit(1)).alias("spells"), F.min("ratio").alias("least_ratio"), F.bool_and(F.col("ratio") >= least).alias("covered"))


def drop_before(df: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows of a ticker before its first valid date go; firsts: (ticker, first_valid)."""
    j = df.join(F.broadcast(firsts), "ticker", "left")
    return j.where(F.col("first_valid").isNull() | (F.col("date") >= F.col("first_valid"))).select(*df.columns)


def drop_listed(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose (ticker, date) is listed as made up go."""
    return df.join(listed.select("ticker", "date"), ["ticker", "date"], "left_anti")
