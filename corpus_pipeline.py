"""A corpus pipeline: language ID, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept, and returns a table; all but the last return the columns
that they get. ``run`` writes every stage's table to the shared folder and
reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import op2_decontaminate, op3_token_binary, op5_language, op8_mixing, op10_jaccard_join
from tessella.llm.staging import Staged, small


def _boxed(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row in one column beside the named ones, so that added columns clash with none."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(docs[c] for c in names))


def _unboxed(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as one of the learned languages stay; those without a letter, whose language cannot be told, go.

    Null and empty texts have no letter. Without any label there is no model
    to reject by, and all documents with a letter stay.
    """
    model = op5_language.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = op5_language.detect(_boxed(docs, "doc_id", "text", "lang"), model)
    return _unboxed(found.where(F.col("lang_pred") != op5_language.UND), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays; of rows equal in doc_id and text, one."""
    classes = Staged(op10_jaccard_join.jaccard_classes(docs), "classes")
    gone = Staged(classes.df().where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone).withColumnRenamed("doc_id", "_gone"), docs["doc_id"] == F.col("_gone"), "left_anti")
    if classes.df().where("component_id = doc_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    one = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("h"))
    boxed = _boxed(kept, "doc_id").withColumn("h", F.xxhash64(F.col("row").getField("text"))).withColumn("k", one)
    return _unboxed(boxed.where("k = 1 or doc_id is null"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = op2_decontaminate.mark(_boxed(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unboxed(found.where(~F.col("contaminated")), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: none, one or two times."""
    return op8_mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens, ids_crc32, read from the files."""
    return op3_token_binary.token_digests(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", tokens),
]

# Trained, ranked, random and tokenising stages are not SQL; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prior = None
    for name, stage in STAGES[:-1]:
        table = Staged(stage(spark, docs, sf_dir), name.split()[0].lower())
        if prior is not None:
            prior.drop()
        docs, prior = table.df(), table
    return STAGES[-1][1](spark, docs, sf_dir)
