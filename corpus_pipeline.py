"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, mixing.

Each stage reads the table that the one before wrote.  The filtering stages remove only what their method names: texts
without a language, lines found in ten or more documents, all but one row of a group of near-duplicates, and
documents that hold a benchmark passage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.decontam import decontaminate
from quantloom.llm.language_id import identify, train
from quantloom.llm.line_dedup import dedup_lines
from quantloom.llm.mixing import mixed
from quantloom.llm.ngram_join import ngram_components
from quantloom.llm.runtime import materialize, release, tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or below the calibrated score go; those with a null doc_id are judged like all."""
    return identify(docs, train(docs)).where("not rejected").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; no document does.  n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the one with the least doc_id, null last, then the least row hash.

    Near-duplicates share 0.8 of their five-word shingles; the operator's defaults are those of op10's own contract.
    Rows without words are linked with nothing: of those with equal columns one stays.
    """
    # written, so that a row keeps its number
    rows = materialize(docs.withColumn("\0row", F.monotonically_increasing_id()))
    groups = ngram_components(rows.select(F.col("\0row").alias("doc_id"), "text"), width=5, threshold=(8, 10))
    groups = groups.select(F.col("doc_id").alias("\0row"), "component_id", "n_shingles")
    hash_ = F.xxhash64(*docs.columns)
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    alike = F.when(F.col("n_shingles") == 0, F.struct("doc_id", hash_.alias("hash")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", hash_.alias("hash"), "\0row"))["\0row"]
    stay = rows.join(groups, "\0row").groupBy(group.alias("group"), alike.alias("alike")).agg(first.alias("\0row")).select("\0row")
    return rows.join(stay, "\0row", "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_length=True).where("not contaminated").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; `copy` numbers the copies."""
    return mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", join_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
#: A learned model and copies by a dual have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each reads the table that the one before wrote to the shared folder.

    A stage's own tables and the one that it read are deleted once its result is written.  A missing or empty benchmark
    text marks nothing, an empty table of documents gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = tables()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
            release(spark, first, keep=1)
    return docs
