"""The training-data pipeline: quality, exact copies, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galley.llm.common import Scratch
from galley.llm.decontamination import without_leaks
from galley.llm.exact_dedup import without_duplicates
from galley.llm.kneser_ney import without_rejected
from galley.llm.packing import best_fit_pack, tokenizer_path
from galley.llm.simhash import without_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the threshold of their language."""
    return without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest doc_id."""
    return without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, with their places in sequences of 1024."""
    return best_fit_pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", decontaminated), ("best-fit packing", packed)]

#: SQL can express neither the scores nor the tokens; the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage is written before the next one reads it, and then its own intermediate tables and its input go."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = set(Scratch.live)
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        for used in Scratch.live - before:
            used.drop()
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
