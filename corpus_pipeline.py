"""The corpus pipeline: documents go through quality rules, near-duplicate removal, benchmark decontamination and mixing,
and end as token ids in binary shards. Every stage takes what the one before it kept.

Nulls, ties, repeated rows and empty tables are handled as the operators state. Other columns of ``documents`` are carried
along unread; the last stage returns the places of the documents in the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontam, mixing, quality, simhash, tokens
from pagemill.llm.queries import tokenizer_path
from pagemill.llm.store import row_key, shared_dir, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule of the cascade rejects."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark window."""
    keyed = docs.select(row_key().alias("_key"), F.struct("*").alias("_row"))
    found = decontam.decontaminate(keyed.select("_key", "_row.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
                                   id_col="_key")
    bad = written(found.where("contaminated").select("id").distinct(), shared_dir(spark, "contaminated"))
    return keyed.join(bad, F.col("_key") == F.col("id"), "left_anti").select("_row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards; doc_id, k (number among rows of that id), start, n_tokens and ids_crc32 read back by key."""
    found = tokens.round_trip(docs, shared_dir(spark, "corpus"), tokenizer_path())
    return found.select(F.col("id").alias("doc_id"), "k", "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing sources to target weights", source_mixing),
          ("token-ID output", token_output)]

# The tokenizer of the last stage can't be said in SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"{folder}/stage-{number}")
    return docs
