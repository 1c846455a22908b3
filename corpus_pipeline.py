"""The corpus pipeline: raw documents to packed training sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. So a stage begins by deleting the intermediate tables of the stages before it. All but the last return
the columns of documents. There is no SQL for the whole (ORACLE_SQL): weak supervision, sketches and tokenization are outside of what
SQL can say, so the tests hold each stage against brute force. An empty table goes through all stages and gives no sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import decontaminate, neardup, packing, quality, substring
from catalens.llm.common import release
from catalens.llm.tokenizers import tokenizer_path, tokenizer_pattern
from catalens.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is low go."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike in four fifths of their five-word shingles the one with the smallest id stays."""
    release(spark)
    return neardup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more stay at their first place only."""
    release(spark)
    return substring.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item go."""
    release(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: padded ids and the pieces of documents in them. Null texts count as empty, null ids stay, further columns end here."""
    release(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("repeated passages", substring_dedup),
    ("benchmark passages", benchmark_decontamination),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
