"""The corpus pipeline: each stage works on all that its predecessor kept.

A stage takes documents with any further columns and gives its columns back as they are (the last one
gives token counts); an empty table goes through to an empty result.  ``run`` writes what each stage
leaves to the folder that driver and executors share, so a stage reads its input as a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, decontaminate, exact_dedup, minhash, quality
from barloom.llm.common import shared_dir, table
from barloom.llm.queries import trusted, vocabulary


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text finds neither too surprising nor too dull.

    Null and empty texts have no perplexity and stay; so does everything where nothing is trusted.
    """
    return quality.drop_poor(docs, trusted(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text without its white space: the longest, then the smallest id.  Null counts as empty."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at a similarity of 0.8: the smallest id.  Texts without words stay."""
    return minhash.drop_near_copies(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without more than a passing overlap with the benchmark; null and empty texts have none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each row; a null text has no tokens."""
    return bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"), full=False)


STAGES = [
    ("quality classifier", drop_poor),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: DuckDB cannot express the language model, the near-duplicate operator and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}")
    return docs
