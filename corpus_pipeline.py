"""A corpus pipeline of five stages, from raw documents to token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. A driver may write each stage's result as
Parquet and read it again; run() does so in the shared folder.

Null texts count as empty, null sources as a source of their own; rows with null
or repeated ids are documents of their own; further columns are kept; an empty
table gives an empty one. Of texts without words none passes the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, common, exact_dedup, mixing, near_dup, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and every quality rule."""
    return quality.kept_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8), the one with the smallest id."""
    return near_dup.one_of_each(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe.round_trip(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("BPE", tokens)]

#: SQL can't express the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
