"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; the row of rank r (from 0)
of n gets the fraction (r + 0.5) / n. Sorted by fraction, every stretch of rows
holds every source in proportion, so equal cuts give shards of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .ranking import BUCKET_ROWS, positions, unit


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, bucket_rows: int = BUCKET_ROWS, keep: tuple = ()) -> DataFrame:
    """One row per input row: doc_id, source, size, text_crc32, shard, slot, and the narrow columns of keep.

    Shards differ by one row at most (law `rows`). size: UTF-8 bytes of the text
    plus 1, a null text counting as empty. Null sources are a source of their
    own; ties (repeated ids) are ordered by text checksum and size, and wholly
    equal rows are interchangeable. Only narrow rows are shuffled, never texts.
    """
    text = common.text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.octet_length(text).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *keep)
    rows = common.saved(rows.withColumn("size", F.col("size") + 1), "shard-rows")
    total = rows.count()
    per = rows.groupBy("source").agg(F.count("*").alias("__total"))
    buckets = common.buckets_for(total, bucket_rows)
    rows = rows.withColumn("__u", unit(seed, "doc_id", "text_crc32", "size"))
    ranked = positions(rows, ["source"], F.floor(F.col("__u") * buckets), ["__u", "doc_id", "text_crc32", "size"])
    ranked = ranked.join(per.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    ranked = ranked.withColumn("__f", (F.col("position") + 0.5) / F.col("__total")).drop("position")
    order = ["__f", F.col("source").asc_nulls_last(), "__u", "doc_id", "text_crc32", "size"]
    cut = positions(ranked, [], F.floor(F.col("__f") * buckets), order)
    n = F.lit(total)
    cut = cut.withColumn("shard", F.expr(f"position * {shards} div {max(total, 1)}").cast("int"))
    return cut.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("position") - F.ceil(F.col("shard") * n / shards)).cast("long").alias("slot"), *keep)


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", **kw) -> None:
    """Write docs as Parquet, one folder per shard, rows in slot order within files.

    Every row is written once: rows are numbered in a saved table and meet their
    shard by that number, so repeated ids, null ids and equal rows are no matter.
    An empty table writes no file. Where docs has a column shard, the folders'
    name begins with an underscore more.
    """
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    rows = common.saved(docs.withColumn("__row", F.monotonically_increasing_id()), "shard-docs")
    own = assign(rows, shards, id_col, keep=("__row",), **kw).select("__row", F.col("shard").alias(name), F.col("slot").alias("__slot"))
    both = rows.join(own, "__row").drop("__row").repartitionByRange(name, "__slot").sortWithinPartitions(name, "__slot")
    both.drop("__slot").write.partitionBy(name).parquet(path)
    common.discard(rows)


def op5(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, under the law `rows`."""
    out = assign(common.documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
