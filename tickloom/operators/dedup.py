"""Deduplication with a defined survivor, versions, and duplicate audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _picked(df: DataFrame, keys: list[str], order: list[str], by) -> DataFrame:
    # min_by and max_by combine ahead of the shuffle, so a key with many copies is no hot group.
    row = F.struct(*[F.col(c) for c in df.columns])
    out = df.groupBy(*keys).agg(by(row, F.struct(*[F.col(c) for c in order])).alias("__row"))
    return out.select("__row.*")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys, the first by order; end order with a unique column."""
    return _picked(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys, the last by order: the current state of a versioned log."""
    return _picked(df, keys, order, F.max_by)


def latest_version(df: DataFrame, keys: list[str], update: str, position: str) -> DataFrame:
    """The row with the largest update time, null counting as 0; of ties the first read."""
    made = df.withColumn("__u", F.coalesce(update, F.lit(0)))
    return _picked(made.withColumn("__p", -F.col(position)), keys, ["__u", "__p"], F.max_by).drop("__u", "__p")


def duplicate_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n_keys, duplicate_keys, ok) of a table."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys")).withColumn("ok", F.col("duplicate_keys") == 0)


def diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer diff on keys: status matched, mismatched, only_left or only_right."""
    a = left.select(*keys, F.struct(*columns).alias("__l"))
    b = right.select(*keys, F.struct(*columns).alias("__r"))
    status = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right").when(F.col("__l").eqNullSafe(F.col("__r")), "matched").otherwise("mismatched")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))
