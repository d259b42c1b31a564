"""Windows over a key's rows in order, cut into buckets of time.

A key with a third of all rows is many groups: each bucket is one, and what it
needs of earlier ones (the last row, a running total) is carried over a table
with a row per key and bucket. Rows with a null key are a key of their own; rows
without a time come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined to right on keys, null meeting null; right's keys go."""
    other = right.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"__on_{k}" for k in keys])


def with_bucket(df: DataFrame, t: str, bucket: int = DAY) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(t) / bucket).cast("long"))


def previous(df: DataFrame, keys: list[str], t: str, tie: list[str], columns: list[str], bucket: int = DAY, name: str = "prev") -> DataFrame:
    """df with name: a struct of the columns of the row ahead in the order of t and tie; null for the first of a key."""
    d = with_bucket(df, t, bucket)
    row = F.struct(*columns)
    w = Window.partitionBy(*keys, "__b").orderBy(t, *tie)
    ends = d.groupBy(*keys, "__b").agg(F.max_by(row, F.struct(t, *tie)).alias("__last"))
    ends = ends.select(*keys, "__b", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b")).alias("__carry"))
    out = matched(d.withColumn("__lag", F.lag(row).over(w)), ends, [*keys, "__b"])
    return out.select(*df.columns, F.coalesce("__lag", "__carry").alias(name))


def running_sum(df: DataFrame, keys: list[str], t: str, tie: list[str], value: Column, name: str, bucket: int = DAY) -> DataFrame:
    """df with name: the sum of value over a key's rows up to and with this one."""
    d = with_bucket(df, t, bucket).withColumn("__v", value)
    w = Window.partitionBy(*keys, "__b").orderBy(t, *tie).rowsBetween(Window.unboundedPreceding, 0)
    sums = d.groupBy(*keys, "__b").agg(F.sum("__v").alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__b", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__base"))
    out = matched(d.withColumn("__own", F.sum("__v").over(w)), sums, [*keys, "__b"])
    return out.select(*df.columns, (F.col("__own") + F.col("__base")).alias(name))


def positions(df: DataFrame, keys: list[str], t: str, tie: list[str], name: str = "idx", bucket: int = DAY) -> DataFrame:
    """df with name: a row's place, from 0, among its key's rows."""
    return running_sum(df, keys, t, tie, F.lit(1).cast("long"), name, bucket).withColumn(name, F.col(name) - 1)
