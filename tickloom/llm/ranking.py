"""Ranks and prefix sums over hash-random order, without a group in one task.

Rows of a key (a source, say) are dealt by a uniform hash into buckets that are
ranges of the hash. Row numbers and running sums are windows over one bucket;
bucket totals, a table of a few rows per key, give the offsets. A key with a
third of all rows is so spread over as many tasks as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket holds on average at most.
BUCKET_ROWS = 8192


def unit(seed: int, *cols: str) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) * F.lit(2.0**-53)


def positions(df: DataFrame, keys: list[str], bucket: Column, order: list, size: str | None = None) -> DataFrame:
    """df with position (from 0) and, given size, before (sum of size ahead) within keys.

    bucket: ascending with order, and of about equal numbers of rows.
    """
    df = df.withColumn("__b", bucket)
    by = Window.partitionBy(*keys, "__b").orderBy(*order)
    sums = {"position": F.row_number().over(by) - 1}
    totals = [F.count("*").alias("__n")]
    if size:
        sums["before"] = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
        totals.append(F.sum(size).alias("__s"))
    offsets = df.groupBy(*keys, "__b").agg(*totals)
    ahead = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    made = [F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__n0")]
    if size:
        made.append(F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__s0"))
    offsets = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__ob"), *made)
    on = F.col("__b") == F.col("__ob")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = df.withColumns(sums).join(offsets, on)
    out = out.withColumn("position", (F.col("position") + F.col("__n0")).cast("long"))
    if size:
        out = out.withColumn("before", (F.col("before") + F.col("__s0")).cast("long"))
    return out.drop("__b", "__ob", "__n0", "__s0", *[f"__k{i}" for i in range(len(keys))])
