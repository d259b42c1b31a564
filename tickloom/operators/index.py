"""Row positions without a single-task window, time splits and purged folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut as saved
from . import carry


def global_index(df: DataFrame, t: str, tie: list[str], bucket: int = 86_400_000, name: str = "idx") -> DataFrame:
    """df with its position (from 0) in the order of t and tie.

    Buckets of time are numbered apart; the bucket counts, a small table, give
    each its offset. Rows without a time come first.
    """
    d = df.withColumn("__b", F.floor(F.col(t) / bucket).cast("long"))
    counts = d.groupBy("__b").agg(F.count("*").alias("__n"))
    offset = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    w = Window.partitionBy("__b").orderBy(t, *tie)
    return carry.matched(d.withColumn("__r", F.row_number().over(w)), offset, ["__b"]).withColumn(name, (F.col("__r") - 1 + F.col("__o")).cast("long")).drop("__b", "__r", "__o")


def fold_bounds(indexed: DataFrame, t: str, folds: int, horizon: int, purge: int | None = None, expanding: bool = True, min_train: int = 500) -> DataFrame:
    """(k, tr_beg, te_beg, te_end, cut): purged walk-forward folds over rows idx = 0 .. n-1.

    Edges are int(n i / (folds + 1)). Training rows need t + horizon <= cut =
    t[te_beg] - purge; purge is horizon unless given, so labels end two horizons
    ahead of the test. Folds with fewer than min_train training rows are left
    out, and k numbers the others from 1.
    """
    purge = horizon if purge is None else purge
    indexed = saved(indexed.select("idx", t))  # positions are found once, for counts, edges and training rows
    n = indexed.agg((F.max("idx") + 1).alias("n"))
    k = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("k")
    b = n.select("n", k).select("k", F.when(F.lit(expanding), F.lit(0).cast("long")).otherwise(F.expr(f"n * (k - 1) div {folds + 1}")).alias("tr_beg"), F.expr(f"n * k div {folds + 1}").alias("te_beg"), F.expr(f"n * (k + 1) div {folds + 1}").alias("te_end"))
    b = b.join(indexed.select(F.col("idx").alias("te_beg"), (F.col(t) - purge).alias("cut")), "te_beg")
    train = indexed.select("idx", F.col(t).alias("__t")).join(F.broadcast(b), (F.col("idx") >= F.col("tr_beg")) & (F.col("idx") < F.col("te_beg")) & (F.col("__t") + horizon <= F.col("cut")))  # one row per fold
    sizes = train.groupBy("k").agg(F.count("*").alias("n_train"))
    kept = b.join(sizes, "k").filter(F.col("n_train") >= min_train)
    return kept.select(F.row_number().over(Window.orderBy("k")).alias("k"), "tr_beg", "te_beg", "te_end", "cut", "n_train")  # a row per fold


def time_split(indexed: DataFrame, t: str, horizon: int, shares=(0.6, 0.2)) -> DataFrame:
    """indexed with part (train, val, test) by position; rows whose label reaches the next part have null."""
    indexed = saved(indexed)  # positions are found once, for counts, edges and rows
    n = indexed.agg((F.max("idx") + 1).alias("__n"))
    d = indexed.join(F.broadcast(n))  # one row
    a, b = F.floor(F.col("__n") * shares[0]), F.floor(F.col("__n") * (shares[0] + shares[1]))
    edge = indexed.join(F.broadcast(n)).agg(F.min(F.when(F.col("idx") == a, F.col(t))).alias("__ta"), F.min(F.when(F.col("idx") == b, F.col(t))).alias("__tb"))
    d = d.join(F.broadcast(edge))  # one row
    part = F.when(F.col("idx") < a, F.when(F.col(t) + horizon <= F.col("__ta"), "train")).when(F.col("idx") < b, F.when(F.col(t) + horizon <= F.col("__tb"), "val")).otherwise("test")
    return d.withColumn("part", part).drop("__n", "__ta", "__tb")
