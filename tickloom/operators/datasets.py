"""Dataset builders and summaries composed of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import carry, features, timealign
from .index import global_index


def fill_bars(bars: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """bars (keys, open_ms, n_trades) with interior bars that only the reference has; filled marks these.

    Their counts are scaled by the median ratio of counts where both have a bar
    (1 if none does).
    """
    on = [*keys, "open_ms"]
    ends = bars.groupBy(*keys).agg(F.min("open_ms").alias("__lo"), F.max("open_ms").alias("__hi"))
    met = bars.select(*on, "n_trades").join(reference.select(*on, F.col("n_trades").alias("__m")), on)
    ratio = met.groupBy(*keys).agg(F.median(F.col("n_trades") / F.greatest("__m", F.lit(1))).alias("__ratio"))
    new = reference.join(ends, keys).filter(F.col("open_ms").between(F.col("__lo"), F.col("__hi"))).join(bars.select(*on), on, "left_anti")
    new = new.join(ratio, keys, "left").select(*on, (F.col("n_trades") * F.coalesce("__ratio", F.lit(1.0))).alias("n_trades"), F.lit(True).alias("filled"))
    return bars.select(*on, F.col("n_trades").cast("double").alias("n_trades"), F.lit(False).alias("filled")).unionByName(new)


def kline_dataset(bars: DataFrame, horizon: int, columns: list[str], keys=("symbol",)) -> DataFrame:
    """Features of bars with y_bps, the return over `horizon` bars by position; rows with a missing value go."""
    w = Window.partitionBy(*keys).orderBy("open_ms")
    y = (F.lead("close", horizon).over(w) / F.col("close") - 1) * 1e4
    return features.kline_features(bars, keys).withColumn("y_bps", y).filter(features.finite([*columns, "y_bps"])).select(*keys, "open_ms", *columns, "y_bps")


def label_ahead(bars: DataFrame, horizon: int, keys: list[str]) -> DataFrame:
    """bars with y_bps, the return to the bar at exactly open_ms + horizon, null if there is none."""
    y = (timealign.position_ahead(bars, keys, "open_ms", horizon, "close") / F.col("close") - 1) * 1e4
    return bars.withColumn("y_bps", y)


def fold_summary(folds: DataFrame, x: str) -> DataFrame:
    """One row: mean, median, min, max and share above 0 of a per-fold score."""
    return folds.agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg((F.col(x) > 0).cast("double")).alias("positive"))


def smallest_mode(df: DataFrame, x: str) -> DataFrame:
    """The most frequent value of x; of ties the smallest."""
    return df.groupBy(x).agg(F.count("*").alias("n")).orderBy(F.desc("n"), x).limit(1)


def halves(trades: DataFrame, t: str, tie: list[str], x: str) -> DataFrame:
    """n, mean, hit rate and t statistic of x in the first n // 2 trades and in the rest."""
    i = global_index(trades, t, tie)
    n = i.agg((F.max("idx") + 1).alias("__n"))
    half = F.when(F.col("idx") < F.expr("__n div 2"), "first").otherwise("second").alias("half")
    g = i.join(F.broadcast(n)).groupBy(half)  # n is one row
    out = g.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.avg((F.col(x) > 0).cast("double")).alias("hit"), F.stddev_samp(x).alias("__s"))
    return out.withColumn("t_stat", F.try_divide(F.col("mean"), F.col("__s") / F.sqrt("n"))).drop("__s")


def longest_gap(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """(from_t, to_t, gap) of the longest step of each key; of ties the earliest."""
    d = carry.previous(df.select(*keys, t), keys, t, [], [t], name="__prev").withColumn("__p", F.col(f"__prev.{t}")).filter("__p IS NOT NULL")
    row = F.max_by(F.struct(F.col("__p").alias("from_t"), F.col(t).alias("to_t")), F.struct(F.col(t) - F.col("__p"), -F.col("__p")))
    return d.groupBy(*keys).agg(row.alias("__x")).select(*keys, "__x.from_t", "__x.to_t", (F.col("__x.to_t") - F.col("__x.from_t")).alias("gap"))


def clock_jumps(df: DataFrame, keys: list[str], order: str, wall: Column, mono: Column, limit: int, bucket: int = 1 << 18) -> DataFrame:
    """Rows where the wall clock moved against the monotone one by more than limit since the row before; order is a number."""
    d = carry.previous(df.withColumns({"__w": wall, "__m": mono}), keys, order, [], ["__w", "__m"], bucket, "__prev")
    jump = (F.col("__w") - F.col("__prev.__w")) - (F.col("__m") - F.col("__prev.__m"))
    return d.withColumn("jump", jump).drop("__w", "__m", "__prev").filter(F.abs("jump") > limit)


def top_levels(px: str, qty: str, n: int, descending: bool) -> Column:
    """The best n (key, value) entries of a ladder with one quantity per price; empty levels go."""
    entries = F.filter(F.map_entries(F.map_from_arrays(px, qty)), lambda e: e["value"] > 0)
    return F.slice(F.sort_array(entries, asc=not descending), 1, n)


def flatten_levels(df: DataFrame, arrays: list[str], depth: int) -> DataFrame:
    """Arrays as columns <array>_<i>, from 0; null beyond an array's end."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, *[F.get(a, F.lit(i)).alias(f"{a}_{i}") for a in arrays for i in range(depth)])
