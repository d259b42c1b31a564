"""Statistics: three quantile flavours, summaries, scores, histograms, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import carry
from ..sources.shared import cut, small


def nearest_rank(values: str, p: float) -> Column:
    """Element min(n - 1, floor(p n)) of a sorted array, from 0."""
    n = F.size(values)
    return F.get(values, F.least(n - 1, F.floor(n * p).cast("int")))


def upper_median(values: str) -> Column:
    """Element n // 2 of a sorted array."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def gap_summary(df: DataFrame, keys: list[str], t: str, gap: int) -> DataFrame:
    """n_rows, t_start, t_end, span_s, max_gap and n_gaps (steps over gap) per key."""
    d = carry.previous(df.select(*keys, t), keys, t, [], [t], name="__prev").withColumn("__d", F.col(t) - F.col(f"__prev.{t}"))
    return d.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(t).alias("t_start"), F.max(t).alias("t_end"), ((F.max(t) - F.min(t)) / 1000).alias("span_s"), F.max("__d").alias("max_gap"), F.count_if(F.col("__d") > gap).alias("n_gaps"))


#: Values that a task ranks for one quantile at most, and parts into which a range of values is cut at a time.
RANKED, PARTS = 500_000, 64


def quantiles(df: DataFrame, keys: list[str], x: str, shares: list[float], ranked: int = RANKED) -> DataFrame:
    """(keys, share, value, n): exact quantiles, interpolated between the two nearest ranks; nulls are left out.

    The range in which a quantile's two ranks lie is cut at approximate quantiles
    of its own values, the parts are counted exactly, and those that hold the
    ranks are the next range, until `ranked` values or fewer lie within. Each
    round is one partial aggregation, and there are as many as log(rows) to the
    base of PARTS: no task holds more than `ranked` values, whatever they are.
    """
    d = df.select(*keys, F.col(x).cast("double").alias("__x")).filter("__x IS NOT NULL")
    per = d.groupBy(*keys).agg(F.count("*").alias("n"), F.max("__x").alias("hi"))
    each = F.explode(F.array(*[F.lit(float(s)) for s in dict.fromkeys(shares)])).alias("share")
    # lo is outside the range, hi is its last value; below: rows at or before lo; inside: rows ahead of hi
    r = per.select(*keys, "n", each, F.lit(None).cast("double").alias("lo"), "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    by = [*keys, "share"]

    def met(ranges: DataFrame) -> DataFrame:
        both = carry.matched(d, small(ranges) if most > ranked else ranges, keys) if keys else d.crossJoin(F.broadcast(ranges))  # without keys a row per share
        return both.filter((F.col("lo").isNull() | (F.col("__x") > F.col("lo"))) & (F.col("__x") <= F.col("hi")))

    rank = (F.col("n") - 1) * F.col("share")
    low, high = F.floor(rank), F.ceil(rank)
    between = (F.col("__a") + F.when(F.col("__z") > F.col("__a"), (F.col("__z") - F.col("__a")) * (rank - low)).otherwise(0.0)).alias("value")
    out, most = None, per.agg(F.max("n")).first()[0] or 0
    if most > ranked:
        d, r = cut(d), cut(r)
        while not (wide := r.filter(F.col("inside") > ranked)).isEmpty():
            rows = met(wide).filter(F.col("__x") < F.col("hi"))
            at = F.percentile_approx("__x", F.lit([i / PARTS for i in range(1, PARTS)]), F.lit(20 * PARTS))
            edges = cut(rows.groupBy(*by).agg(F.array_distinct(at).alias("__edges")))
            ranges = carry.matched(wide, edges, by, "left").withColumn("__edges", F.coalesce("__edges", F.array().cast("array<double>")))  # none where all values are hi
            parts = met(ranges).withColumn("__part", F.size(F.filter("__edges", lambda e: e < F.col("__x"))))
            end = F.coalesce(F.get("__edges", F.col("__part")), F.col("hi"))  # edges are values, so a part ends with its edge
            sums = [F.count("*").alias("__c"), F.min("__x").alias("__first"), F.max("__x").alias("__top"), F.count_if(F.col("__x") < end).alias("__own")]
            parts = parts.groupBy(*by, "n", "lo", "below", "__part").agg(*sums)
            run = Window.partitionBy(*by).orderBy("__part")  # at most PARTS rows
            parts = parts.withColumns({"__end": F.col("below") + F.sum("__c").over(run), "__prev": F.lag("__top").over(run)}).withColumn("__begin", F.col("__end") - F.col("__c"))
            held = parts.filter((F.col("__end") > low) & (F.col("__begin") <= high)).groupBy(*by, "n").agg(
                F.count("*").alias("__parts"), F.min("__top").alias("__a"), F.max("__first").alias("__z"), F.min_by(F.coalesce("__prev", "lo"), "__part").alias("lo"), F.max("__top").alias("hi"), F.min("__begin").alias("below"), F.max("__own").alias("inside")
            )
            held = cut(held)
            # ranks on both sides of a cut are the last value of one part and the first of the next
            split = held.filter("__parts > 1").select(*keys, "share", between, "n")
            out = split if out is None else out.unionByName(split)
            r = cut(r.filter(F.col("inside") <= ranked).unionByName(held.filter("__parts = 1").select(r.columns)))
    c = met(r).groupBy(*by, "n", "below", F.col("__x").alias("__v")).agg(F.count("*").alias("__c"))
    c = c.withColumn("__end", F.col("below") + F.sum("__c").over(Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))  # at most `ranked` values and the last
    hit = lambda rank: F.min(F.when(F.col("__end") > rank, F.col("__v")))
    exact = c.groupBy(*by, "n").agg(hit(low).alias("__a"), hit(high).alias("__z")).select(*keys, "share", between, "n")
    return exact if out is None else exact.unionByName(out)


def histogram(df: DataFrame, x: str, bins: int = 41, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """(bin, center, n) over [q_low, q_high], values outside clipped, the last bin closed, empty bins 0.

    Where these quantiles are equal the range is that of all values, widened by 1e-9 on both sides.
    """
    q = quantiles(df, [], x, [low, high])
    q = q.agg(F.min_by("value", "share").alias("lo"), F.max_by("value", "share").alias("hi")).crossJoin(df.agg(F.min(x).alias("__min"), F.max(x).alias("__max")))  # one row each
    flat = ~(F.col("hi") > F.col("lo"))
    q = q.select(F.when(flat, F.col("__min") - 1e-9).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("__max") + 1e-9).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.greatest(F.least(F.col(x), F.col("hi")), F.col("lo")) - F.col("lo")) / width).cast("int"), F.lit(bins - 1))
    counted = df.filter(F.col(x).isNotNull()).join(F.broadcast(q)).withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"))  # q is one row
    slots = q.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return slots.join(counted, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


def score(df: DataFrame, y: str, p: str) -> DataFrame:
    """n, rmse, rmse_zero, improvement and ic (Pearson) of predictions p of y."""
    out = df.agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col(y) - F.col(p)) ** 2)).alias("rmse"), F.sqrt(F.avg(F.col(y) ** 2)).alias("rmse_zero"), F.corr(y, p).alias("ic"))
    return out.withColumn("improvement", 1 - F.try_divide("rmse", "rmse_zero"))


def score_bins(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, n, pred_mean, y_mean): rows by the quantile of their prediction; an empty bin has 0 throughout."""
    q = quantiles(df, [], p, [i / bins for i in range(1, bins)]).agg(F.sort_array(F.collect_list(F.struct("share", "value"))).alias("__q"))
    rows = df.filter(F.col(p).isNotNull()).crossJoin(F.broadcast(q))  # one row
    rows = rows.withColumn("bin", F.size(F.filter("__q", lambda e: e["value"] <= F.col(p))))
    got = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("pred_mean"), F.avg(y).alias("y_mean"))
    slots = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return slots.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("pred_mean", F.lit(0.0)).alias("pred_mean"), F.coalesce("y_mean", F.lit(0.0)).alias("y_mean"))


def monotonic_share(binned: DataFrame) -> DataFrame:
    """One row: the share of neighbouring bins over which y_mean rises. A table of a few bins."""
    up = F.col("y_mean") > F.lag("y_mean").over(Window.orderBy("bin"))
    return binned.select(up.alias("__up")).agg(F.coalesce(F.avg(F.col("__up").cast("double")), F.lit(0.0)).alias("monotonic"))


def r2_oos(df: DataFrame, y: str, p: str) -> DataFrame:
    """r2 against the segment's own mean; 0 where y doesn't vary."""
    a = df.agg(F.sum((F.col(y) - F.col(p)) ** 2).alias("sse"), F.var_pop(y).alias("v"), F.count(y).alias("n"))
    return a.select(F.when(F.col("v") > 0, 1 - F.col("sse") / (F.col("v") * F.col("n"))).otherwise(0.0).alias("r2"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the text of the parts only: 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def poisson(u: Column, mean: Column, most: int = 12) -> Column:
    """The Poisson number whose distribution function first exceeds u.

    For u of 32 bits (see uniform) and a mean of at most 1 the number is 12 at
    most: that of 13 or more has a probability of 6.4e-11, below 2^-32. So `most`
    cuts nothing there; for larger means give a larger one.
    """
    term, total, out = F.exp(-mean), F.exp(-mean), F.lit(0)
    for k in range(1, most + 1):
        out = out + (u >= total).cast("int")
        term = term * mean / k
        total = total + term
    return out


def bootstrap_ci(df: DataFrame, keys: list[str], x: str, order: list[str], replicates: int = 2000, seed: int = 0, block: int = 1) -> DataFrame:
    """(keys, n, mean, low, high): 2.5 and 97.5 percentiles of the mean of x over resampled rows.

    Rows are taken a Poisson number of times in each replicate, which needs no
    row to know of the others: every replicate is a pair of sums. With block > 1
    runs of `block` neighbouring rows are taken, in the given order, which is
    that of time; x is then averaged over the runs. Numbers depend on a row's
    place, the replicate and the seed. Keys with no more rows than a block have
    null limits.
    """
    d = carry.positions(df.filter(F.col(x).isNotNull()).withColumn("__t", F.col(order[0]).cast("double")), keys, "__t", order, "__i")
    w = Window.partitionBy(*keys).orderBy("__i").rowsBetween(0, block - 1)
    n = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"))
    units = d.withColumns({"__s": F.sum(x).over(w), "__m": F.count(x).over(w)}).filter(F.col("__m") == block) if block > 1 else d.withColumns({"__s": F.col(x).cast("double"), "__m": F.lit(1)})
    units = units.join(n, keys) if keys else units.crossJoin(F.broadcast(n))  # one row
    rate = F.ceil(F.col("n") / block) / (F.col("n") - block + 1)
    drawn = units.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("__k", poisson(uniform(F.lit(seed), F.col("__i"), F.col("__r")), rate))
    means = drawn.groupBy(*keys, "__r").agg((F.sum(F.col("__k") * F.col("__s")) / F.nullif(F.sum("__k") * block, F.lit(0))).alias("__mean"))
    limits = means.groupBy(*keys).agg(F.percentile("__mean", F.lit(0.025)).alias("low"), F.percentile("__mean", F.lit(0.975)).alias("high"))  # of the replicates
    out = n.join(limits, keys, "left") if keys else n.crossJoin(F.broadcast(limits))  # one row
    enough = F.col("n") > (block if block > 1 else 0)
    return out.select(*keys, "n", "mean", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))
