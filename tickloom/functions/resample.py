"""Bootstrap by resampling exactly as many rows as there are, dealt to ranges of rows without any of them being written out.

Rows of a key are numbered in order. A replicate's n draws are split between the
two halves of the numbers by a binomial number, each half's between its halves,
and so on, which is a multinomial split; every node of this tree has a seed of
its own, so the task that holds a bucket of rows finds its number of draws by
walking down to it and draws that many of its rows. Only sums leave a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import carry
from ..sources.shared import cut, ship

#: Rows of a bucket, whose draws one task makes.
BUCKET = 32_768


def dealt(draws, units: int, bucket: int, at: int, seed: tuple):
    """Draws (an array, one per replicate) out of `units` that fall into bucket number `at` of `bucket` units each."""
    import numpy as np

    lo, hi = 0, -(-units // bucket)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        share = (mid - lo) * bucket / (min(hi * bucket, units) - lo * bucket)
        left = np.random.default_rng([*seed, lo, hi]).binomial(draws, share)
        lo, hi, draws = (lo, mid, left) if at < mid else (mid, hi, draws - left)
    return draws


def bucket_sums(values, first: int, n: int, block: int, replicates: int, bucket: int, seed: int):
    """Per replicate the sum of what is drawn from the bucket whose rows begin at `first`.

    values: the bucket's rows and, with block > 1, the block - 1 after them. With
    blocks, ceil(n / block) starts are drawn, and the last one is cut so that n
    rows are taken.
    """
    import numpy as np

    units = n - block + 1
    m, at = min(bucket, units - first), first // bucket
    pieces = -(-n // block)
    out = np.zeros(replicates)
    for part, count, length in (0, pieces - 1 if block > 1 else pieces, block), (1, int(block > 1), n - block * (pieces - 1)):
        if not count or m <= 0:
            continue
        sums = np.concatenate([[0.0], np.cumsum(values)])
        own = sums[length : length + m] - sums[:m]
        draws = dealt(np.full(replicates, count), units, bucket, at, (seed, part))
        rng = np.random.default_rng([seed, part, at, 1 << 40])
        for r, k in enumerate(draws.tolist()):
            if k:
                out[r] += own[rng.integers(0, m, k)].sum()
    return out


def resampled_ci(df: DataFrame, keys: list[str], x: str, order: list[str], replicates: int = 2000, seed: int = 0, block: int = 1, bucket: int = BUCKET) -> DataFrame:
    """(keys, n, mean, low, high): 2.5 and 97.5 percentiles of the means of n rows drawn with replacement.

    With block > 1, runs of `block` neighbouring rows (in the given order, that of
    time) are drawn, which may overlap, and the last one is cut to n rows; a key
    with no more rows than a block has null limits. Null values are left out; an
    empty table gives an empty one.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    d = df.filter(F.col(x).isNotNull()).withColumns({"__x": F.col(x).cast("double"), "__t": F.col(order[0]).cast("double")})
    d = cut(carry.positions(d.select(*keys, "__x", "__t", *[c for c in order if c not in keys]), keys, "__t", order, "__i").select(*keys, "__x", "__i"))
    n = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__x").alias("mean"))
    # a bucket also gets the rows that its last blocks reach into
    into = F.when((F.col("__i") % bucket < block - 1) & (F.col("__i") >= bucket), F.array(F.lit(0), F.lit(-1))).otherwise(F.array(F.lit(0)))
    rows = d.withColumn("__to", F.explode(into)).withColumn("__b", F.expr(f"__i div {bucket}") + F.col("__to"))
    rows = carry.matched(rows, n, keys) if keys else rows.crossJoin(F.broadcast(n))  # one row
    kinds = dict(df.dtypes)
    head = "".join(f"`{c}` {kinds[c]}, " for c in keys)

    def draw(table):
        t = table.sort_by("__i")
        size, b = t.column("n")[0].as_py(), t.column("__b")[0].as_py()
        some = range(0 if block > 1 and size <= block else replicates)
        sums = bucket_sums(t.column("__x").to_numpy(), b * bucket, size, block, replicates, bucket, seed) if some else []
        own = [pa.array([t.column(c)[0].as_py()] * len(some), type=t.schema.field(c).type) for c in keys]
        return pa.Table.from_arrays([*own, pa.array(some, pa.int32()), pa.array(sums, pa.float64())], names=[*keys, "__r", "__s"])

    if block - 1 > bucket:
        raise ValueError("a block reaches into the next bucket only")
    drawn = rows.groupBy(*keys, "__b").applyInArrow(draw, f"{head}__r int, __s double").groupBy(*keys, "__r").agg(F.sum("__s").alias("__s"))
    means = carry.matched(drawn, n, keys) if keys else drawn.crossJoin(F.broadcast(n))  # one row
    limits = means.groupBy(*keys).agg(*[F.percentile(F.col("__s") / F.col("n"), F.lit(p)).alias(c) for c, p in (("low", 0.025), ("high", 0.975))])  # of the replicates
    return (carry.matched(n, limits, keys, "left") if keys else n.join(limits, how="left")).filter("n > 0").select(*keys, "n", "mean", "low", "high")
