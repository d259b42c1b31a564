"""Alignment in time: segments, grids, as-of lookup, trailing windows, labels.

All functions key on columns given by name and cut time into buckets, so a
symbol with a third of all rows is many groups. A bucket takes the state that it
needs from earlier ones along: the last row for an as-of lookup, the rows within
reach for a trailing window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, ship
from . import carry


def segments(df: DataFrame, keys: list[str], t: str, tie: str, max_gap: int) -> DataFrame:
    """df with segment (from 0): a new one begins where t moves on by more than max_gap."""
    d = carry.previous(df, keys, t, [tie], [t], name="__prev")
    new = F.when(F.col(t) - F.col(f"__prev.{t}") > max_gap, 1).otherwise(0)
    return carry.running_sum(d.withColumn("__new", new), keys, t, [tie], F.col("__new"), "segment").withColumn("segment", F.col("segment").cast("int")).drop("__new", "__prev")


def grid(df: DataFrame, keys: list[str], t: str, step: int, window: int, horizon: int, align: int | None = None) -> DataFrame:
    """Grid instants t of each key group: from first + window, before last - horizon, by step."""
    ends = df.groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    start = F.col("t0") + window
    if align:
        start = F.ceil(start / align).cast("long") * align
    ends = ends.withColumn("__a", start).withColumn("__b", F.col("t1") - horizon - 1).filter("__a <= __b")
    return ends.select(*keys, F.explode(F.sequence("__a", "__b", F.lit(step).cast("long"))).alias(t))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], t: str, tie: str, columns: list[str], bucket: int = 86_400_000) -> DataFrame:
    """left with the columns of the last row of right at or before t (null if none), and t_match.

    One union and one window per (keys, bucket of time); the last row of earlier
    buckets is carried in. Ties in t go to the largest tie.
    """
    b = F.floor(F.col(t) / bucket).cast("long")
    row = F.struct(F.col(t).alias("t_match"), *[F.col(c) for c in columns])
    r = right.select(*keys, t, F.col(tie).alias("__tie"), row.alias("__row")).withColumn("__b", b)
    l = left.withColumn("__b", b)  # noqa: E741
    ends = r.groupBy(*keys, "__b").agg(F.max_by("__row", F.struct(t, "__tie")).alias("__row"))
    spots = ends.unionByName(l.select(*keys, "__b").distinct(), allowMissingColumns=True).groupBy(*keys, "__b").agg(F.max("__row").alias("__row"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select(*keys, "__b", F.last("__row", ignorenulls=True).over(before).alias("__carry"))
    both = r.withColumn("__g", F.lit(0)).unionByName(l.withColumn("__g", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__b").orderBy(t, "__g", F.col("__tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__hit", F.last("__row", ignorenulls=True).over(w)).filter("__g = 1")
    out = carry.matched(out, carried, [*keys, "__b"], "left").withColumn("__hit", F.coalesce("__hit", "__carry"))
    return out.select(*left.columns, F.col("__hit.t_match").alias("t_match"), *[F.col(f"__hit.{c}").alias(c) for c in columns])


def condensed(right: DataFrame, left: DataFrame, keys: list[str], t: str, windows: list[int], sums: dict[str, Column], bucket: int = 86_400_000) -> DataFrame:
    """Sums (as __<name>) of right's rows between neighbouring ends of left's windows, each under the last of its rows' times.

    A window (t - window, t] has all rows of such a piece or none, so sums over
    pieces are those over rows, and there are no more pieces than ends and buckets:
    what follows grows with left, however many rows a window holds. Rows are
    sorted once and go to the bucket that they lie in only.
    """
    b = F.floor(F.col(t) / bucket).cast("long").alias("__b")
    ends = left.select(*keys, F.explode(F.array(*[F.col(t) - w for w in (0, *windows)])).alias(t)).distinct().select(*keys, t, b, F.lit(1).alias("__g"))
    r = right.select(*keys, t, b, F.lit(0).alias("__g"), *[v.alias(f"__{k}") for k, v in sums.items()])
    run = Window.partitionBy(*keys, "__b").orderBy(t, "__g").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(ends, allowMissingColumns=True).withColumn("__piece", F.sum("__g").over(run)).filter("__g = 0")
    return both.groupBy(*keys, "__b", "__piece").agg(F.max(t).alias(t), *[F.sum(f"__{k}").alias(f"__{k}") for k in sums]).drop("__b", "__piece")


def multi_window_sums(left: DataFrame, right: DataFrame, keys: list[str], t: str, windows: list[int], sums: dict[str, Column], bucket: int = 86_400_000) -> DataFrame:
    """left with <name>_w<window> for each sum and trailing window (t - window, t]; 0 where there is no row.

    All windows share one sort of right's rows, which are condensed first; pieces
    go to the buckets that the widest window reaches, and each window is a frame
    over the same order.
    """
    if min(windows) <= 0:
        raise ValueError("a window has a positive width")
    first, last = F.floor(F.col(t) / bucket).cast("long"), F.floor((F.col(t) + max(windows) - 1) / bucket).cast("long")
    r = condensed(right, left, keys, t, windows, sums, bucket).withColumn("__b", F.explode(F.sequence(first, last)))
    both = r.withColumn("__g", F.lit(0)).unionByName(left.withColumn("__b", first).withColumn("__g", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__b").orderBy(t)
    out = both.withColumns({f"{k}_w{n}": F.coalesce(F.sum(f"__{k}").over(w.rangeBetween(-(n - 1), 0)), F.lit(0)) for k in sums for n in windows})
    return out.filter("__g = 1").select(*left.columns, *[f"{k}_w{n}" for k in sums for n in windows])


def window_sums(left: DataFrame, right: DataFrame, keys: list[str], t: str, window: int, sums: dict[str, Column], bucket: int = 86_400_000) -> DataFrame:
    """left with the sums of right's rows in (t - window, t]; 0 where there is none. See multi_window_sums."""
    return multi_window_sums(left, right, keys, t, [window], sums, bucket).withColumnsRenamed({f"{k}_w{window}": k for k in sums})


#: Rows of a key that a task of the gate holds at once.
GATE_BLOCK = 8_192


def gate_free(rows: DataFrame, keys: list[str], order: list[str], block: int = GATE_BLOCK) -> DataFrame:
    """rows with held (boolean): whether an earlier row of the key is held at this one's __entry.

    rows have __entry (a time, by which and by `order` they go), __exit and __ok
    (may be held); a row that is ok and not held itself holds to __exit. Rows
    without __entry are not held and hold nothing.

    The rows that are not held form one chain from a key's first: each points to
    the next, which after one that holds is the first at or after its exit. Blocks
    of rows find for each of their rows where its chain leaves them; of these
    places only, pointers are doubled until every chain's blocks are known, in as
    many rounds as their number has binary digits. No task sees a key.
    """
    import pyarrow as pa

    ship(rows.sparkSession)
    columns = rows.columns
    rows = cut(rows)  # read several times below
    d = carry.positions(rows.filter(F.col("__entry").isNotNull()), keys, "__entry", order, "__i")
    probe = d.withColumn("__t", F.col("__exit") - 1)
    ahead = asof_backward(probe, d.withColumn("__t", F.col("__entry")).withColumnRenamed("__i", "__at"), keys, "__t", "__at", ["__at"])
    after = F.col("__i") + 1
    to = F.when(F.col("__ok"), F.greatest(after, F.coalesce(F.col("__at") + 1, after))).otherwise(after)
    d = cut(ahead.select(*columns, "__i", to.alias("__to"), F.expr(f"__i div {block}").alias("__b")))

    def leave(table):
        """Where the chain of each row leaves the block."""
        i, to = table.column("__i").to_pylist(), table.column("__to").to_pylist()
        place, out = {x: n for n, x in enumerate(i)}, list(to)
        for n in sorted(range(len(i)), key=i.__getitem__, reverse=True):
            if to[n] in place:
                out[n] = out[place[to[n]]]
        return table.select([*keys, "__i"]).append_column("__to", pa.array(out, pa.int64()))

    def follow(table):
        """held of each row, given the block's first row on the chain."""
        i, to = table.column("__i").to_pylist(), table.column("__to").to_pylist()
        at = min((x for x, first in zip(i, table.column("__first").to_pylist()) if first), default=None)
        place, free = {x: n for n, x in enumerate(i)}, [False] * len(i)
        while at in place:
            free[place[at]] = True
            at = to[place[at]]
        return table.select(columns).append_column("held", pa.array([not x for x in free], pa.bool_()))

    kinds = dict(rows.dtypes)
    ddl = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names)
    by = [*keys, "__i"]
    first = d.filter("__i = 0").select(*by)
    blocks = d.agg(F.max("__b")).first()[0]
    if blocks:
        outs = cut(d.groupBy(*keys, "__b").applyInArrow(leave, f"{ddl(keys)}, __i long, __to long"))
        doors = outs.select(*keys, F.col("__to").alias("__i")).unionByName(first).distinct()
        jumps = cut(carry.matched(outs, doors, by))
        for _ in range(blocks.bit_length()):
            hops = carry.matched(jumps, first, by).select(*keys, F.col("__to").alias("__i"))
            first = cut(first.unionByName(hops))
            far = jumps.withColumnRenamed("__to", "__far").withColumnRenamed("__i", "__to")
            jumps = cut(carry.matched(jumps, far, [*keys, "__to"]).select(*by, F.col("__far").alias("__to")))
    marked = carry.matched(d, first.distinct().withColumn("__first", F.lit(True)), by, "left")
    out = marked.groupBy(*keys, "__b").applyInArrow(follow, f"{ddl(columns)}, held boolean")
    return out.unionByName(rows.filter(F.col("__entry").isNull()).withColumn("held", F.lit(False)))


def greedy_nonoverlap(df: DataFrame, keys: list[str], t: str, hold: int, block: int = GATE_BLOCK) -> DataFrame:
    """Rows kept by the greedy gate: a row is kept if it is hold or more after the last kept. See gate_free."""
    rows = df.filter(F.col(t).isNotNull()).select(*keys, t, F.col(t).alias("__entry"), (F.col(t) + hold).alias("__exit"), F.lit(True).alias("__ok"))
    return gate_free(rows, keys, [t], block).filter("NOT held").select(*keys, t)


def position_ahead(df: DataFrame, keys: list[str], t: str, horizon: int, value: str) -> Column:
    """Value at exactly t + horizon in the same group, else null."""
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(horizon, horizon)
    return F.first(value).over(w)
