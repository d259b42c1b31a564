"""Order-by-order taker backtest: fills, a sequential gate, metrics."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .timealign import GATE_BLOCK, asof_backward, gate_free


def walk_book(px: str, qty: str, size: float) -> Column:
    """struct(vwap, filled) of taking `size` from levels in order; unusable levels are passed over.

    vwap is null if nothing fills, the struct if there is no ladder. A batch of
    rows goes down its levels together.
    """

    @F.arrow_udf("struct<vwap: double, filled: double>")
    def walk(px: pa.Array, qty: pa.Array) -> pa.Array:
        import numpy as np

        def levels(column):
            """The n-th values of all rows, for each n; NaN where there is none."""
            own = pc.fill_null(pc.list_flatten(column), float("nan")).to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.full((int(counts.max(initial=0)), len(counts)), np.nan)
            row = np.repeat(np.arange(len(counts)), counts)
            out[np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts), row] = own
            return out

        left, cost = np.full(len(px), float(size)), np.zeros(len(px))
        for p, q in zip(levels(px), levels(qty)):
            take = np.where((p > 0) & (q > 0), np.minimum(left, q), 0.0)
            left, cost = left - take, cost + np.where(take > 0, take * p, 0.0)
        filled = float(size) - left
        vwap = pa.array(np.divide(cost, filled, out=np.zeros(len(px)), where=filled > 0), mask=filled <= 0)
        missing = pc.or_(px.is_null(), qty.is_null())
        return pa.StructArray.from_arrays([vwap, pa.array(filled)], names=["vwap", "filled"], mask=missing)

    return walk(F.col(px).cast("array<double>"), F.col(qty).cast("array<double>"))


def feasibility(signals: DataFrame, book: DataFrame, keys: list[str], size: float, delay: int, horizon: int, max_stale: int, enter: float) -> DataFrame:
    """Every signal of at least `enter` with side, entry and exit fills and reason (null: feasible)."""
    s = signals.filter(F.abs("pred") >= enter).withColumn("side", F.when(F.col("pred") > 0, 1).otherwise(-1))
    # what the size costs is found once per book row, so lookups carry two fills and no ladders
    fills = cut(book.select(*keys, "t_ms", "u", walk_book("ask_px", "ask_qty", size).alias("__buy"), walk_book("bid_px", "bid_qty", size).alias("__sell")))
    cols = ["__buy", "__sell"]
    hit = s.withColumnRenamed("t_ms", "sig_t").withColumn("t_ms", F.col("sig_t") + delay).withColumn("exit_t", F.col("sig_t") + delay + horizon)
    a = asof_backward(hit, fills, keys, "t_ms", "u", cols)
    stale_in = F.col("t_ms") - F.col("t_match") > max_stale
    a = a.withColumns({"no_in": F.col("t_match").isNull(), "stale_in": stale_in, "in": F.when(F.col("side") > 0, F.col("__buy")).otherwise(F.col("__sell"))}).drop("t_match", *cols)
    a = a.withColumn("entry_t", F.col("t_ms")).withColumn("t_ms", F.col("exit_t"))
    b = asof_backward(a, fills, keys, "t_ms", "u", cols)
    b = b.withColumns({"stale_out": F.col("t_ms") - F.col("t_match") > max_stale, "out": F.when(F.col("side") > 0, F.col("__sell")).otherwise(F.col("__buy"))})
    thin = (F.coalesce(F.col("in.filled"), F.lit(0.0)) < size * (1 - 1e-12)) | (F.coalesce(F.col("out.filled"), F.lit(0.0)) < size * (1 - 1e-12))
    reason = F.when(F.col("no_in") | F.col("t_match").isNull(), "no_data").when(F.col("stale_in") | F.col("stale_out"), "stale_book").when(thin, "thin_book")
    return b.select(*keys, "sig_t", "pred", "side", "entry_t", "exit_t", F.col("in.vwap").alias("in_px"), F.col("out.vwap").alias("out_px"), reason.alias("reason"))


def gate(candidates: DataFrame, keys: list[str], block: int = GATE_BLOCK) -> DataFrame:
    """candidates with outcome: trade, in_position, or the reason of infeasibility.

    In order of the signals' time in a key: a signal while a position is held (before
    the last trade's exit_t) is in_position; else it has its own reason, which
    doesn't block; else it is a trade, which holds to exit_t. See gate_free for how
    this is found without going through a key in one task.
    """
    rows = candidates.withColumns({"__entry": F.col("sig_t"), "__exit": F.col("exit_t"), "__ok": F.col("reason").isNull(), "__why": F.coalesce("reason", F.lit(""))})
    gated = cut(gate_free(rows, keys, ["sig_t", "entry_t", "exit_t", "__why", "pred", "side", "in_px", "out_px"], block))  # metrics read it several times
    outcome = F.when(F.col("held"), "in_position").otherwise(F.coalesce("reason", F.lit("trade")))
    return gated.select(*keys, "sig_t", "entry_t", "exit_t", "pred", "side", "in_px", "out_px", outcome.alias("outcome"))


def trades_of(gated: DataFrame, taker_bps: float = 5.0) -> DataFrame:
    """Trades with gross_bps, fee_bps (both sides) and net_bps."""
    gross = F.col("side") * (F.col("out_px") - F.col("in_px")) / F.col("in_px") * 1e4
    return gated.filter("outcome = 'trade'").withColumns({"gross_bps": gross, "fee_bps": F.lit(2 * taker_bps)}).withColumn("net_bps", F.col("gross_bps") - F.col("fee_bps"))


def metrics(trades: DataFrame, keys: list[str], bucket: int = 86_400_000) -> DataFrame:
    """Counts, means, hit rates, drawdown, holding time and Sharpe per key.

    The span runs from the first trade's signal to the last one's exit, 1 ms at
    least. A single trade has standard deviation and Sharpe ratio 0. The running
    sum behind the drawdown starts at 0 and goes by buckets of time, whose totals
    and peaks are a small table.
    """
    d = trades.withColumn("__b", F.floor(F.col("sig_t") / bucket).cast("long"))
    run = Window.partitionBy(*keys, "__b").orderBy("sig_t", "exit_t").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__cum", F.sum("net_bps").over(run))
    d = d.withColumns({"__top": F.max("__cum").over(run)})
    ahead = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(*keys, "__b").agg(F.sum("net_bps").alias("__total"), F.max("__cum").alias("__peak"))
    per = per.withColumn("__base", F.coalesce(F.sum("__total").over(ahead), F.lit(0.0)))
    per = per.withColumn("__before", F.greatest(F.coalesce(F.max(F.col("__base") + F.col("__peak")).over(ahead), F.lit(0.0)), F.lit(0.0)))
    d = d.join(per.select(*keys, "__b", "__base", "__before"), [*keys, "__b"])
    d = d.withColumn("__dd", F.greatest(F.col("__base") + F.col("__top"), F.col("__before")) - F.col("__base") - F.col("__cum"))
    hours = F.greatest(F.max("exit_t") - F.min("sig_t"), F.lit(1)) / 3_600_000
    out = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("side") > 0).alias("n_long"), F.count_if(F.col("side") < 0).alias("n_short"),
        F.avg("gross_bps").alias("gross_mean"), F.avg("net_bps").alias("net_mean"), F.sum("net_bps").alias("net_total"), F.coalesce(F.stddev_samp("net_bps"), F.lit(0.0)).alias("net_std"),
        F.avg((F.col("gross_bps") > 0).cast("double")).alias("hit_gross"), F.avg((F.col("net_bps") > 0).cast("double")).alias("hit_net"),
        F.max("__dd").alias("max_drawdown"), F.avg((F.col("exit_t") - F.col("entry_t")) / 1000).alias("hold_s"), hours.alias("span_h"),
    )
    per_day = F.col("n") * 24 / F.col("span_h")
    sharpe = F.when(F.col("net_std") > 0, F.col("net_mean") / F.col("net_std")).otherwise(0.0)
    return out.withColumns({"trades_per_day": per_day, "sharpe": sharpe}).withColumn("sharpe_annual", F.col("sharpe") * F.sqrt(F.col("trades_per_day") * 365))


def costs(trades: DataFrame, keys: list[str], taker_bps: float = 5.0, maker_bps: float = 2.0) -> DataFrame:
    """Per key: mean gross return, and net of a round trip as taker and as maker.

    The maker's figure is an upper bound: queues and orders that don't fill aren't simulated.
    """
    g = F.avg("gross_bps")
    return trades.groupBy(*keys).agg(F.count("*").alias("n"), g.alias("gross_mean"), (g - 2 * taker_bps).alias("net_taker"), (g - 2 * maker_bps).alias("net_maker"), F.avg((F.col("gross_bps") > 2 * maker_bps).cast("double")).alias("hit_maker"))
