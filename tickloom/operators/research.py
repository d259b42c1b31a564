"""Research datasets inside gap-free segments, and nested walk-forward selection.

Everything is per key (a symbol, say): rows of a dataset are numbered by time,
training, validation and test sets are ranges of these numbers, and the Gram
sums of all of them are sums over the blocks between the ranges' ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import resample, stats
from ..sources.shared import cut, ship, small
from . import backtest, carry, features, ridge, timealign

STATE = ["mid", "spread_bps", "imb1", "imb20", "micro_bps", "depth20_bid", "depth20_ask"]
FLOW = ["ofi", "rv_bps", "buy_vol", "sell_vol", "n_trades", "flow_imb"]
ALPHAS, SHARES = (1.0, 10.0, 100.0), (0.99, 0.999, 0.9999)


def micro_dataset(book: DataFrame, trades: DataFrame, keys: list[str], step: int, horizon: int, windows: list[int], max_gap: int, flat: float = 0.5, align: int | None = None) -> DataFrame:
    """Grid rows with book state, flow over trailing windows, and the return over the horizon.

    book: keys, t_ms, u and the ladders; trades: keys, t_ms, q, side. Returns
    keys, t_ms, segment, STATE, <FLOW>_w<window>, y_bps and y_cls. A segment of
    the book ends where its time moves on by more than max_gap; the grid runs
    from the widest window after its start to a horizon before its end, so no
    window and no label crosses a gap, and increments are 0 at its start. With
    align, grid times are multiples of it.
    """
    if any((w - min(windows)) % step for w in windows):
        raise ValueError("windows differ by multiples of the step")
    b = features.segmented(book, keys, "t_ms", "u", max_gap, STATE)
    ends = b.groupBy(*keys, "segment").agg(F.min("t_ms").alias("__t0"), F.max("t_ms").alias("__t1"))
    start = F.col("__t0") + min(windows)
    if align:
        start = (F.ceil(start / align) * align).cast("long")
    ends = ends.withColumns({"__a": start, "__z": F.col("__t1") - horizon - 1}).filter("__a <= __z")
    grid = ends.select(*keys, "segment", "__t0", F.explode(F.sequence("__a", "__z", F.lit(step).cast("long"))).alias("t_ms"))
    grid = cut(grid.filter(F.col("t_ms") >= F.col("__t0") + max(windows)).drop("__t0"))

    # One as-of lookup for now and for the horizon.
    both = grid.withColumn("__at", F.col("t_ms")).withColumn("__ahead", F.explode(F.array(F.lit(0), F.lit(horizon))))
    both = both.withColumn("t_ms", (F.col("__at") + F.col("__ahead")).cast("long"))
    hit = timealign.asof_backward(both, b, keys, "t_ms", "u", STATE)
    now, later = (lambda c: F.max(F.when(F.col("__ahead") == 0, F.col(c)))), (lambda c: F.max(F.when(F.col("__ahead") > 0, F.col(c))))
    state = hit.groupBy(*keys, "segment", F.col("__at").alias("t_ms")).agg(*[now(c).alias(c) for c in STATE], later("mid").alias("__mid"))

    buy = F.col("side") == "buy"
    zero = F.lit(0.0)
    flow = b.select(*keys, "t_ms", "ofi", "r2", zero.alias("buy_vol"), zero.alias("sell_vol"), zero.alias("n_trades")).unionByName(
        trades.select(*keys, "t_ms", zero.alias("ofi"), zero.alias("r2"), F.when(buy, F.col("q")).otherwise(0.0).alias("buy_vol"), F.when(buy, 0.0).otherwise(F.col("q")).alias("sell_vol"), F.lit(1.0).alias("n_trades"))
    )
    names = ["ofi", "r2", "buy_vol", "sell_vol", "n_trades"]
    sums = timealign.multi_window_sums(grid.select(*keys, "t_ms"), flow, keys, "t_ms", windows, {c: F.col(c) for c in names})
    out = state.join(sums, [*keys, "t_ms"])
    y = (F.col("__mid") / F.col("mid") - 1) * 1e4
    made = {"y_bps": y, "y_cls": features.three_way(y, flat)}
    for w in windows:
        total = F.col(f"buy_vol_w{w}") + F.col(f"sell_vol_w{w}")
        made |= {f"rv_bps_w{w}": F.sqrt(f"r2_w{w}"), f"flow_imb_w{w}": F.when(total > 0, (F.col(f"buy_vol_w{w}") - F.col(f"sell_vol_w{w}")) / total).otherwise(0.0)}
    # saved, since numbering, folds and labels each read it again
    return cut(out.withColumns(made).select(*keys, "t_ms", "segment", *STATE, *feature_columns(windows)[len(STATE) - 1 :], "y_bps", "y_cls"))


def feature_columns(windows: list[int]) -> list[str]:
    """Names of a micro dataset's features: the state but for mid, and the flow of each window."""
    return STATE[1:] + [f"{c}_w{w}" for w in windows for c in FLOW]


def kline_rows(bars: DataFrame, keys: list[str], width: int, horizon: int, warm: int = 60, stride: int = 1, columns: list[str] | None = None) -> DataFrame:
    """Features of bars by position, with segment and with y_bps over `horizon` bars, of rows without a missing or infinite value.

    A segment ends where more than two bars in a row are missing. Of each the
    first `warm` bars and the last `horizon` go, and of the others every
    stride-th stays, counted from the segment's first that is kept; then rows
    whose columns (all features unless given) or label aren't finite go.
    """
    b = timealign.segments(bars, keys, "open_ms", "n_trades", 3 * width)
    k = features.kline_features(b, tuple(keys))
    run = Window.partitionBy(*keys, "segment").orderBy("open_ms")
    k = k.withColumns({"__i": F.row_number().over(run) - 1, "y_bps": (F.lead("close", horizon).over(run) / F.col("close") - 1) * 1e4})
    kept = k.filter((F.col("__i") >= warm) & F.col("y_bps").isNotNull() & ((F.col("__i") - warm) % stride == 0)).drop("__i")
    return kept.filter(features.finite([*(features.KLINE if columns is None else columns), "close", "y_bps"]))


def join_bars(grid: DataFrame, bars: DataFrame, keys: list[str], width: int, columns: list[str]) -> DataFrame:
    """grid (keys, t_ms) with columns of the bar that closed exactly at t_ms; null if there is none."""
    done = bars.select(*keys, (F.col("open_ms") + width).alias("t_ms"), *columns)
    return grid.join(done, [*keys, "t_ms"], "left")


def combined_dataset(book: DataFrame, trades: DataFrame, bars: DataFrame, keys: list[str], width: int, horizon: int, windows: list[int], max_gap: int, columns: list[str]) -> DataFrame:
    """Micro features on whole bars joined to the features of the bar that just closed; rows with a missing value go."""
    micro = micro_dataset(book, trades, keys, width, horizon, windows, max_gap, align=width)
    out = join_bars(micro, features.kline_features(bars, tuple(keys)), keys, width, columns)
    return out.filter(features.finite([*feature_columns(windows), *columns, "y_bps"]))


def label(data: DataFrame, keys: list[str], horizon: int, value: str = "mid", t: str = "t_ms") -> DataFrame:
    """data with y: the return in bps to the row of the same segment at exactly t + horizon, null if there is none."""
    ahead = data.select(*keys, "segment", (F.col(t) - horizon).alias(t), F.col(value).alias("__later"))
    return data.join(ahead, [*keys, "segment", t], "left").withColumn("y", (F.col("__later") / F.col(value) - 1) * 1e4).drop("__later")


def folds(data: DataFrame, keys: list[str], n_folds: int, horizon: int, purge: int | None = None, expanding: bool = True, min_train: int = 500, t: str = "t_ms", idx: str = "idx") -> DataFrame:
    """(keys, k, tr_beg, tr_end, te_beg, te_end) over rows numbered by idx: purged walk-forward folds.

    Test sets lie between the edges int(n i / (n_folds + 1)); a training row's
    label ends `purge` (the horizon unless given) before the test set's first row.
    Folds with fewer training rows than min_train go, and the rest are numbered from 0.
    """
    purge = horizon if purge is None else purge
    n = data.groupBy(*keys).agg((F.max(idx) + 1).alias("n")).withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    edge = lambda i: F.expr(f"n * (__k + {i}) div {n_folds + 1}")
    b = n.select(*keys, "__k", (F.lit(0).cast("long") if expanding else edge(-1)).alias("tr_beg"), edge(0).alias("te_beg"), edge(1).alias("te_end"))
    b = b.join(data.select(*keys, F.col(idx).alias("te_beg"), F.col(t).alias("__t")), [*keys, "te_beg"])
    b = _rows_until(b.withColumn("__until", F.col("__t") - purge - horizon), data, keys, t, idx, "tr_end").withColumn("tr_end", F.greatest(F.least("tr_end", "te_beg"), "tr_beg"))
    b = b.filter(F.col("tr_end") - F.col("tr_beg") >= min_train)
    return b.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("__k")) - 1).alias("k"), "tr_beg", "tr_end", "te_beg", "te_end")  # a row per fold


def _rows_until(bounds: DataFrame, data: DataFrame, keys: list[str], t: str, idx: str, name: str) -> DataFrame:
    """bounds with name: the number of rows of data with t at or before __until, which goes."""
    left = bounds.withColumnRenamed("__until", t)
    hit = timealign.asof_backward(left, data, keys, t, idx, [idx])
    return hit.withColumn(name, F.coalesce(F.col(idx) + 1, F.lit(0)).cast("long")).drop(t, idx, "t_match")


def _inner(bounds: DataFrame, data: DataFrame, keys: list[str], horizon: int, t: str, idx: str, least: tuple[int, int]) -> DataFrame:
    """bounds with in_end and val_beg: of a training set the last fifth validates, and what is fitted ends a horizon before."""
    b = bounds.withColumn("val_beg", F.col("tr_beg") + F.floor((F.col("tr_end") - F.col("tr_beg")) * 0.8).cast("long"))
    b = b.join(data.select(*keys, F.col(idx).alias("val_beg"), (F.col(t) - horizon).alias("__until")), [*keys, "val_beg"])
    b = _rows_until(b, data, keys, t, idx, "in_end").withColumn("in_end", F.greatest(F.least("in_end", "val_beg"), "tr_beg"))
    return b.filter((F.col("in_end") - F.col("tr_beg") >= least[0]) & (F.col("tr_end") - F.col("val_beg") >= least[1]))


def models(data: DataFrame, bounds: DataFrame, sets: dict[str, tuple[str, str]], keys: list[str], columns: list[str], y: str, alphas, idx: str = "idx") -> DataFrame:
    """(keys, k, stage, alpha, intercept, weights, means, stds): a ridge of every fold, set and alpha.

    sets: stage to the names of its range's ends in bounds. One pass gives the
    Gram sums of the blocks between all ends; each key's ranges are sums of blocks.
    """
    import pandas as pd

    ship(data.sparkSession)
    ends = sorted({e for pair in sets.values() for e in pair})
    edges = bounds.select(*keys, F.explode(F.array(*ends)).alias("__e")).groupBy(*keys).agg(F.sort_array(F.collect_set("__e")).alias("__edges"))  # a few per fold
    names_of = [*columns, y]
    means = data.groupBy(*keys).agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(names_of)])  # sums are shifted by their own key's means
    edges = cut(edges.join(means, keys))
    rows = data.join(small(edges), keys).withColumn("__block", F.size(F.filter("__edges", lambda e: e <= F.col(idx))))
    sums, _ = ridge.gram(rows, columns, y, [*keys, "__block"], {c: F.col(f"__m{i}") for i, c in enumerate(names_of)})
    spec = bounds.groupBy(*keys).agg(F.collect_list(F.struct("k", *ends)).alias("__folds"))
    work = sums.join(edges, keys).join(spec, keys)
    names = sorted(sets)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        pivot = {c: first[f"__m{i}"] for i, c in enumerate(names_of)}
        own, edge = list(first["__edges"]), {b: row for b, row in zip(pdf["__block"], pdf.to_dict("records"))}
        out = []
        for fold in first["__folds"]:
            for stage in names:
                lo, hi = (fold[e] for e in sets[stage])
                parts = [edge[b] for b in edge if b and lo <= own[b - 1] < hi]
                if not parts:
                    continue
                total = {c: sum(p[c] for p in parts) for c in parts[0] if c[0] in "nstg" and c not in (*keys,)}
                total |= {c: (min if c.startswith("lo") else max)(p[c] for p in parts) for c in parts[0] if c[:2] in ("lo", "hi")}
                for alpha in alphas:
                    m = ridge.solve(total, pivot, columns, y, alpha)
                    out.append((*(first[c] for c in keys), fold["k"], stage, alpha, m.intercept, m.weights.tolist(), m.mean.tolist(), m.std.tolist()))
        return pd.DataFrame(out, columns=[*keys, "k", "stage", "alpha", "intercept", "weights", "means", "stds"], dtype=object)

    kinds = dict(bounds.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", k int, stage string, alpha double, intercept double, weights array<double>, means array<double>, stds array<double>"
    return work.groupBy(*keys).applyInPandas(fit, schema)


def predicted(rows: DataFrame, columns: list[str]) -> Column:
    """The prediction of a row that has been joined to its model: z-scores clipped, as ridge.Ridge.predict."""
    z = lambda i: F.greatest(F.lit(-ridge.CLIP), F.least(F.lit(ridge.CLIP), (F.col(columns[i]) - F.col("means")[i]) / F.col("stds")[i]))
    return reduce(lambda a, i: a + F.col("weights")[i] * z(i), range(len(columns)), F.col("intercept"))


def predictions(rows: DataFrame, bounds: DataFrame, keys: list[str], columns: list[str], lo: str, hi: str, use: DataFrame) -> DataFrame:
    """rows (numbered by idx) of each fold between its ends lo and hi, once for every model of `use`, with pred."""
    ranges = use.join(bounds.select(*keys, "k", F.col(lo).alias("__lo"), F.col(hi).alias("__hi")), [*keys, "k"])
    # a row per key, with its folds and models as an array: a data row meets one row and keeps the ranges it lies in
    own = [c for c in ranges.columns if c not in keys]
    per = cut(ranges.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias("__ranges")))
    within = F.filter("__ranges", lambda r: (F.col("idx") >= r["__lo"]) & (F.col("idx") < r["__hi"]))
    met = rows.join(small(per), keys).withColumn("__r", F.explode(within))
    met = met.select(*rows.columns, *[F.col(f"__r.{c}").alias(c) for c in own])
    return met.withColumn("pred", predicted(met, columns))


def trades_at(predictions: DataFrame, by: list[str], horizon: int, t: str = "t_ms", pred: str = "pred", y: str = "y", threshold: str = "threshold") -> DataFrame:
    """Rows whose prediction reaches the threshold and that don't overlap the last one kept, with ret = sign(pred) y."""
    rows = predictions.filter(F.abs(pred) >= F.col(threshold)).select(*by, t, pred, y, threshold)
    rows = rows.withColumns({"__entry": F.col(t), "__exit": F.col(t) + horizon, "__ok": F.lit(True)})
    kept = timealign.gate_free(rows, by, [t]).filter("NOT held").drop("held", "__entry", "__exit", "__ok")
    return kept.withColumn("ret", F.signum(pred) * F.col(y))


def trade_stats(trades: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_trades, mean_bps, hit, t_stat) of trades with ret."""
    out = trades.groupBy(*by).agg(F.count("*").alias("n_trades"), F.avg("ret").alias("mean_bps"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"), F.stddev_samp("ret").alias("__s"))
    return out.withColumn("t_stat", F.when((F.col("n_trades") > 2) & (F.col("__s") > 0), F.col("mean_bps") / (F.col("__s") / F.sqrt("n_trades")))).drop("__s")


def nested(data: DataFrame, keys: list[str], columns: list[str], y: str, horizon: int, n_folds: int = 6, alphas=ALPHAS, shares=SHARES, expanding: bool = True, min_train: int = 500, least: tuple[int, int] = (500, 200), least_trades: int = 5, t: str = "t_ms") -> tuple[DataFrame, DataFrame]:
    """Walk-forward folds whose alpha and threshold are chosen within their training set: (folds, trades).

    data: keys, t_ms (unique in a key), columns and y. The last fifth of a
    training set chooses, of models fitted a horizon before it, the alpha and the
    quantile of |prediction| that earn most per trade with least_trades trades;
    ties go to the smaller. The test set is used once. Folds: keys, k, alpha,
    share, threshold, n_train, n_test, n_trades, mean_bps, hit, ic, r2.
    """
    rows = data.filter(features.finite([*columns, y])).select(*keys, t, *columns, F.col(y).alias("y"))
    rows = cut(carry.positions(rows, keys, t, [], "idx"))
    b = cut(_inner(folds(rows, keys, n_folds, horizon, None, expanding, min_train, t), rows, keys, horizon, t, "idx", least))
    fitted = cut(models(rows, b, {"inner": ("tr_beg", "in_end"), "full": ("tr_beg", "tr_end")}, keys, columns, "y", alphas))
    by = [*keys, "k", "alpha"]

    inner = cut(predictions(rows, b, keys, columns, "val_beg", "tr_end", fitted.filter("stage = 'inner'")).select(*by, t, "y", "pred"))
    levels = stats.quantiles(inner.withColumn("__a", F.abs("pred")), by, "__a", list(shares)).select(*by, "share", F.col("value").alias("threshold"))
    tried = trade_stats(trades_at(inner.join(levels, by), [*by, "share"], horizon, t), [*by, "share"])
    # a few models and shares a fold; means that differ by rounding only are ties
    best = tried.filter(F.col("n_trades") >= least_trades).groupBy(*keys, "k").agg(F.collect_list(F.struct("alpha", "share", "mean_bps")).alias("__all"))
    top = F.array_max(F.transform("__all", lambda e: e["mean_bps"])) - 1e-12
    first = F.array_min(F.transform(F.filter("__all", lambda e: e["mean_bps"] >= top), lambda e: F.struct(e["alpha"].alias("alpha"), e["share"].alias("share"))))
    best = best.select(*keys, "k", first.alias("__best"))
    chosen = cut(best.select(*keys, "k", "__best.*"))
    use = fitted.filter("stage = 'full'").join(chosen, by)
    train = predictions(rows, b, keys, columns, "tr_beg", "tr_end", use).withColumn("__a", F.abs("pred"))
    # Each fold has a share of its own: all are computed, and its own is taken.
    levels = stats.quantiles(train.select(*keys, "k", "__a"), [*keys, "k"], "__a", list(shares)).join(chosen, [*keys, "k", "share"]).select(*keys, "k", F.col("value").alias("threshold"))
    test = cut(predictions(rows, b, keys, columns, "te_beg", "te_end", use).select(*keys, "k", t, "y", "pred").join(levels, [*keys, "k"]))
    trades = trades_at(test, [*keys, "k"], horizon, t)
    scores = test.groupBy(*keys, "k").agg(F.count("*").alias("n_test"), F.first("threshold").alias("threshold"), F.corr("pred", "y").alias("ic"), F.when(F.var_pop("y") > 0, 1 - F.sum((F.col("y") - F.col("pred")) ** 2) / (F.var_pop("y") * F.count("y"))).otherwise(0.0).alias("r2"))
    out = chosen.join(b.select(*keys, "k", (F.col("tr_end") - F.col("tr_beg")).alias("n_train")), [*keys, "k"]).join(scores, [*keys, "k"]).join(trade_stats(trades, [*keys, "k"]), [*keys, "k"], "left")
    return out.select(*keys, "k", "alpha", "share", "threshold", "n_train", "n_test", F.coalesce("n_trades", F.lit(0)).cast("long").alias("n_trades"), "mean_bps", "hit", "ic", "r2"), trades


def scan(data: DataFrame, keys: list[str], columns: list[str], horizons: list[int], cost_bps: float = 4.0, **kw) -> DataFrame:
    """Nested selection at each horizon: (keys, horizon, samples, ic_mean, ic_positive, folds, n_trades, mean_bps, net_bps, hit, t_stat, low, high).

    data: a micro dataset with segment and mid, from which each horizon's label is taken.
    low and high bound the mean by resampling the trades, where there are more than five.
    """
    parts = []
    for h in horizons:
        d = label(data, keys, h)
        found, trades = nested(d, keys, columns, "y", h, **kw)
        per = found.groupBy(*keys).agg(F.avg("ic").alias("ic_mean"), F.count_if(F.col("ic") > 0).alias("ic_positive"), F.count("*").alias("folds"))
        n = d.filter("y IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("samples"))
        trades = cut(trades)
        limits = resample.resampled_ci(trades, keys, "ret", ["k", "t_ms"]).filter("n > 5").select(*keys, "low", "high")
        parts.append(n.join(per, keys).join(trade_stats(trades, keys), keys, "left").join(limits, keys, "left").withColumn("horizon", F.lit(h)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*keys, "horizon", "samples", "ic_mean", "ic_positive", "folds", F.coalesce("n_trades", F.lit(0)).cast("long").alias("n_trades"), "mean_bps", (F.col("mean_bps") - cost_bps).alias("net_bps"), "hit", "t_stat", "low", "high")


def stability(data: DataFrame, keys: list[str], columns: list[str], y: str, horizon: int, expanding=(4, 6, 8, 10), rolling=(6, 8), **kw) -> DataFrame:
    """Nested selection under other numbers and kinds of folds: (keys, kind, n_folds, folds, ic_positive, n_trades, mean_bps, hit, t_stat)."""
    parts = []
    for kind, n in [("expanding", n) for n in expanding] + [("rolling", n) for n in rolling]:
        found, trades = nested(data, keys, columns, y, horizon, n_folds=n, expanding=kind == "expanding", **kw)
        per = found.groupBy(*keys).agg(F.count("*").alias("folds"), F.count_if(F.col("ic") > 0).alias("ic_positive"))
        parts.append(per.join(trade_stats(trades, keys), keys, "left").withColumns({"kind": F.lit(kind), "n_folds": F.lit(n)}))
    return reduce(DataFrame.unionByName, parts).select(*keys, "kind", "n_folds", "folds", "ic_positive", F.coalesce("n_trades", F.lit(0)).cast("long").alias("n_trades"), "mean_bps", "hit", "t_stat")


def fixed(data: DataFrame, keys: list[str], columns: list[str], y: str, horizon: int, n_folds: int = 6, alpha: float = 1.0, share: float = 0.99, min_train: int = 500, t: str = "t_ms") -> DataFrame:
    """Trades (keys, t, pred, y, threshold, ret) of walk-forward folds with one alpha and one share for all.

    A fold's threshold is the quantile of |prediction| over its training set; the
    gate against overlaps runs over a key's test sets together.
    """
    rows = data.filter(features.finite([*columns, y])).select(*keys, t, *columns, F.col(y).alias("y"))
    rows = cut(carry.positions(rows, keys, t, [], "idx"))
    b = cut(folds(rows, keys, n_folds, horizon, None, True, min_train, t))
    fitted = cut(models(rows, b, {"full": ("tr_beg", "tr_end")}, keys, columns, "y", (alpha,)))
    train = predictions(rows, b, keys, columns, "tr_beg", "tr_end", fitted).withColumn("__a", F.abs("pred"))
    levels = stats.quantiles(train, [*keys, "k"], "__a", [share]).select(*keys, "k", F.col("value").alias("threshold"))
    test = predictions(rows, b, keys, columns, "te_beg", "te_end", fitted).select(*keys, "k", t, "y", "pred")
    return trades_at(cut(test.join(levels, [*keys, "k"])), keys, horizon, t)


def trade_parts(trades: DataFrame, keys: list[str], t: str = "t_ms", block: int = 5, **kw) -> DataFrame:
    """(keys, part, n_trades, mean_bps, hit, t_stat, low, high, block_low, block_high) of all trades, their first n // 2 and the rest.

    Limits of the mean come from resampling single trades and blocks of
    neighbouring ones, for all trades only. Times are unique in a key.
    """
    d = cut(carry.positions(trades.select(*keys, t, "ret"), keys, t, [], "__i"))
    n = d.groupBy(*keys).agg((F.max("__i") + 1).alias("__n"))
    half = carry.matched(d, n, keys).withColumn("part", F.when(F.col("__i") < F.expr("__n div 2"), "first").otherwise("second"))
    out = trade_stats(half.unionByName(half.withColumn("part", F.lit("all"))), [*keys, "part"])
    for name, size in (("", 1), ("block_", block)):
        limits = resample.resampled_ci(d, keys, "ret", [t], block=size, **kw).select(*keys, F.lit("all").alias("part"), F.col("low").alias(f"{name}low"), F.col("high").alias(f"{name}high"))
        out = carry.matched(out, limits, [*keys, "part"], "left")
    return out.select(*keys, "part", "n_trades", "mean_bps", "hit", "t_stat", "low", "high", "block_low", "block_high")


def by_hour(trades: DataFrame, keys: list[str], t: str = "t_ms", least: int = 3) -> DataFrame:
    """(keys, hour, n, mean_bps, hit) by hour of day in UTC, of hours with `least` trades or more."""
    g = trades.groupBy(*keys, F.expr(f"{t} div 3600000 % 24").alias("hour"))
    return g.agg(F.count("*").alias("n"), F.avg("ret").alias("mean_bps"), F.avg((F.col("ret") > 0).cast("double")).alias("hit")).filter(F.col("n") >= least)


def report(found: DataFrame, gated: DataFrame, keys: list[str], taker_bps: float = 5.0, maker_bps: float = 2.0) -> DataFrame:
    """One row per key: the folds' scores, the counts of the gate's outcomes, the backtest's metrics and its costs."""
    per = found.groupBy(*keys).agg(F.count("*").alias("folds"), F.avg("ic").alias("ic_mean"), F.count_if(F.col("ic") > 0).alias("ic_positive"), F.avg("r2").alias("r2_mean"), F.avg("n_train").alias("n_train_mean"), F.sum("n_test").alias("n_test"))
    outcomes = ("in_position", "no_data", "stale_book", "thin_book")
    counts = gated.groupBy(*keys).agg(F.count("*").alias("n_signals"), *[F.count_if(F.col("outcome") == o).alias(f"skipped_{o}") for o in outcomes])
    trades = backtest.trades_of(gated, taker_bps)
    costs = backtest.costs(trades, keys, taker_bps, maker_bps).drop("n", "gross_mean")
    return per.join(counts, keys, "left").join(backtest.metrics(trades, keys), keys, "left").join(costs, keys, "left")


def equity(gated: DataFrame, keys: list[str], taker_bps: float = 5.0, maker_bps: float = 2.0) -> DataFrame:
    """The trades of a gate in order, with returns, fees and the running sum of net returns."""
    d = backtest.trades_of(gated, taker_bps).withColumn("net_maker_bps", F.col("gross_bps") - 2 * maker_bps)
    return carry.running_sum(d, keys, "sig_t", ["exit_t"], F.col("net_bps"), "cum_bps")
