"""Queries of dataset builders and summaries, each beside its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets, features, timealign
from ..sources import tables
from .catalog import BARS, HORIZON, HOUR, STEP, SYM, B, T, query, r6

WIDTHS = [HOUR, 2 * HOUR, 4 * HOUR]


def _bars(spark, d):
    return features.bars(tables.trades(spark, d), HOUR)


@query("b2_multi_window", f"""WITH {T}, e AS (SELECT symbol, min(t_ms) AS t0, max(t_ms) AS t1 FROM t GROUP BY symbol), g AS (SELECT symbol, unnest(range(t0 + {max(WIDTHS)}, t1 - {HORIZON}, {STEP})) AS t_ms FROM e)
SELECT g.symbol, g.t_ms, {', '.join(f"count(t.a) FILTER (t.t_ms > g.t_ms - {n}) AS n_w{n}, round(coalesce(sum(t.q) FILTER (t.t_ms > g.t_ms - {n}), 0), 5) AS q_w{n}" for n in WIDTHS)}
FROM g LEFT JOIN t ON t.symbol = g.symbol AND t.t_ms > g.t_ms - {max(WIDTHS)} AND t.t_ms <= g.t_ms GROUP BY ALL""")
def b2(spark, d):
    t = tables.trades(spark, d)
    g = timealign.grid(t, SYM, "t_ms", STEP, max(WIDTHS), HORIZON)
    out = timealign.multi_window_sums(g, t, SYM, "t_ms", WIDTHS, {"n": F.lit(1).cast("long"), "q": F.col("q")})
    return out.select("symbol", "t_ms", *[F.col(f"n_w{n}").cast("long").alias(f"n_w{n}") for n in WIDTHS], *[r6(F.col(f"q_w{n}"), f"q_w{n}", 5) for n in WIDTHS])


@query("b5_fill_bars", f"""WITH {T}, r AS (SELECT symbol, t_ms // {HOUR} * {HOUR} AS open_ms, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT symbol, t_ms // {HOUR} * {HOUR} AS open_ms, count(*) AS n FROM t WHERE a % 3 = 0 GROUP BY ALL),
e AS (SELECT symbol, min(open_ms) AS lo, max(open_ms) AS hi FROM b GROUP BY symbol), m AS (SELECT symbol, median(b.n / greatest(r.n, 1)) AS ratio FROM b JOIN r USING (symbol, open_ms) GROUP BY symbol)
SELECT symbol, open_ms, CAST(n AS DOUBLE) AS n_trades, FALSE AS filled FROM b UNION ALL SELECT symbol, open_ms, round(n * ratio, 6), TRUE FROM (SELECT * FROM r ANTI JOIN b USING (symbol, open_ms)) x JOIN e USING (symbol) JOIN m USING (symbol) WHERE open_ms BETWEEN lo AND hi""")
def b5(spark, d):
    some = features.bars(tables.trades(spark, d).filter("a % 3 = 0"), HOUR)
    return datasets.fill_bars(some, _bars(spark, d), SYM).withColumn("n_trades", F.round("n_trades", 6))


@query("b3_kline_dataset", f"""WITH {T}, {BARS}, x AS (SELECT symbol, open_ms, ln(close / lag(close, 5) OVER w) * 10000 AS ret_5, ln(close / lag(close, 60) OVER w) * 10000 AS ret_60, (lead(close, 5) OVER w / close - 1) * 10000 AS y_bps FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_ms))
SELECT symbol, open_ms, round(ret_5, 4) AS ret_5, round(ret_60, 4) AS ret_60, round(y_bps, 4) AS y_bps FROM x WHERE ret_5 IS NOT NULL AND ret_60 IS NOT NULL AND y_bps IS NOT NULL""")
def b3(spark, d):
    return datasets.kline_dataset(_bars(spark, d), 5, ["ret_5", "ret_60"]).select("symbol", "open_ms", *[r6(F.col(c), c, 4) for c in ("ret_5", "ret_60", "y_bps")])


@query("j6_label_ahead", f"WITH {T}, {BARS} SELECT a.symbol, a.open_ms, round((b.close / a.close - 1) * 10000, 4) + 0.0 AS y_bps FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.open_ms = a.open_ms + {5 * HOUR}")
def j6(spark, d):
    return datasets.label_ahead(_bars(spark, d), 5 * HOUR, SYM).select("symbol", "open_ms", r6(F.col("y_bps"), "y_bps", 4))


@query("a8_fold_summary", "WITH f AS (SELECT o_orderpriority, avg(o_totalprice) - 150000 AS x FROM orders GROUP BY 1) SELECT round(avg(x), 3) AS mean, round(median(x), 3) AS median, round(min(x), 3) AS min, round(max(x), 3) AS max, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM f")
def a8(spark, d):
    f = tables.table(spark, d, "orders").groupBy("o_orderpriority").agg((F.avg("o_totalprice") - 150000).alias("x"))
    return datasets.fold_summary(f, "x").select(*[r6(F.col(c), c, 3) for c in ("mean", "median", "min", "max")], "positive")


@query("a22_mode", "SELECT l_discount, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_discount LIMIT 1")
def a22(spark, d):
    return datasets.smallest_mode(tables.table(spark, d, "lineitem"), "l_discount")


@query("a23_halves", f"""WITH {T}, i AS (SELECT q - 50 AS x, row_number() OVER (ORDER BY t_ms, a) - 1 AS idx, count(*) OVER () AS n FROM t)
SELECT CASE WHEN idx < n // 2 THEN 'first' ELSE 'second' END AS half, count(*) AS n, round(avg(x), 5) AS mean, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 5) AS hit, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS t_stat FROM i GROUP BY 1""")
def a23(spark, d):
    h = datasets.halves(tables.trades(spark, d).withColumn("x", F.col("q") - 50), "t_ms", ["a"], "x")
    return h.select("half", "n", r6(F.col("mean"), "mean", 5), r6(F.col("hit"), "hit", 5), r6(F.col("t_stat"), "t_stat", 4))


@query("a17_longest_gap", f"WITH {T}, s AS (SELECT symbol, t_ms, lag(t_ms) OVER (PARTITION BY symbol ORDER BY t_ms) AS p FROM t) SELECT symbol, p AS from_t, t_ms AS to_t, t_ms - p AS gap FROM s WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t_ms - p DESC, p) = 1")
def a17(spark, d):
    return datasets.longest_gap(tables.trades(spark, d), SYM, "t_ms")


@query("st12_clock_jumps", f"WITH {T}, s AS (SELECT symbol, a, (t_ms - lag(t_ms) OVER w) - (a - lag(a) OVER w) * 1000 AS jump FROM t WINDOW w AS (PARTITION BY symbol ORDER BY a)) SELECT symbol, a, jump FROM s WHERE abs(jump) > 500")
def st12(spark, d):
    j = datasets.clock_jumps(tables.trades(spark, d), SYM, "a", F.col("t_ms"), F.col("a") * 1000, 500)
    return j.select("symbol", "a", F.col("jump").cast("long").alias("jump"))


@query("o5_top_levels", f"WITH {B} SELECT symbol, a AS u, i, round(p - 0.1 * i, 6) AS px, CAST(1 + (k + i) % 7 AS DOUBLE) AS qty FROM (SELECT *, unnest(range(3)) AS i FROM t)")
def o5(spark, d):
    b = tables.book(spark, d).withColumn("l", datasets.top_levels("bid_px", "bid_qty", 3, descending=True))
    return b.select("symbol", "u", F.posexplode("l").alias("i", "e")).select("symbol", "u", F.col("i").cast("long").alias("i"), F.round("e.key", 6).alias("px"), F.col("e.value").alias("qty"))


@query("k3_flatten_levels", f"WITH {T} SELECT symbol, a AS u, round(p - 0.1 * 0, 6) AS bid_px_0, round(p - 0.1 * 1, 6) AS bid_px_1, round(p - 0.1 * 19, 6) AS bid_px_19, CAST(1 + (k + 19) % 7 AS DOUBLE) AS bid_qty_19, CAST(NULL AS DOUBLE) AS bid_qty_20 FROM t")
def k3(spark, d):
    f = datasets.flatten_levels(tables.book(spark, d).select("symbol", "u", "bid_px", "bid_qty"), ["bid_px", "bid_qty"], 21)
    return f.select("symbol", "u", *[r6(F.col(c), c) for c in ("bid_px_0", "bid_px_1", "bid_px_19")], "bid_qty_19", "bid_qty_20")
