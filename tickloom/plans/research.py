"""Queries of research datasets and nested selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import backtest, features, research
from ..sources import tables
from .catalog import BARS, DAY, GAP, HORIZON, HOUR, STEP, SYM, B, query, r6

WINDOWS = [HOUR, 2 * HOUR]
COLUMNS = research.feature_columns(WINDOWS)


def _micro_sql(gap: int, step: int, horizon: int, align: int = 1) -> str:
    """CTEs up to x: a micro dataset over the events."""
    flow = ", ".join(f"coalesce(sum(x.{c}) FILTER (x.t_ms > g.t_ms - {w}), 0) AS {c}_{w}" for w in WINDOWS for c in ("ofi", "r2", "bv", "sv", "n"))
    return f"""WITH {B}, l0 AS (SELECT *, lag(t_ms) OVER w AS pt, lag(b0) OVER w AS pb, lag(a0) OVER w AS pa, lag(bq0) OVER w AS pbq, lag(aq0) OVER w AS paq FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t_ms, u)),
l AS (SELECT *, sum(CASE WHEN t_ms - pt > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY t_ms, u ROWS UNBOUNDED PRECEDING) AS segment, pt IS NULL OR t_ms - pt > {gap} AS first,
  (b0 + a0) / 2 AS mid FROM l0), i AS (SELECT *, CASE WHEN first THEN 0 ELSE CASE WHEN b0 >= pb THEN bq0 ELSE 0 END - CASE WHEN b0 <= pb THEN pbq ELSE 0 END - CASE WHEN a0 <= pa THEN aq0 ELSE 0 END + CASE WHEN a0 >= pa THEN paq ELSE 0 END END AS ofi,
  CASE WHEN first THEN 0 ELSE pow((ln(mid) - ln((pb + pa) / 2)) * 10000, 2) END AS r2 FROM l),
e AS (SELECT symbol, segment, min(t_ms) AS t0, max(t_ms) AS t1 FROM i GROUP BY ALL),
g AS (SELECT symbol, segment, t_ms FROM (SELECT symbol, segment, t0, unnest(range(CAST(ceil((t0 + {min(WINDOWS)}) / {align}) AS BIGINT) * {align}, t1 - {horizon}, {step})) AS t_ms FROM e) WHERE t_ms >= t0 + {max(WINDOWS)}),
m AS (SELECT symbol, t_ms, arg_max(struct_pack(mid := mid, sp := (a0 - b0) / mid * 10000, i1 := (bq0 - aq0) / (bq0 + aq0), i20 := (db - da) / (db + da), mi := ((b0 * aq0 + a0 * bq0) / (bq0 + aq0) - mid) / mid * 10000, db := db, da := da), u) AS s FROM i GROUP BY ALL),
n AS (SELECT g.*, m.s FROM g ASOF JOIN m ON g.symbol = m.symbol AND g.t_ms >= m.t_ms), f AS (SELECT n.*, m.s.mid AS mid1 FROM (SELECT *, t_ms + {horizon} AS th FROM n) n ASOF JOIN m ON n.symbol = m.symbol AND n.th >= m.t_ms),
x AS (SELECT symbol, t_ms, ofi, r2, 0 AS bv, 0 AS sv, 0 AS n FROM i UNION ALL SELECT symbol, t_ms, 0, 0, CASE WHEN side = 'buy' THEN q ELSE 0 END, CASE WHEN side = 'buy' THEN 0 ELSE q END, 1 FROM t),
w AS (SELECT g.symbol, g.t_ms, {flow} FROM g LEFT JOIN x ON x.symbol = g.symbol AND x.t_ms > g.t_ms - {max(WINDOWS)} AND x.t_ms <= g.t_ms GROUP BY g.symbol, g.t_ms),
d AS (SELECT f.symbol, f.segment, f.t_ms, s.mid AS mid, s.sp AS spread_bps, s.i1 AS imb1, s.i20 AS imb20, s.mi AS micro_bps, s.db AS depth20_bid, s.da AS depth20_ask, (mid1 / s.mid - 1) * 10000 AS y_bps,
  {", ".join(f"ofi_{v} AS ofi_w{v}, sqrt(r2_{v}) AS rv_bps_w{v}, bv_{v} AS buy_vol_w{v}, sv_{v} AS sell_vol_w{v}, n_{v} AS n_trades_w{v}, CASE WHEN bv_{v} + sv_{v} > 0 THEN (bv_{v} - sv_{v}) / (bv_{v} + sv_{v}) ELSE 0 END AS flow_imb_w{v}" for v in WINDOWS)} FROM f JOIN w USING (symbol, t_ms))
"""


def _micro(spark, d, gap: int, **kw) -> DataFrame:
    return research.micro_dataset(tables.book(spark, d), tables.trades(spark, d), SYM, kw.pop("step", STEP), kw.pop("horizon", HORIZON), WINDOWS, gap, **kw)


OUT = [*COLUMNS, "y_bps"]


@query("b1_micro_segments", _micro_sql(GAP, STEP, HORIZON) + f"SELECT symbol, CAST(segment AS INT) AS segment, t_ms, round(mid, 5) AS mid, {', '.join(f'round(CAST({c} AS DOUBLE), 3) + 0.0 AS {c}' for c in OUT)}, CAST(CASE WHEN y_bps > 0.5 THEN 1 WHEN y_bps < -0.5 THEN -1 ELSE 0 END AS TINYINT) AS y_cls FROM d")
def b1s(spark, d):
    """The micro dataset inside gap-free segments, with state, order flow and realised volatility."""
    return _micro(spark, d, GAP).select("symbol", "segment", "t_ms", r6(F.col("mid"), "mid", 5), *[r6(F.col(c), c, 3) for c in OUT], "y_cls")


@query("j6_label_segment", _micro_sql(GAP, STEP, HORIZON) + f"SELECT a.symbol, a.t_ms, round((b.mid / a.mid - 1) * 10000, 3) + 0.0 AS y FROM d a LEFT JOIN d b ON a.symbol = b.symbol AND a.segment = b.segment AND b.t_ms = a.t_ms + {4 * STEP}")
def j6s(spark, d):
    """Labels of a horizon chosen later: the row at exactly that distance in the same segment."""
    return research.label(_micro(spark, d, GAP), SYM, 4 * STEP).select("symbol", "t_ms", r6(F.col("y"), "y", 3))


KLINE = ["ret_1", "ret_5", "rv_15"]
K_SQL = """k0 AS (SELECT *, ln(close / lag(close) OVER w) * 10000 AS r, ln(close / lag(close, 5) OVER w) * 10000 AS ret_5 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_ms)),
k AS (SELECT *, r AS ret_1, CASE WHEN count(*) OVER w15 = 15 THEN sqrt(sum(coalesce(r * r, 0)) OVER w15) END AS rv_15 FROM k0 WINDOW w15 AS (PARTITION BY symbol ORDER BY open_ms ROWS 14 PRECEDING))"""


@query("b4_combined", _micro_sql(6 * GAP, HOUR, 2 * HOUR, HOUR) + f", {BARS}, {K_SQL} SELECT d.symbol, d.t_ms, {', '.join(f'round(CAST({c} AS DOUBLE), 3) + 0.0 AS {c}' for c in [*KLINE, 'imb1', f'flow_imb_w{WINDOWS[1]}', 'y_bps'])} FROM d JOIN k ON k.symbol = d.symbol AND k.open_ms = d.t_ms - {HOUR} WHERE ret_1 IS NOT NULL AND ret_5 IS NOT NULL AND rv_15 IS NOT NULL")
def b4(spark, d):
    """Micro features on whole hours beside those of the bar that just closed."""
    bars = features.bars(tables.trades(spark, d), HOUR)
    c = research.combined_dataset(tables.book(spark, d), tables.trades(spark, d), bars, SYM, HOUR, 2 * HOUR, WINDOWS, 6 * GAP, KLINE)
    return c.select("symbol", "t_ms", *[r6(F.col(x), x, 3) for x in (*KLINE, "imb1", f"flow_imb_w{WINDOWS[1]}", "y_bps")])


@query("w14_kline_trims", f"""WITH {B}, {BARS.replace(str(HOUR), str(DAY))}, g AS (SELECT *, CASE WHEN open_ms - lag(open_ms) OVER w > {3 * DAY} THEN 1 ELSE 0 END AS new, ln(close / lag(close, 5) OVER w) * 10000 AS ret_5 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_ms)),
s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY open_ms ROWS UNBOUNDED PRECEDING) AS segment FROM g), i AS (SELECT *, row_number() OVER w - 1 AS i, (lead(close, 3) OVER w / close - 1) * 10000 AS y_bps FROM s WINDOW w AS (PARTITION BY symbol, segment ORDER BY open_ms))
SELECT symbol, CAST(segment AS INT) AS segment, open_ms, round(ret_5, 4) AS ret_5, round(y_bps, 4) AS y_bps FROM i WHERE i >= 8 AND y_bps IS NOT NULL AND ret_5 IS NOT NULL AND (i - 8) % 2 = 0""")
def w14(spark, d):
    """Bars inside segments (up to two missing bars), without warm-up and horizon, by a stride."""
    k = research.kline_rows(features.bars(tables.trades(spark, d), DAY), SYM, DAY, 3, warm=8, stride=2, columns=["ret_5"])
    return k.select("symbol", "segment", "open_ms", r6(F.col("ret_5"), "ret_5", 4), r6(F.col("y_bps"), "y_bps", 4))


NESTED = {"shares": (0.9, 0.95, 0.99), "n_folds": 4}
#: So long a gap that a symbol is one segment: folds need rows.
ONE = 30 * DAY


@query("m5_nested")
def m5(spark, d):
    """Folds whose alpha and threshold are chosen within their training set (tested against a numpy loop)."""
    found, _ = research.nested(_micro(spark, d, ONE), SYM, COLUMNS, "y_bps", HORIZON, **NESTED)
    return found.select("symbol", "k", "alpha", "share", "n_train", "n_test", "n_trades", *[r6(F.col(c), c, 3) for c in ("threshold", "mean_bps", "hit", "ic", "r2")])


@query("m8_scan")
def m8(spark, d):
    """Nested selection at several horizons (tested against a numpy loop)."""
    s = research.scan(_micro(spark, d, ONE), SYM, COLUMNS, [2 * STEP, HORIZON], **NESTED)
    return s.select("symbol", "horizon", "samples", "ic_positive", "folds", "n_trades", *[r6(F.col(c), c, 3) for c in ("ic_mean", "mean_bps", "net_bps", "hit", "t_stat", "low", "high")])


#: A fixed choice: few rows pass a share of 0.99 at these sizes.
FIXED = {"n_folds": 4, "alpha": 1.0, "share": 0.9, "min_train": 300}


@query("m9_fixed_hours")
def m9_hours(spark, d):
    """Trades of a fixed alpha and share by hour of day (tested against a numpy loop)."""
    h = research.by_hour(research.fixed(_micro(spark, d, ONE), SYM, COLUMNS, "y_bps", HORIZON, **FIXED), SYM)
    return h.select("symbol", "hour", "n", *[r6(F.col(c), c, 3) for c in ("mean_bps", "hit")])


@query("m9_fixed_parts")
def m9_parts(spark, d):
    """The same trades, all with both intervals of their mean, and by halves (tested against a numpy loop)."""
    p = research.trade_parts(research.fixed(_micro(spark, d, ONE), SYM, COLUMNS, "y_bps", HORIZON, **FIXED), SYM)
    return p.select("symbol", "part", "n_trades", *[r6(F.col(c), c, 3) for c in ("mean_bps", "hit", "t_stat", "low", "high", "block_low", "block_high")])


@query("m9_stability")
def m9(spark, d):
    """Nested selection under other folds (tested against a numpy loop)."""
    s = research.stability(_micro(spark, d, ONE), SYM, COLUMNS, "y_bps", HORIZON, (4, 6), (4,), shares=NESTED["shares"], min_train=300, least=(300, 100))
    return s.select("symbol", "kind", "n_folds", "folds", "ic_positive", "n_trades", *[r6(F.col(c), c, 3) for c in ("mean_bps", "hit", "t_stat")])


@query("e4_report")
def e4(spark, d):
    """The report of a run per symbol: folds, backtest of the chosen signals, costs (its parts are tested)."""
    found, trades = research.nested(_micro(spark, d, ONE), SYM, COLUMNS, "y_bps", HORIZON, **NESTED)
    signals = trades.select("symbol", "t_ms", "pred")
    gated = backtest.gate(backtest.feasibility(signals, tables.book(spark, d), SYM, 20.0, 1000, HORIZON, HORIZON // 3, 0.0), SYM)
    return research.report(found, gated, SYM).select("symbol", "folds", "ic_positive", "n_signals", "n", *[r6(F.col(c), c, 3) for c in ("ic_mean", "gross_mean", "net_taker", "net_maker", "net_total", "max_drawdown")])


@query("f_quantiles", "SELECT l_returnflag, CAST(s AS DOUBLE) AS share, round(quantile_cont(l_extendedprice, [0.001, 0.5, 0.999])[i], 4) AS value, count(*) AS n FROM lineitem, (SELECT unnest([0.001, 0.5, 0.999]) AS s, unnest([1, 2, 3]) AS i) GROUP BY l_returnflag, s, i")
def f_quantiles(spark, d):
    """Exact quantiles of every group, a few values ranked."""
    q = stats.quantiles(tables.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.001, 0.5, 0.999])
    return q.select("l_returnflag", "share", r6(F.col("value"), "value", 4), "n")
