"""Queries of the engine over the driver tables, each beside its DuckDB oracle.

Events stand in for trades and books (see sources.tables); the same arithmetic is
written in both engines. Floats are rounded on both sides, since parallel sums
differ in their last digits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import resample, stats
from ..operators import backtest, carry, dedup, features, index, monitor, ridge, timealign
from ..sources import tables
from ..sources.shared import cut
from ..streaming import book as books

GAP, WINDOW, STEP, HORIZON = 6_000_000, 3_600_000, 600_000, 1_800_000
DAY, HOUR = 86_400_000, 3_600_000
SYM = ["symbol"]
QUERIES: dict = {}
SQL: dict[str, str] = {}

T = """t AS (SELECT event_type AS symbol, event_id AS a, epoch_us(ts) // 1000 AS t_ms, 100 + value / 100 AS p, value AS q,
  CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
B = T + """, b AS (SELECT symbol, a AS u, t_ms, p AS b0, p + 0.1 * 1 AS a0, CAST(1 + k % 7 AS DOUBLE) AS bq0, CAST(1 + k % 5 AS DOUBLE) AS aq0,
  list_sum(list_transform(range(20), lambda i: CAST(1 + (k + i) % 7 AS DOUBLE))) AS db, list_sum(list_transform(range(20), lambda i: CAST(1 + (k + 3 * i) % 5 AS DOUBLE))) AS da, p, k FROM t)"""
G = f"""e AS (SELECT symbol, min(t_ms) AS t0, max(t_ms) AS t1 FROM t GROUP BY symbol),
g AS (SELECT symbol, unnest(range(t0 + {WINDOW}, t1 - {HORIZON}, {STEP})) AS t_ms FROM e)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c, name: str, digits: int = 6):
    return (F.round(c, digits) + F.lit(0.0)).alias(name)  # a negative zero becomes zero


def _trades(spark, d):
    return tables.trades(spark, d)


def _grid(t: DataFrame) -> DataFrame:
    return timealign.grid(t, SYM, "t_ms", STEP, WINDOW, HORIZON)


# Sources, dedup, versions

LOG_KEYS = ["l_orderkey", "l_linenumber"]
LOG_ORDER = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"]
LOG = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("d1_keep_first", f"SELECT {LOG} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LOG_ORDER)}) AS r FROM lineitem) WHERE r = 1")
def d1(spark, d):
    cols = [*LOG_KEYS, *LOG_ORDER]
    return dedup.keep_first(tables.table(spark, d, "lineitem").select(*cols), LOG_KEYS, LOG_ORDER).select(*LOG.split(", "))


@query("d2_keep_last", f"SELECT {LOG} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {' DESC, '.join(LOG_ORDER)} DESC) AS r FROM lineitem) WHERE r = 1")
def d2(spark, d):
    cols = [*LOG_KEYS, *LOG_ORDER]
    return dedup.keep_last(tables.table(spark, d, "lineitem").select(*cols), LOG_KEYS, LOG_ORDER).select(*LOG.split(", "))


@query("d3_latest_version", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(floor(value), 0) DESC, event_id) AS r FROM events) WHERE r = 1")
def d3(spark, d):
    e = tables.table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("v"))
    return dedup.latest_version(e, ["user_id"], "v", "event_id").select("user_id", "event_id")


@query("d5_duplicate_audit", "SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS duplicate_keys, count(*) FILTER (n > 1) = 0 AS ok FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def d5(spark, d):
    return dedup.duplicate_audit(tables.table(spark, d, "lineitem"), LOG_KEYS)


@query("j7_diff", """WITH l AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0)
SELECT CASE WHEN r.o_orderkey IS NULL THEN 'only_left' WHEN l.o_orderkey IS NULL THEN 'only_right' WHEN l.o_totalprice = r.o_totalprice AND l.o_orderstatus = r.o_orderstatus THEN 'matched' ELSE 'mismatched' END AS status, count(*) AS n FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey GROUP BY 1""")
def j7(spark, d):
    o = tables.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    right = o.filter("o_orderkey % 3 <> 0").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"))
    return dedup.diff(o.filter("o_orderkey % 5 <> 0"), right, ["o_orderkey"], ["o_totalprice", "o_orderstatus"]).groupBy("status").agg(F.count("*").alias("n"))


@query("s6_json_fields", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def s6(spark, d):
    return _trades(spark, d).groupBy("k").agg(F.count("*").alias("n"))


# Summaries and dashboard queries

@query("a3_table_summary", f"""WITH {T}, s AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY symbol ORDER BY t_ms) AS d FROM t)
SELECT symbol, count(*) AS n_rows, min(t_ms) AS t_start, max(t_ms) AS t_end, round((max(t_ms) - min(t_ms)) / 1000, 6) AS span_s, max(d) AS max_gap, count(*) FILTER (d > {GAP}) AS n_gaps FROM s GROUP BY symbol""")
def a3(spark, d):
    return stats.gap_summary(_trades(spark, d), SYM, "t_ms", GAP).withColumn("span_s", F.round("span_s", 6))


@query("a12_hourly_counts", f"WITH {T}, c AS (SELECT symbol, (t_ms // {HOUR}) % 24 AS hh, count(*) AS n FROM t GROUP BY ALL) SELECT s.symbol, h AS hour, coalesce(n, 0) AS n FROM (SELECT DISTINCT symbol FROM t) s CROSS JOIN range(24) r(h) LEFT JOIN c ON c.symbol = s.symbol AND h = hh")
def a12(spark, d):
    n = _trades(spark, d).groupBy("symbol", F.expr(f"t_ms div {HOUR} % 24").alias("hour")).agg(F.count("*").alias("n"))
    slots = n.select("symbol").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)).cast("array<long>")))
    return slots.join(n, ["symbol", "hour"], "left").select("symbol", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("a13_inventory", f"WITH {T} SELECT symbol, t_ms // {DAY} AS day, count(*) AS n_rows, min(t_ms) AS t_min, max(t_ms) AS t_max FROM t GROUP BY ROLLUP (symbol, day)")
def a13(spark, d):
    t = _trades(spark, d).withColumn("day", F.expr(f"t_ms div {DAY}"))
    return t.rollup("symbol", "day").agg(F.count("*").alias("n_rows"), F.min("t_ms").alias("t_min"), F.max("t_ms").alias("t_max"))


@query("a14_status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def a14(spark, d):
    o = tables.table(spark, d, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("a15_latency_percentiles", f"""WITH {T}, l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t_ms DESC, a DESC) <= 20000), s AS (SELECT symbol, list_sort(list(q)) AS s FROM l GROUP BY symbol)
SELECT symbol, CAST(len(s) AS BIGINT) AS n, round(s[1 + CAST(least(len(s) - 1, floor(len(s) * 0.5)) AS INT)], 6) AS p50, round(s[1 + CAST(least(len(s) - 1, floor(len(s) * 0.95)) AS INT)], 6) AS p95, round(s[1 + CAST(least(len(s) - 1, floor(len(s) * 0.99)) AS INT)], 6) AS p99 FROM s""")
def a15(spark, d):
    """Nearest-rank percentiles over the last 20,000 samples of a symbol, the width of the latency window."""
    w = Window.partitionBy("symbol").orderBy(F.desc("t_ms"), F.desc("a"))
    last = _trades(spark, d).withColumn("__r", F.row_number().over(w)).filter("__r <= 20000")
    s = last.groupBy("symbol").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("q")).alias("s"))
    return s.select("symbol", "n", *[r6(stats.nearest_rank("s", p), f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])


@query("a19_file_counts", "SELECT 'lineitem' AS name, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def a19(spark, d):
    parts = [tables.table(spark, d, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in ("lineitem", "orders", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("o2_topk_recent", "SELECT event_id, event_type FROM events WHERE value > 50 ORDER BY ts DESC, event_id DESC LIMIT 20")
def o2(spark, d):
    e = tables.table(spark, d, "events").filter("value > 50")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type")


@query("o4_latest_row", f"WITH {T} SELECT symbol, arg_max(a, (t_ms, a)) AS a, round(arg_max(p, (t_ms, a)), 6) AS p FROM t GROUP BY symbol")
def o4(spark, d):
    o = F.struct("t_ms", "a")
    return _trades(spark, d).groupBy("symbol").agg(F.max_by("a", o).alias("a"), F.round(F.max_by("p", o), 6).alias("p"))


@query("w9_stride_sample", f"WITH {T}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t_ms, a) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM t) SELECT symbol, t_ms, round(p, 6) AS p FROM r WHERE i % greatest(1, n // 100) = 0")
def w9(spark, d):
    t = _trades(spark, d)
    n = t.groupBy("symbol").agg(F.count("*").alias("n"))
    r = carry.positions(t, SYM, "t_ms", ["a"], "i").join(n, "symbol")
    return r.filter("i % greatest(1, n div 100) = 0").select("symbol", "t_ms", r6(F.col("p"), "p"))


# Time alignment

@query("w5_segments", f"""WITH {T}, n AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER w > {GAP} THEN 1 ELSE 0 END AS x FROM t WINDOW w AS (PARTITION BY symbol ORDER BY t_ms, a)),
s AS (SELECT *, CAST(sum(x) OVER (PARTITION BY symbol ORDER BY t_ms, a ROWS UNBOUNDED PRECEDING) AS INT) AS segment FROM n)
SELECT symbol, segment, count(*) AS n, min(t_ms) AS t0, max(t_ms) AS t1 FROM s GROUP BY ALL""")
def w5(spark, d):
    s = timealign.segments(_trades(spark, d), SYM, "t_ms", "a", GAP)
    return s.groupBy("symbol", "segment").agg(F.count("*").alias("n"), F.min("t_ms").alias("t0"), F.max("t_ms").alias("t1"))


@query("j1_asof_backward", f"WITH {T}, {G}, m AS (SELECT symbol, t_ms, arg_max(p, a) AS p, max(a) AS a FROM t GROUP BY symbol, t_ms) SELECT g.symbol, g.t_ms, m.t_ms AS t_match, m.a AS a, round(m.p, 6) AS p FROM g ASOF LEFT JOIN m ON g.symbol = m.symbol AND g.t_ms >= m.t_ms")
def j1(spark, d):
    t = _trades(spark, d)
    return timealign.asof_backward(_grid(t), t, SYM, "t_ms", "a", ["a", "p"]).withColumn("p", F.round("p", 6))


@query("w1_window_sums", f"""WITH {T}, {G} SELECT g.symbol, g.t_ms, count(t.a) AS n, round(coalesce(sum(t.q), 0), 6) AS q, round(coalesce(sum(t.q) FILTER (side = 'buy'), 0), 6) AS buy FROM g LEFT JOIN t ON t.symbol = g.symbol AND t.t_ms > g.t_ms - {WINDOW} AND t.t_ms <= g.t_ms GROUP BY ALL""")
def w1(spark, d):
    t = _trades(spark, d)
    out = timealign.window_sums(_grid(t), t, SYM, "t_ms", WINDOW, {"n": F.lit(1).cast("long"), "q": F.col("q"), "buy": F.when(F.col("side") == "buy", F.col("q")).otherwise(0.0)})
    return out.select("symbol", "t_ms", F.col("n").cast("long").alias("n"), r6(F.col("q"), "q"), r6(F.col("buy"), "buy"))


MICRO_SQL = f"""WITH {T}, {G}, m AS (SELECT symbol, t_ms, arg_max(p, a) AS p FROM t GROUP BY symbol, t_ms),
n AS (SELECT g.symbol, g.t_ms, m.p AS p0 FROM g ASOF LEFT JOIN m ON g.symbol = m.symbol AND g.t_ms >= m.t_ms),
f AS (SELECT n.*, m.p AS p1 FROM (SELECT *, t_ms + {HORIZON} AS th FROM n) n ASOF LEFT JOIN m ON n.symbol = m.symbol AND n.th >= m.t_ms),
w AS (SELECT g.symbol, g.t_ms, coalesce(sum(CASE WHEN side = 'buy' THEN q ELSE 0 END), 0) AS bv, coalesce(sum(CASE WHEN side = 'buy' THEN 0 ELSE q END), 0) AS sv, count(t.a) AS n FROM g LEFT JOIN t ON t.symbol = g.symbol AND t.t_ms > g.t_ms - {WINDOW} AND t.t_ms <= g.t_ms GROUP BY ALL),
x AS (SELECT f.symbol, f.t_ms, bv, sv, n, CASE WHEN bv + sv > 0 THEN (bv - sv) / (bv + sv) ELSE 0 END AS flow_imb, (p1 / p0 - 1) * 10000 AS y_bps FROM f JOIN w USING (symbol, t_ms))
"""


def _micro(spark, d) -> DataFrame:
    """Grid rows with flow over the trailing window, as-of price and the forward label."""
    t = _trades(spark, d)
    side = F.col("side") == "buy"
    sums = {"bv": F.when(side, F.col("q")).otherwise(0.0), "sv": F.when(side, 0.0).otherwise(F.col("q")), "n": F.lit(1).cast("long")}
    g = timealign.window_sums(_grid(t), t, SYM, "t_ms", WINDOW, sums)
    # One as-of lookup for now and for the horizon, then a row per grid time again.
    both = g.withColumn("__at", F.col("t_ms")).withColumn("__ahead", F.explode(F.array(F.lit(0), F.lit(HORIZON))))
    hit = timealign.asof_backward(both.withColumn("t_ms", F.col("__at") + F.col("__ahead")), t, SYM, "t_ms", "a", ["p"])
    y = hit.groupBy("symbol", F.col("__at").alias("t_ms")).agg(*[F.max(c).alias(c) for c in sums], F.max(F.when(F.col("__ahead") == 0, F.col("p"))).alias("p0"), F.max(F.when(F.col("__ahead") > 0, F.col("p"))).alias("p1"))
    total = F.col("bv") + F.col("sv")
    return y.select("symbol", "t_ms", "bv", "sv", "n", F.when(total > 0, (F.col("bv") - F.col("sv")) / total).otherwise(0.0).alias("flow_imb"), ((F.col("p1") / F.col("p0") - 1) * 1e4).alias("y_bps"))


@query("b1_micro_dataset", MICRO_SQL + "SELECT symbol, t_ms, round(bv, 5) AS bv, round(sv, 5) AS sv, n, round(flow_imb, 5) AS flow_imb, round(y_bps, 5) AS y_bps, CAST(CASE WHEN y_bps > 0.5 THEN 1 WHEN y_bps < -0.5 THEN -1 ELSE 0 END AS TINYINT) AS y_cls FROM x")
def b1(spark, d):
    m = _micro(spark, d)
    return m.select("symbol", "t_ms", r6(F.col("bv"), "bv", 5), r6(F.col("sv"), "sv", 5), F.col("n").cast("long").alias("n"), r6(F.col("flow_imb"), "flow_imb", 5), r6(F.col("y_bps"), "y_bps", 5), features.three_way(F.col("y_bps")).alias("y_cls"))


@query("flagship_ic", MICRO_SQL + "SELECT symbol, count(*) AS n, round(avg(y_bps), 5) AS y_mean, round(corr(flow_imb, y_bps), 5) AS ic FROM x GROUP BY symbol")
def flagship(spark, d):
    return _micro(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), r6(F.avg("y_bps"), "y_mean", 5), r6(F.corr("flow_imb", "y_bps"), "ic", 5))


@query("w12_greedy_gate", f"""WITH RECURSIVE {T}, s AS (SELECT DISTINCT symbol, t_ms FROM t),
r AS (SELECT symbol, min(t_ms) AS t_ms FROM s GROUP BY symbol UNION ALL SELECT r.symbol, x.t_ms FROM r, LATERAL (SELECT min(s.t_ms) AS t_ms FROM s WHERE s.symbol = r.symbol AND s.t_ms >= r.t_ms + {WINDOW}) x WHERE x.t_ms IS NOT NULL)
SELECT symbol, t_ms FROM r""")
def w12(spark, d):
    return timealign.greedy_nonoverlap(_trades(spark, d), SYM, "t_ms", WINDOW)


@query("j9_gap_membership", f"""WITH {T}, k AS (SELECT DISTINCT a FROM t WHERE a % 7 <> 0), g AS (SELECT lag(a) OVER (ORDER BY a) + 1 AS from_a, a - 1 AS to_a FROM k), h AS (SELECT * FROM g WHERE from_a <= to_a)
SELECT h.from_a, h.to_a, count(*) AS n_late FROM h JOIN t ON t.a BETWEEN h.from_a AND h.to_a GROUP BY ALL""")
def j9(spark, d):
    t = _trades(spark, d).withColumn("one", F.lit(1))
    gaps = books.id_gaps(t.filter("a % 7 <> 0"), ["one"], "a")
    return monitor.in_gaps(t.select("one", "a"), gaps, ["one"], "a").groupBy("from_a", "to_a").agg(F.count("*").alias("n_late"))


@query("j8_missing_minutes", f"""WITH {T}, b AS (SELECT DISTINCT symbol, t_ms // {HOUR} * {HOUR} AS open_ms FROM t), e AS (SELECT symbol, min(open_ms) AS lo, max(open_ms) AS hi FROM b GROUP BY symbol),
g AS (SELECT symbol, unnest(range(lo, hi + 1, {HOUR})) AS open_ms FROM e) SELECT symbol, open_ms FROM g ANTI JOIN b USING (symbol, open_ms)""")
def j8(spark, d):
    b = features.bars(_trades(spark, d), HOUR).select("symbol", "open_ms")
    e = b.groupBy("symbol").agg(F.min("open_ms").alias("lo"), F.max("open_ms").alias("hi"))
    g = e.select("symbol", F.explode(F.sequence("lo", "hi", F.lit(HOUR).cast("long"))).alias("open_ms"))
    return g.join(b, ["symbol", "open_ms"], "left_anti")


@query("st3_id_gaps", f"WITH {T}, k AS (SELECT DISTINCT symbol, a // 3 AS a FROM t), g AS (SELECT symbol, lag(a) OVER (PARTITION BY symbol ORDER BY a) + 1 AS from_a, a - 1 AS to_a FROM k) SELECT * FROM g WHERE from_a <= to_a")
def st3(spark, d):
    return books.id_gaps(_trades(spark, d).withColumn("a", F.expr("a div 3")), SYM, "a")


@query("st4_monotone_marks", f"""WITH {T}, m AS (SELECT symbol, a, (t_ms + (a % 5) * 2000000) // 1000000 AS e FROM t), x AS (SELECT *, max(e) OVER (PARTITION BY symbol ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m)
SELECT symbol, CASE WHEN e = top THEN 'duplicate' WHEN e < top THEN 'old' WHEN e - top > 5 THEN 'gap' ELSE 'ok' END AS verdict, count(*) AS n FROM x GROUP BY ALL""")
def st4(spark, d):
    m = _trades(spark, d).withColumn("e", F.expr("(t_ms + (a % 5) * 2000000) div 1000000"))
    return books.monotone_marks(m, SYM, "e", "a", 1).groupBy("symbol", "verdict").agg(F.count("*").alias("n"))


# Features

@query("p_book_features", f"""WITH {B}, f AS (SELECT *, (b0 + a0) / 2 AS mid FROM b) SELECT symbol, u, round(mid, 6) AS mid, round((a0 - b0) / mid * 10000, 6) AS spread_bps, round((bq0 - aq0) / (bq0 + aq0), 6) AS imb1, round((db - da) / (db + da), 6) AS imb20,
round(((b0 * aq0 + a0 * bq0) / (bq0 + aq0) - mid) / mid * 10000, 6) + 0.0 AS micro_bps FROM f""")
def p_book(spark, d):
    f = features.book_features(tables.book(spark, d))
    return f.select("symbol", "u", *[r6(F.col(c), c) for c in ("mid", "spread_bps", "imb1", "imb20", "micro_bps")])


@query("p8_ofi", f"""WITH {B}, l AS (SELECT *, lag(b0) OVER w AS pb, lag(a0) OVER w AS pa, lag(bq0) OVER w AS pbq, lag(aq0) OVER w AS paq FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t_ms, u))
SELECT symbol, u, round(CASE WHEN pb IS NULL THEN 0 ELSE CASE WHEN b0 >= pb THEN bq0 ELSE 0 END - CASE WHEN b0 <= pb THEN pbq ELSE 0 END - CASE WHEN a0 <= pa THEN aq0 ELSE 0 END + CASE WHEN a0 >= pa THEN paq ELSE 0 END END, 6) AS ofi,
round(coalesce(pow((ln((b0 + a0) / 2) - ln((pb + pa) / 2)) * 10000, 2), 0), 3) AS r2 FROM l""")
def p8(spark, d):
    f = features.increments(tables.book(spark, d), SYM, "t_ms", "u")
    return f.select("symbol", "u", r6(F.col("ofi"), "ofi"), r6(F.col("r2"), "r2", 3))


BARS = f"bars AS (SELECT symbol, t_ms // {HOUR} * {HOUR} AS open_ms, arg_min(p, (t_ms, a)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (t_ms, a)) AS close, sum(q) AS volume, sum(p * q) AS quote_volume, count(*) AS n_trades, sum(CASE WHEN side = 'buy' THEN q ELSE 0 END) AS buy_volume FROM t GROUP BY ALL)"


@query("a1_bars", f"WITH {T}, {BARS} SELECT symbol, open_ms, round(open, 5) AS open, round(high, 5) AS high, round(low, 5) AS low, round(close, 5) AS close, round(volume, 4) AS volume, round(quote_volume, 6) AS quote_volume, n_trades, round(buy_volume, 4) AS buy_volume FROM bars")
def a1(spark, d):
    b = features.bars(_trades(spark, d), HOUR)
    return b.select("symbol", "open_ms", "n_trades", *[r6(F.col(c), c, 5) for c in ("open", "high", "low", "close")], *[r6(F.col(c), c, 4) for c in ("volume", "buy_volume")], r6(F.col("quote_volume"), "quote_volume"))


@query("w13_kline_features", f"""WITH {T}, {BARS}, r AS (SELECT *, ln(close / lag(close) OVER w) * 10000 AS r, ln(close / lag(close, 5) OVER w) * 10000 AS ret_5, ln(close / lag(close, 60) OVER w) * 10000 AS ret_60, ln(close / lag(close, 15) OVER w) * 10000 AS ret_15 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_ms)),
r1 AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY open_ms) AS rl FROM r),
s AS (SELECT *, count(*) OVER w15 AS c15, count(*) OVER w14 AS c14, count(*) OVER w30 AS c30, count(*) OVER w60 AS c60, count(*) OVER w5 AS c5, sum(volume) OVER w5 AS v5, sum(buy_volume) OVER w5 AS bv5, sum(coalesce(r * r, 0)) OVER w60 AS rr60,
  avg(volume) OVER w15 AS m15, avg(volume) OVER w60 AS m60, sqrt(greatest(avg(volume * volume) OVER w60 - pow(avg(volume) OVER w60, 2), 0)) AS s60, avg(n_trades) OVER w15 AS k15, avg(n_trades) OVER w60 AS k60, sqrt(greatest(avg(n_trades * n_trades) OVER w60 - pow(avg(n_trades) OVER w60, 2), 0)) AS ks60, sum(coalesce(r * r, 0)) OVER w15 AS rr, sum(coalesce(r * rl, 0)) OVER w15 AS rrl, sum(volume) OVER w30 AS v30, sum(buy_volume) OVER w30 AS bv30, avg(high - low) OVER w15 AS hl,
  sum(quote_volume) OVER w15 AS qv, sum(volume) OVER w15 AS v15, avg(greatest(coalesce(r, 0), 0)) OVER w14 AS up, avg(greatest(-coalesce(r, 0), 0)) OVER w14 AS dn FROM r1
  WINDOW w15 AS (PARTITION BY symbol ORDER BY open_ms ROWS 14 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY open_ms ROWS 13 PRECEDING), w30 AS (PARTITION BY symbol ORDER BY open_ms ROWS 29 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY open_ms ROWS 4 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY open_ms ROWS 59 PRECEDING))
SELECT symbol, open_ms, round(r, 4) AS ret_1, round(ret_15, 4) AS ret_15, CASE WHEN c60 = 60 THEN round(sqrt(rr60), 4) END AS rv_60, CASE WHEN c5 = 5 AND v5 > 0 THEN round(bv5 / v5 - 0.5, 4) + 0.0 ELSE 0 END AS taker_imb_5,
CASE WHEN c60 = 60 AND s60 > 0 THEN round((m15 - m60) / s60, 4) + 0.0 ELSE 0 END AS vol_z_15, CASE WHEN c60 = 60 AND ks60 > 0 THEN round((k15 - k60) / ks60, 4) + 0.0 ELSE 0 END AS trade_z_15, round(ret_5, 4) AS ret_5, round(ret_60, 4) AS ret_60, CASE WHEN c15 = 15 THEN round(sqrt(rr), 4) END AS rv_15, CASE WHEN c30 = 30 AND v30 > 0 THEN round(bv30 / v30 - 0.5, 4) + 0.0 ELSE 0 END AS taker_imb_30,
CASE WHEN c15 = 15 THEN round(hl / close * 10000, 4) END AS range_15, CASE WHEN c15 = 15 THEN round((close / (qv / greatest(v15, 1e-12)) - 1) * 10000, 4) END AS vwap_dev, CASE WHEN c14 = 14 THEN round(100 - 100 / (1 + up / greatest(dn, 1e-12)) - 50, 4) END AS rsi_14,
CASE WHEN c15 = 15 AND rr > 0 THEN round(rrl / rr, 4) ELSE 0 END AS ac_15 FROM s""")
def w13(spark, d):
    k = features.kline_features(features.bars(_trades(spark, d), HOUR))
    return k.select("symbol", "open_ms", *[r6(F.col(c), c, 4) for c in features.KLINE])


@query("a2_median_ratio", f"WITH {T}, {BARS}, x AS (SELECT a.open_ms, a.n_trades / greatest(b.n_trades, 1) AS ratio FROM bars a JOIN bars b ON a.open_ms = b.open_ms AND a.symbol = 'click' AND b.symbol = 'view') SELECT count(*) AS n, round(median(ratio), 6) AS ratio FROM x")
def a2(spark, d):
    b = features.bars(_trades(spark, d), HOUR).select("symbol", "open_ms", "n_trades")
    x = b.filter("symbol = 'click'").join(b.filter("symbol = 'view'").select("open_ms", F.col("n_trades").alias("m")), "open_ms")
    return x.agg(F.count("*").alias("n"), r6(F.median(F.col("n_trades") / F.greatest(F.col("m"), F.lit(1))), "ratio"))


# Models and evaluation

REG = ["l_quantity", "l_discount", "l_tax"]


@query("w11_fold_bounds", f"""WITH {T}, i AS (SELECT t_ms, row_number() OVER (ORDER BY t_ms, a) - 1 AS idx FROM t), n AS (SELECT count(*) AS n FROM i), k AS (SELECT unnest(range(1, 5)) AS k),
b AS (SELECT CAST(k AS INT) AS k, CAST(0 AS BIGINT) AS tr_beg, n * k // 5 AS te_beg, n * (k + 1) // 5 AS te_end FROM n, k), c AS (SELECT b.*, i.t_ms - {HORIZON} AS cut FROM b JOIN i ON i.idx = b.te_beg)
SELECT c.k, tr_beg, te_beg, te_end, cut, count(*) AS n_train FROM c JOIN i ON i.idx < te_beg AND i.t_ms + {HORIZON} <= cut GROUP BY ALL""")
def w11(spark, d):
    return index.fold_bounds(index.global_index(_trades(spark, d), "t_ms", ["a"]), "t_ms", 4, HORIZON, min_train=1)


@query("w10_time_split", f"""WITH {T}, i AS (SELECT t_ms, row_number() OVER (ORDER BY t_ms, a) - 1 AS idx, count(*) OVER () AS n FROM t), e AS (SELECT min(t_ms) FILTER (idx = floor(n * 0.6)) AS ta, min(t_ms) FILTER (idx = floor(n * (0.6 + 0.2))) AS tb FROM i)
SELECT CASE WHEN idx < floor(n * 0.6) THEN CASE WHEN t_ms + {HORIZON} <= ta THEN 'train' END WHEN idx < floor(n * (0.6 + 0.2)) THEN CASE WHEN t_ms + {HORIZON} <= tb THEN 'val' END ELSE 'test' END AS part, count(*) AS n_rows FROM i, e GROUP BY 1""")
def w10(spark, d):
    s = index.time_split(index.global_index(_trades(spark, d), "t_ms", ["a"]), "t_ms", HORIZON)
    return s.groupBy("part").agg(F.count("*").alias("n_rows"))


@query("m1_ridge_simple", """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem),
w AS (SELECT n * c / sx / (n + 10) AS w, mx, sx, my FROM s) SELECT count(*) AS n, round(avg(my + w * greatest(-10, least(10, (l_quantity - mx) / sx))), 3) AS pred_mean, round(min(my + w * greatest(-10, least(10, (l_quantity - mx) / sx))), 3) AS pred_min, round(max(my + w * greatest(-10, least(10, (l_quantity - mx) / sx))), 3) AS pred_max FROM lineitem, w""")
def m1(spark, d):
    li = tables.table(spark, d, "lineitem")
    p = li.withColumn("pred", ridge.fit(li, ["l_quantity"], "l_extendedprice", 10.0).predict())
    return p.agg(F.count("*").alias("n"), r6(F.avg("pred"), "pred_mean", 3), r6(F.min("pred"), "pred_min", 3), r6(F.max("pred"), "pred_max", 3))


@query("m4_walk_forward")
def m4(spark, d):
    """Per-fold score of a three-feature ridge (tested against numpy)."""
    li = tables.table(spark, d, "lineitem").select(*REG, "l_extendedprice", tables.millis("l_shipdate").alias("t_ms"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    i = index.global_index(li, "t_ms", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 30 * DAY)
    i = cut(i)
    bounds = index.fold_bounds(i, "t_ms", 4, DAY, min_train=100).collect()  # one row per fold
    p = ridge.walk_forward(i, bounds, "t_ms", REG, "l_extendedprice", 1.0, DAY)
    return p.groupBy("k").agg(F.count("*").alias("n"), r6(F.corr("l_extendedprice", "pred"), "ic", 4))


@query("a4_score", "SELECT count(*) AS n, round(sqrt(avg(pow(l_extendedprice - 1000 * l_quantity, 2))), 3) AS rmse, round(sqrt(avg(pow(l_extendedprice, 2))), 3) AS rmse_zero, round(corr(l_extendedprice, 1000 * l_quantity), 6) AS ic, round(1 - sqrt(avg(pow(l_extendedprice - 1000 * l_quantity, 2))) / sqrt(avg(pow(l_extendedprice, 2))), 6) AS improvement FROM lineitem")
def a4(spark, d):
    s = stats.score(tables.table(spark, d, "lineitem").withColumn("pred", 1000 * F.col("l_quantity")), "l_extendedprice", "pred")
    return s.select("n", r6(F.col("rmse"), "rmse", 3), r6(F.col("rmse_zero"), "rmse_zero", 3), r6(F.col("ic"), "ic"), r6(F.col("improvement"), "improvement"))


@query("a5_r2_oos", "SELECT round(1 - sum(pow(l_extendedprice - 1000 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem")
def a5(spark, d):
    return stats.r2_oos(tables.table(spark, d, "lineitem").withColumn("pred", 1000 * F.col("l_quantity")), "l_extendedprice", "pred").select(r6(F.col("r2"), "r2"))


@query("a11_histogram", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.001) AS lo, quantile_cont(o_totalprice, 0.999) AS hi FROM orders), c AS (SELECT least(CAST(floor((greatest(least(o_totalprice, hi), lo) - lo) / ((hi - lo) / 41)) AS INT), 40) AS bin, count(*) AS n FROM orders, q GROUP BY 1)
SELECT CAST(b AS INT) AS bin, round(lo + (b + 0.5) * ((hi - lo) / 41), 3) AS center, coalesce(n, 0) AS n FROM range(41) r(b) CROSS JOIN q LEFT JOIN c ON c.bin = b""")
def a11(spark, d):
    return stats.histogram(tables.table(spark, d, "orders"), "o_totalprice").select("bin", r6(F.col("center"), "center", 3), F.col("n").cast("long").alias("n"))


@query("m6_threshold", "SELECT o_orderpriority, round(quantile_cont(abs(o_totalprice - 100000), 0.99), 3) AS threshold FROM orders GROUP BY 1")
def m6(spark, d):
    x = tables.table(spark, d, "orders").withColumn("x", F.abs(F.col("o_totalprice") - 100000))
    return stats.quantiles(x, ["o_orderpriority"], "x", [0.99]).select("o_orderpriority", r6(F.col("value"), "threshold", 3))


@query("a9_by_hour", f"WITH {T} SELECT (t_ms // {HOUR}) % 24 AS hour, count(*) AS n, round(avg(q - 50), 5) AS mean, round(avg(CASE WHEN q > 50 THEN 1.0 ELSE 0.0 END), 5) AS hit, round(avg(q - 50) / (stddev_samp(q) / sqrt(count(*))), 4) AS t_stat FROM t GROUP BY 1 HAVING count(*) >= 3")
def a9(spark, d):
    g = _trades(spark, d).groupBy(F.expr(f"t_ms div {HOUR} % 24").alias("hour"))
    out = g.agg(F.count("*").alias("n"), F.avg(F.col("q") - 50).alias("m"), F.avg((F.col("q") > 50).cast("double")).alias("hit"), F.stddev_samp("q").alias("s")).filter("n >= 3")
    return out.select("hour", "n", r6(F.col("m"), "mean", 5), r6(F.col("hit"), "hit", 5), r6(F.col("m") / (F.col("s") / F.sqrt("n")), "t_stat", 4))


@query("a4_bins", """WITH p AS (SELECT 1000 * l_quantity AS pred, l_extendedprice AS y FROM lineitem), q AS (SELECT unnest(range(1, 10)) AS i, unnest(quantile_cont(pred, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS v FROM p),
b AS (SELECT p.*, (SELECT count(*) FROM q WHERE q.v <= p.pred) AS bin FROM p), g AS (SELECT bin, count(*) AS n, avg(pred) AS pred_mean, avg(y) AS y_mean FROM b GROUP BY bin)
SELECT CAST(s AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(pred_mean, 0), 3) AS pred_mean, round(coalesce(y_mean, 0), 3) AS y_mean FROM range(10) r(s) LEFT JOIN g ON g.bin = s""")
def a4_bins(spark, d):
    li = tables.table(spark, d, "lineitem").select((1000 * F.col("l_quantity")).alias("pred"), "l_extendedprice")
    return stats.score_bins(li, "l_extendedprice", "pred").select("bin", "n", r6(F.col("pred_mean"), "pred_mean", 3), r6(F.col("y_mean"), "y_mean", 3))


def _bootstrap_sql(block: int, replicates: int) -> str:
    """The same resampling in SQL: Poisson numbers from MD5, sums per replicate."""
    terms = " + ".join(f"CASE WHEN u >= exp(-l) * ({' + '.join(f'power(l, {j}) / {math.factorial(j)}' for j in range(k))}) THEN 1 ELSE 0 END" for k in range(1, 13))
    return f"""WITH {T}, e AS (SELECT t_ms // {DAY} AS day, avg(q) AS x FROM t GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM e),
b AS (SELECT i, n, sum(x) OVER w AS s, count(x) OVER w AS m FROM i WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING)), u AS (SELECT *, ceil(n / {block}) / (n - {block} + 1) AS l, unnest(range({replicates})) AS r FROM b WHERE m = {block}),
v AS (SELECT *, CAST('0x' || substr(md5('0:' || i || ':' || r), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM u), k AS (SELECT r, s, {terms} AS k FROM v),
z AS (SELECT r, sum(k * s) / nullif(sum(k) * {block}, 0) AS mean FROM k GROUP BY r)
SELECT (SELECT count(*) FROM e) AS n, (SELECT round(avg(x), 6) FROM e) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM z"""


def _daily(spark, d) -> DataFrame:
    return _trades(spark, d).groupBy(F.expr(f"t_ms div {DAY}").alias("day")).agg(F.avg("q").alias("x"))


@query("a20_bootstrap", _bootstrap_sql(1, 2000))
def a20(spark, d):
    """Bootstrap interval of the mean over daily means, one value a day."""
    b = stats.bootstrap_ci(_daily(spark, d), [], "x", ["day"])
    return b.select("n", *[r6(F.col(c), c) for c in ("mean", "low", "high")])


@query("a21_block_bootstrap", _bootstrap_sql(5, 1000))
def a21(spark, d):
    """The same by blocks of five days in the order of time."""
    b = stats.bootstrap_ci(_daily(spark, d), [], "x", ["day"], replicates=1000, block=5)
    return b.select("n", *[r6(F.col(c), c) for c in ("mean", "low", "high")])


@query("a20_resampled")
def a20r(spark, d):
    """The interval of a20 per symbol over all trades, from exactly as many draws as there are rows (tested against numpy)."""
    b = resample.resampled_ci(_trades(spark, d), SYM, "q", ["t_ms", "a"], replicates=500)
    return b.select("symbol", "n", *[r6(F.col(c), c) for c in ("mean", "low", "high")])


@query("a21_resampled")
def a21r(spark, d):
    """The same by overlapping blocks of five trades, cut to as many as there are (tested against numpy)."""
    b = resample.resampled_ci(_trades(spark, d), SYM, "q", ["t_ms", "a"], replicates=500, block=5)
    return b.select("symbol", "n", *[r6(F.col(c), c) for c in ("mean", "low", "high")])


# Backtest

@query("e1_walk_book", f"""WITH {T}, l AS (SELECT symbol, a AS u, unnest(range(20)) AS i, p, k FROM t), c AS (SELECT symbol, u, i, p + 0.1 * (i + 1) AS px, CAST(1 + (k + 3 * i) % 5 AS DOUBLE) AS q FROM l),
s AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY symbol, u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), f AS (SELECT *, greatest(0, least(q, 25 - before)) AS take FROM s)
SELECT symbol, u, round(sum(take * px) / sum(take), 5) AS vwap, sum(take) AS filled FROM f GROUP BY symbol, u""")
def e1(spark, d):
    b = tables.book(spark, d).withColumn("f", backtest.walk_book("ask_px", "ask_qty", 25))
    return b.select("symbol", "u", r6(F.col("f.vwap"), "vwap", 5), F.col("f.filled").alias("filled"))


def _signals(t: DataFrame) -> DataFrame:
    return t.select("symbol", "t_ms", (F.col("q") - 50).alias("pred"))


def _candidates(spark, d) -> DataFrame:
    """Every trade as a signal."""
    return backtest.feasibility(_signals(_trades(spark, d)), tables.book(spark, d), SYM, 20.0, 1000, HORIZON, HORIZON // 3, 20.0)


def _gated(spark, d) -> DataFrame:
    return backtest.gate(_candidates(spark, d), SYM)


#: Candidates in SQL: every level's quantity is at least 1, so 20 levels always hold the size of 20.
CANDIDATES = f"""{T}, m AS (SELECT symbol, t_ms, arg_max(p, a) AS p, arg_max(k, a) AS k FROM t GROUP BY symbol, t_ms),
s AS (SELECT symbol, t_ms AS sig_t, q - 50 AS pred, t_ms + 1000 AS te, t_ms + 1000 + {HORIZON} AS tx FROM t WHERE abs(q - 50) >= 20),
x AS (SELECT s.*, m.t_ms AS m1, m.p AS p1, m.k AS k1 FROM s ASOF LEFT JOIN m ON s.symbol = m.symbol AND s.te >= m.t_ms), y AS (SELECT x.*, m.t_ms AS m2, m.p AS p2, m.k AS k2 FROM x ASOF LEFT JOIN m ON x.symbol = m.symbol AND x.tx >= m.t_ms),
c AS (SELECT *, row_number() OVER (ORDER BY symbol, sig_t, pred) AS id, CASE WHEN m1 IS NULL OR m2 IS NULL THEN 'no_data' WHEN te - m1 > {HORIZON // 3} OR tx - m2 > {HORIZON // 3} THEN 'stale_book' ELSE 'feasible' END AS reason FROM y)"""
#: The gate in SQL: the earliest feasible signal, then each time the earliest at or after its exit.
GATED = f"""WITH RECURSIVE {CANDIDATES}, ok AS (SELECT symbol, sig_t, tx, id FROM c WHERE reason = 'feasible'),
g AS (SELECT symbol, arg_min(struct_pack(sig_t := sig_t, tx := tx, id := id), id) AS z FROM ok GROUP BY symbol
  UNION ALL SELECT g.symbol, n.z FROM g, LATERAL (SELECT arg_min(struct_pack(sig_t := ok.sig_t, tx := ok.tx, id := ok.id), ok.id) AS z FROM ok WHERE ok.symbol = g.symbol AND ok.sig_t >= g.z.tx) n WHERE n.z IS NOT NULL),
h AS (SELECT symbol, z.sig_t AS from_t, z.tx AS to_t, z.id AS id FROM g),
o AS (SELECT c.*, h.id AS held_id, h.to_t FROM c ASOF LEFT JOIN h ON c.symbol = h.symbol AND c.id >= h.id),
out AS (SELECT *, CASE WHEN held_id = id THEN 'trade' WHEN held_id IS NOT NULL AND sig_t < to_t THEN 'in_position' ELSE reason END AS outcome FROM o)"""


@query("e2_candidates", f"WITH {CANDIDATES} SELECT symbol, reason, count(*) AS n FROM c GROUP BY ALL")
def e2c(spark, d):
    return _candidates(spark, d).groupBy("symbol", F.coalesce("reason", F.lit("feasible")).alias("reason")).agg(F.count("*").alias("n"))


@query("e2_backtest", GATED + " SELECT symbol, outcome, count(*) AS n FROM out GROUP BY ALL")
def e2(spark, d):
    """Outcomes of the sequential gate."""
    return _gated(spark, d).groupBy("symbol", "outcome").agg(F.count("*").alias("n"))


def _level_cost(p: str, k: str, buys: bool) -> str:
    """SQL of the mean price of taking 20 of the ladder of a row with price p and number k."""
    qty = f"(1 + ({k} + 3 * i) % 5)" if buys else f"(1 + ({k} + i) % 7)"
    price = f"({p} + 0.1 * (i + 1))" if buys else f"({p} - 0.1 * i)"
    ahead = f"coalesce(list_sum(list_transform(range(i), lambda j: {qty.replace('i)', 'j)')})), 0)"
    return f"list_sum(list_transform(range(20), lambda i: greatest(0, least({qty}, 20 - {ahead})) * {price})) / 20"


@query("e3_metrics", GATED + f""", f AS (SELECT *, CASE WHEN pred > 0 THEN 1 ELSE -1 END AS side, CASE WHEN pred > 0 THEN {_level_cost('p1', 'k1', True)} ELSE {_level_cost('p1', 'k1', False)} END AS px_in, CASE WHEN pred > 0 THEN {_level_cost('p2', 'k2', False)} ELSE {_level_cost('p2', 'k2', True)} END AS px_out FROM out WHERE outcome = 'trade'),
r AS (SELECT *, side * (px_out - px_in) / px_in * 10000 AS gross, side * (px_out - px_in) / px_in * 10000 - 10 AS net FROM f), q AS (SELECT *, sum(net) OVER w AS cum FROM r WINDOW w AS (PARTITION BY symbol ORDER BY sig_t ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY symbol ORDER BY sig_t ROWS UNBOUNDED PRECEDING)) - cum AS dd FROM q)
SELECT symbol, count(*) AS n, count(*) FILTER (side > 0) AS n_long, count(*) FILTER (side < 0) AS n_short, round(avg(gross), 4) AS gross_mean, round(avg(net), 4) AS net_mean, round(sum(net), 3) AS net_total, round(coalesce(stddev_samp(net), 0), 4) AS net_std,
round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_net, round(max(dd), 3) AS max_drawdown, round(coalesce(avg(net) / nullif(stddev_samp(net), 0), 0), 4) AS sharpe, round((max(tx) - min(sig_t)) / 3600000.0, 5) AS span_h FROM v GROUP BY symbol""")
def e3(spark, d):
    """Metrics of the trades."""
    m = backtest.metrics(backtest.trades_of(_gated(spark, d)), SYM)
    return m.select("symbol", "n", "n_long", "n_short", *[r6(F.col(c), c, 4) for c in ("gross_mean", "net_mean", "net_std", "hit_net", "sharpe")], r6(F.col("net_total"), "net_total", 3), r6(F.col("max_drawdown"), "max_drawdown", 3), r6(F.col("span_h"), "span_h", 5))


@query("e5_maker_bound", GATED + f""", f AS (SELECT *, CASE WHEN pred > 0 THEN 1 ELSE -1 END AS side, CASE WHEN pred > 0 THEN {_level_cost('p1', 'k1', True)} ELSE {_level_cost('p1', 'k1', False)} END AS px_in, CASE WHEN pred > 0 THEN {_level_cost('p2', 'k2', False)} ELSE {_level_cost('p2', 'k2', True)} END AS px_out FROM out WHERE outcome = 'trade')
SELECT symbol, count(*) AS n, round(avg(side * (px_out - px_in) / px_in) * 10000, 4) AS gross_mean, round(avg(side * (px_out - px_in) / px_in) * 10000 - 10, 4) AS net_taker, round(avg(side * (px_out - px_in) / px_in) * 10000 - 4, 4) AS net_maker FROM f GROUP BY symbol""")
def e5(spark, d):
    c = backtest.costs(backtest.trades_of(_gated(spark, d)), SYM)
    return c.select("symbol", "n", *[r6(F.col(x), x, 4) for x in ("gross_mean", "net_taker", "net_maker")])


def _messages(spark, d) -> DataFrame:
    """Synthetic depth messages of every symbol: one per trade, after a snapshot."""
    t = _trades(spark, d)
    n = carry.positions(t, SYM, "a", [], "i", 1 << 18).withColumn("i", F.col("i") + 1)
    tick = lambda x: F.format_string("%.1f", x.cast("double"))
    body = F.to_json(F.struct(F.col("i").alias("U"), F.col("i").alias("u"), (F.col("i") - 1).alias("pu"), F.array(F.array(tick(F.floor("p") - F.col("k") % 7), F.format_string("%.3f", F.col("q")))).alias("bids"), F.array(F.array(tick(F.floor("p") + 20 + F.col("k") % 5), F.lit("1.000"))).alias("asks")))
    kinds = F.when(F.col("i") == 1, F.array(F.lit("snapshot"), F.lit("depth"))).otherwise(F.array(F.lit("depth")))
    return n.select("symbol", F.lit("s0").alias("session"), F.explode(kinds).alias("kind"), F.col("i").alias("recv"), body.alias("body"))


@query("st1_book_replay")
def st1(spark, d):
    """Replay of the messages, rows per symbol (tested against plain dictionaries as sides)."""
    return books.replay(_messages(spark, d)).groupBy("symbol", "session").agg(F.count("*").alias("n"), F.max("epoch").alias("epochs"), F.max("u").alias("last_u"))


@query("v1_replay_twice", "SELECT event_type AS symbol, 's0' AS session, count(*) AS n, TRUE AS same FROM events GROUP BY 1")
def v1(spark, d):
    """Two replays, of messages that come in another order, give the same rows."""
    a, b = books.replay_digest(books.replay(_messages(spark, d))), books.replay_digest(books.replay(_messages(spark, d).repartition(5)))
    b = b.select("symbol", "session", F.col("n").alias("__n"), F.col("digest").alias("__d"))
    return a.join(b, ["symbol", "session"], "full_outer").select("symbol", "session", "n", ((F.col("n") == F.col("__n")) & (F.col("digest") == F.col("__d"))).alias("same"))


@query("v2_replay_diff", "WITH n AS (SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS u FROM events) SELECT symbol, CASE WHEN u % 5 = 0 THEN 'only_left' WHEN u % 7 = 0 THEN 'mismatched' ELSE 'matched' END AS status, count(*) AS n FROM n GROUP BY ALL")
def v2(spark, d):
    """Replayed rows against a store that lacks some and has others changed."""
    r = books.replay(_messages(spark, d))
    stored = r.filter("u % 5 <> 0").withColumn("bid_qty", F.when(F.col("u") % 7 == 0, F.array(F.lit(-1.0))).otherwise(F.col("bid_qty")))
    return books.replay_against(r, stored).groupBy("symbol", "status").agg(F.count("*").alias("n"))


@query("o3_last_trades", f"WITH {T} SELECT symbol, a, t_ms FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY a DESC) <= 50")
def o3(spark, d):
    """The last 50 trades of each symbol by id."""
    w = Window.partitionBy("symbol").orderBy(F.desc("a"))
    return _trades(spark, d).withColumn("__r", F.row_number().over(w)).filter("__r <= 50").select("symbol", "a", "t_ms")


@query("q4_quality_page", f"WITH {T} SELECT symbol, a, CASE WHEN k % 10 = 0 THEN 'error' ELSE 'info' END AS severity FROM t WHERE k % 10 = 0 ORDER BY t_ms DESC, a DESC LIMIT 200")
def q4(spark, d):
    """The 200 latest records of one severity."""
    e = _trades(spark, d).withColumn("severity", F.when(F.col("k") % 10 == 0, "error").otherwise("info")).filter("severity = 'error'")
    return e.orderBy(F.desc("t_ms"), F.desc("a")).limit(200).select("symbol", "a", "severity")


@query("fd_times", f"WITH {T} SELECT a, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(make_timestamp(t_ms * 1000), '%Y%m%d') AS day FROM t")
def fd(spark, d):
    """Milliseconds as ISO text, nanoseconds as a day."""
    return _trades(spark, d).select("a", tables.iso(F.col("t_ms")).alias("iso"), tables.day_of_ns(F.col("t_ms") * 1_000_000).alias("day"))
