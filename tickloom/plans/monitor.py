"""Queries of a feed's quality, each beside its DuckDB oracle.

Events stand in for a feed's records: their types are symbols, their users
sessions, and the numbers in props decide what became of a record.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backfill, monitor
from ..sources import tables
from ..sources.shared import fresh
from .catalog import DAY, HOUR, SYM, T, query, r6


def _trades(spark, d):
    return tables.trades(spark, d)


@query("p15_aggressor", f"WITH {T} SELECT symbol, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 THEN 'sell' ELSE 'buy' END AS aggressor, count(*) AS n FROM t GROUP BY ALL")
def p15(spark, d):
    maker = F.when(F.col("k") % 3 != 0, F.col("k") % 2 == 0)
    return _trades(spark, d).withColumn("aggressor", monitor.aggressor(maker)).groupBy("symbol", "aggressor").agg(F.count("*").alias("n"))


@query("fv_validated", f"WITH {T} SELECT CASE WHEN k % 5 = 0 AND q < 50 THEN 'late,small' WHEN k % 5 = 0 THEN 'late' WHEN q < 50 THEN 'small' END AS error, count(*) AS n FROM t GROUP BY 1")
def fv(spark, d):
    rules = {"late": F.nullif(F.col("k") % 5, F.lit(0)) > 0, "small": F.col("q") >= 50}
    return monitor.validated(_trades(spark, d), rules).groupBy("error").agg(F.count("*").alias("n"))


#: A record of each trade as JSON text, some of them damaged: an expression that Spark and DuckDB read alike.
_BODY = " || ".join([
    "'{\"u\": '", "CASE WHEN a % 11 = 0 THEN 'true' WHEN a % 13 = 0 THEN '\"' || CAST(a AS VARCHAR(20)) || '\"' ELSE CAST(a AS VARCHAR(20)) END",
    "', \"U\": ' || CASE WHEN a % 29 = 0 THEN CAST(a + 9 AS VARCHAR(20)) WHEN a % 31 = 0 THEN '1.5' ELSE CAST(a AS VARCHAR(20)) END",
    "CASE WHEN a % 19 = 0 THEN '' WHEN a % 17 = 0 THEN ', \"p\": 100.5' ELSE ', \"p\": \"100.5\"' END",
    "CASE WHEN a % 23 = 0 THEN '' ELSE '}' END",
])


@query("f_valid_json", f"""WITH {T}, j AS (SELECT symbol, {_BODY} AS body FROM t), v AS (SELECT symbol, body, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body END AS b FROM j),
k AS (SELECT symbol, ok, coalesce(json_type(b, '$.u') IN ('BIGINT', 'UBIGINT'), FALSE) AS u, coalesce(json_type(b, '$.U') IN ('BIGINT', 'UBIGINT'), FALSE) AS f, coalesce(json_type(b, '$.p') = 'VARCHAR', FALSE) AS p, CAST(json_extract_string(b, '$.U') AS DOUBLE) AS nf, TRY_CAST(json_extract_string(b, '$.u') AS DOUBLE) AS nu FROM v)
SELECT symbol, CASE WHEN NOT ok THEN 'unparseable' ELSE concat_ws(',', CASE WHEN NOT u THEN 'u_not_integer' END, CASE WHEN NOT f THEN 'U_not_integer' END, CASE WHEN NOT p THEN 'p_not_text' END, CASE WHEN u AND f AND nf > nu THEN 'U_above_u' END) END AS reasons, count(*) AS n FROM k GROUP BY ALL""")
def fvj(spark, d):
    """Faults of JSON records by the types of their own values: whole numbers, prices as text, ids in order."""
    body = _trades(spark, d).select("symbol", F.expr(_BODY).alias("body"))
    reasons = monitor.faults(F.col("body"), ["u", "U"], ["p"], [("U", "u")])
    return body.select("symbol", F.array_join(reasons, ",").alias("reasons")).groupBy("symbol", "reasons").agg(F.count("*").alias("n"))


@query("a16_counters", f"""WITH {T}, r AS (SELECT *, CASE k % 6 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'old' WHEN 2 THEN 'parse_error' WHEN 3 THEN 'invalid' ELSE 'accepted' END AS o, CASE WHEN k % 6 <> 2 THEN t_ms - 150 END AS ex FROM t)
SELECT symbol, count(*) AS received, count(*) FILTER (o = 'accepted') AS accepted, count(*) FILTER (o = 'duplicate') AS duplicates, count(*) FILTER (o = 'old') AS old_or_out_of_order, count(*) FILTER (o = 'parse_error') AS parse_errors, count(*) FILTER (o = 'invalid') AS invalid_values,
min(t_ms) AS first_recv, max(t_ms) AS last_recv, arg_max(ex, t_ms) FILTER (ex IS NOT NULL) AS last_exchange FROM r GROUP BY symbol""")
def a16(spark, d):
    m = F.col("k") % 6
    outcome = F.when(m == 0, "duplicate").when(m == 1, "old").when(m == 2, "parse_error").when(m == 3, "invalid").otherwise("accepted")
    r = _trades(spark, d).select("symbol", F.col("t_ms").alias("recv"), F.when(m != 2, F.col("t_ms") - 150).alias("exchange"), outcome.alias("outcome"))
    return monitor.counters(r, SYM)


@query("a18_clock_summary", f"""WITH {T}, s AS (SELECT symbol, t_ms * 1000000 AS sent, t_ms * 1000000 + (1 + k) * 1000000 AS received, t_ms + k // 2 + a % 7 AS server, a FROM t),
o AS (SELECT *, (received - sent) / 1000000.0 AS rtt, server - (sent // 2 + received // 2) / 1000000.0 AS ofs, row_number() OVER (PARTITION BY symbol ORDER BY received DESC, sent DESC) AS r FROM s), l AS (SELECT symbol, list_sort(list(ofs)) AS os, min(rtt) AS m, arg_max(sent, received) AS ls, arg_max(rtt, received) AS lr, arg_max(ofs, received) AS lo FROM o WHERE r <= 20 GROUP BY symbol)
SELECT l.symbol, n AS samples, ls AS last_sent, round(lr, 3) AS last_rtt_ms, round(lo, 3) AS last_offset_ms, round(os[1 + len(os) // 2], 3) AS offset_median_ms, round(m, 3) AS rtt_min_ms FROM l JOIN (SELECT symbol, count(*) AS n FROM t GROUP BY symbol) USING (symbol)""")
def a18(spark, d):
    s = _trades(spark, d).select("symbol", (F.col("t_ms") * 1_000_000).alias("sent"), (F.col("t_ms") * 1_000_000 + (1 + F.col("k")) * 1_000_000).alias("received"), (F.col("t_ms") + F.expr("k div 2") + F.col("a") % 7).alias("server"))
    c = monitor.clock_summary(s, SYM)
    return c.select("symbol", "samples", "last_sent", *[r6(F.col(x), x, 3) for x in ("last_rtt_ms", "last_offset_ms", "offset_median_ms", "rtt_min_ms")])


def _versions(spark, d):
    """Versions of gaps: an event is one, its user's number the gap."""
    e = _trades(spark, d).join(tables.table(spark, d, "events").select(F.col("event_id").alias("a"), "user_id"), "a")
    status = F.when(F.col("k") % 4 == 0, "repaired").when(F.col("k") % 4 == 1, "partial").otherwise("open")
    return e.select(F.col("user_id").cast("string").alias("gap_id"), "symbol", F.lit("aggTrade").alias("stream"), F.when(F.col("k") % 2 == 0, "aggtrade_id").otherwise("downtime").alias("kind"), status.alias("repair_status"), (F.col("t_ms") * 1_000_000).alias("start_time_ns"), ((F.col("t_ms") + F.col("k") * 1000) * 1_000_000).alias("end_time_ns"), F.concat(F.lit("r"), F.col("k") % 3).alias("reason"), F.when(F.col("k") % 9 != 0, F.col("t_ms")).alias("update_time_ns"), F.col("a").alias("position"))


V = f"""{T}, v AS (SELECT CAST(user_id AS VARCHAR) AS gap_id, t.symbol, 'aggTrade' AS stream, CASE WHEN k % 2 = 0 THEN 'aggtrade_id' ELSE 'downtime' END AS kind, CASE k % 4 WHEN 0 THEN 'repaired' WHEN 1 THEN 'partial' ELSE 'open' END AS repair_status, t_ms * 1000000 AS s, (t_ms + k * 1000) * 1000000 AS e, 'r' || (k % 3) AS reason, CASE WHEN k % 9 <> 0 THEN t_ms END AS upd, a FROM t JOIN events ON events.event_id = t.a),
g AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY gap_id ORDER BY coalesce(upd, 0) DESC, a) = 1)"""


@query("st7_gap_registry", f"WITH {V} SELECT symbol, stream, kind, repair_status, count(*) AS n, round(max((e - s) / 1e9), 6) AS longest_s, arg_max(reason, struct_pack(d := (e - s) / 1e9, g := gap_id)) AS reason FROM g GROUP BY ALL")
def st7(spark, d):
    return monitor.gap_summary(_versions(spark, d)).withColumn("longest_s", F.round("longest_s", 6))


@query("q3_gaps", f"WITH {V} SELECT gap_id, symbol, kind, repair_status FROM g WHERE repair_status <> 'repaired' ORDER BY s DESC, gap_id LIMIT 300")
def q3(spark, d):
    """The 300 latest gaps that aren't repaired."""
    g = monitor.gap_states(_versions(spark, d)).filter("repair_status <> 'repaired'")
    return g.orderBy(F.desc("start_time_ns"), "gap_id").limit(300).select("gap_id", "symbol", "kind", "repair_status")


@query("st8_backfill", f"""WITH {T}, k AS (SELECT DISTINCT symbol, a FROM t WHERE k % 3 <> 0), g AS (SELECT symbol, lag(a) OVER (PARTITION BY symbol ORDER BY a) + 1 AS from_a, a - 1 AS to_a FROM k), h AS (SELECT * FROM g WHERE from_a <= to_a), n AS (SELECT h.symbol, from_a, to_a, count(*) AS n FROM h JOIN t ON t.symbol = h.symbol AND t.a BETWEEN from_a AND to_a GROUP BY ALL)
SELECT h.symbol, h.from_a, h.to_a, h.to_a - h.from_a + 1 AS n_missing, coalesce(n, 0) AS n_filled, CASE WHEN n = h.to_a - h.from_a + 1 THEN 'repaired' WHEN n > 0 THEN 'partial' ELSE 'unrepairable' END AS repair_status FROM h LEFT JOIN n ON n.symbol = h.symbol AND n.from_a = h.from_a""")
def st8(spark, d):
    """Gaps between the ids that a feed kept, filled from the recorded trades."""
    from ..streaming import book

    t = _trades(spark, d)
    return monitor.filled_gaps(book.id_gaps(t.filter("k % 3 <> 0"), SYM, "a"), t, SYM, "a")[0]


def _after(n: int, page: str) -> str:
    """SQL of a gap's state after round n, whose page of ids is the list `page` (one id a page, two pages a round)."""
    was = f"s{n - 1}"
    return f"""s{n} AS (SELECT feed, from_a, to_a, start_t, {was}.had || CASE WHEN {was}.open AND NOT far THEN {page} ELSE [] END AS had, {was}.attempts + CAST({was}.open AS BIGINT) AS attempts,
  {was}.pages + CASE WHEN {was}.open AND NOT far THEN least(2, len({page}) + CASE WHEN coalesce(list_max({page}), -1) < to_a THEN 1 ELSE 0 END) ELSE 0 END AS pages, far, x, y, z,
  CASE WHEN NOT {was}.open THEN status WHEN far THEN 'unrepairable' WHEN len({was}.had || {page}) = to_a - from_a + 1 THEN 'repaired' WHEN {n} >= 3 OR len({page}) + CASE WHEN coalesce(list_max({page}), -1) < to_a THEN 1 ELSE 0 END >= 2 THEN CASE WHEN len({was}.had || {page}) > 0 THEN 'partial' ELSE 'unrepairable' END ELSE 'open' END AS status, status = 'open' AS open FROM {was})"""


def _rounds_sql() -> str:
    """Three rounds over gaps of a feed: each finds what its source has by then."""
    out = f"""WITH {T}, m AS (SELECT max(t_ms) AS now FROM t), f AS (SELECT 'f' || (a // 1000) AS feed, a, k, t_ms FROM t), kp AS (SELECT feed, lag(a) OVER w + 1 AS from_a, a - 1 AS to_a, lag(t_ms) OVER w AS start_t FROM f WHERE k % 3 <> 0 WINDOW w AS (PARTITION BY feed ORDER BY a)),
g AS (SELECT * FROM kp WHERE from_a <= to_a), s0 AS (SELECT g.feed, from_a, to_a, start_t, CAST([] AS BIGINT[]) AS had, 0 AS attempts, 0 AS pages, start_t IS NOT NULL AND any_value(now) - start_t >= {20 * DAY} AS far, coalesce(list_sort(list(a) FILTER (a % 3 = 0)), []) AS x, coalesce(list_sort(list(a) FILTER (a % 3 < 2)), []) AS y, coalesce(list_sort(list(a)), []) AS z, 'open' AS status, TRUE AS open
  FROM g JOIN f ON f.feed = g.feed AND f.a BETWEEN from_a AND to_a, m GROUP BY g.feed, from_a, to_a, start_t)"""
    for n, ids in enumerate("xyz", 1):
        was = f"s{n - 1}"
        out += f", p{n} AS (SELECT *, list_filter({ids}, lambda i: NOT list_contains(had, i))[1:2] AS page FROM (SELECT * REPLACE (status = 'open' AS open) FROM {was})), " + _after(n, "page").replace(f"FROM {was})", f"FROM p{n})").replace(f"{was}.", "")
    return out + " SELECT feed, from_a, to_a, attempts, pages, CAST(len(had) AS BIGINT) AS n_filled, status FROM s3"


@query("st8_backfill_rounds", _rounds_sql())
def st8_rounds(spark, d):
    """Three rounds of backfill, of one-row pages and two pages a round, from a source that has more each time."""
    from ..streaming import book

    f = _trades(spark, d).select(F.concat(F.lit("f"), F.expr("a div 1000")).alias("feed"), "a", "k", "t_ms")
    kept = f.filter("k % 3 <> 0")
    start = kept.select("feed", (F.col("a") + 1).alias("from_a"), F.col("t_ms").alias("start_t"))
    gaps = book.id_gaps(kept, ["feed"], "a").join(start, ["feed", "from_a"])
    now = f.agg(F.max("t_ms")).first()[0] or 0
    run = backfill.Backfill(fresh(spark, "backfill"), ["feed"], "a", page=1, pages=2, attempts=3, reach=20 * DAY)
    run.start(gaps)
    for there in ("a % 3 = 0", "a % 3 < 2", "a % 3 < 3"):
        run.step(f.filter(there), now)
    return run.gaps(spark).select("feed", "from_a", "to_a", "attempts", "pages", "n_filled", "status")


@query("st9_downtime", f"""WITH {T}, s AS (SELECT symbol, t_ms // {DAY} AS session, min(t_ms) AS t0, max(t_ms) AS t1, arg_min(a, struct_pack(t := t_ms, a := a)) AS f, max(a) AS l FROM t GROUP BY ALL), d AS (SELECT symbol, t0 AS to_t, f AS next_id, lag(t1) OVER w AS from_t, lag(l) OVER w AS prev_id, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY symbol ORDER BY t0))
SELECT symbol, from_t, to_t, prev_id, next_id, greatest(next_id - prev_id - 1, 0) AS n_missing, CASE WHEN next_id - prev_id - 1 > 0 THEN 'ids_missing' ELSE 'no_id_missing' END AS status FROM d WHERE r > 1""")
def st9(spark, d):
    return monitor.downtime(_trades(spark, d).withColumn("session", F.expr(f"t_ms div {DAY}")), SYM, "a", "session", "t_ms")


@query("q1_freshness", f"WITH {T}, m AS (SELECT max(t_ms) AS now FROM t), l AS (SELECT symbol, max(t_ms) AS last FROM t GROUP BY symbol) SELECT symbol, last, now - last AS age, now - last < {4 * HOUR // 10} AS alive, now - last > {6 * HOUR // 10} AS stale FROM l, m")
def q1(spark, d):
    t = _trades(spark, d)
    now = t.agg(F.max("t_ms").alias("now"))
    last = t.groupBy("symbol").agg(F.max("t_ms").alias("t_ms")).join(F.broadcast(now))  # one row
    return monitor.freshness(last, ["symbol", "now"], "t_ms", F.col("now"), HOUR // 10).drop("now")


@query("q10_health", f"""WITH {T}, c AS (SELECT symbol, unnest(['late', 'disk', 'book']) AS reason, unnest([max(k) > 98, max(q) > 99.99, min(q) < 0.05]) AS failed FROM t GROUP BY symbol),
h AS (SELECT symbol, CASE WHEN max(failed AND reason = 'disk') THEN 'failed' WHEN max(failed) THEN 'degraded' ELSE 'ok' END AS level, coalesce(string_agg(CASE WHEN failed THEN reason END, ',' ORDER BY reason), '') AS reasons FROM c GROUP BY symbol)
SELECT symbol, level, reasons, CASE level WHEN 'ok' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END AS code, upper(level) || ' age=5s reasons=' || reasons AS line FROM h""")
def q10(spark, d):
    g = _trades(spark, d).groupBy("symbol").agg(F.max("k").alias("k"), F.max("q").alias("hi"), F.min("q").alias("lo"))
    check = lambda name, failed, fatal=False: F.struct(F.lit(name).alias("reason"), failed.alias("failed"), F.lit(fatal).alias("fatal"))
    checks = g.select("symbol", F.inline(F.array(check("late", F.col("k") > 98), check("disk", F.col("hi") > 99.99, True), check("book", F.col("lo") < 0.05))))
    return monitor.health_line(monitor.health(checks, SYM), SYM, F.lit(5), 60.0)


@query("s5_union", "SELECT o_orderkey AS key, o_totalprice AS price, NULL AS qty FROM orders UNION ALL SELECT l_orderkey, NULL, l_quantity FROM lineitem")
def s5(spark, d):
    """Two tables with different columns, one after the other."""
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    li = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("qty"))
    return monitor.unioned([o, li])
