"""Every query against its oracle, and the others against small loops."""

import re

import numpy as np
import pytest
from conftest import DATA, same

from tickloom.plans import registry

Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    same(Q[name](spark, DATA), SQL[name])


#: Queries that SQL can't express, and the tests that compare them.
PLAIN = {"a20_resampled": "test_resampled", "a21_resampled": "test_resampled", "m4_walk_forward": "test_walk_forward", "st1_book_replay": "test_replay_query", "m5_nested": "test_research.py", "m8_scan": "test_research.py", "m9_fixed_hours": "test_fixed.py", "m9_fixed_parts": "test_fixed.py", "m9_stability": "test_research.py", "e4_report": "test_research.py"}


def test_all_compared():
    assert set(Q) - set(SQL) == set(PLAIN)


def test_walk_forward(spark):
    """m4 against numpy: folds of the row order, ridge of the rows that end a purge ahead, scores of the test rows."""
    import duckdb

    from tickloom.plans import catalog as c

    rows = duckdb.sql(f"SELECT l_quantity, l_discount, l_tax, l_extendedprice, epoch_ms(CAST(l_shipdate AS TIMESTAMP)) AS t FROM '{DATA}/lineitem.parquet' ORDER BY t, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice").fetchall()
    data = np.array(rows, float)
    x, y, t, n = data[:, :3], data[:, 3], data[:, 4], len(data)
    got = {r.k: r for r in Q["m4_walk_forward"](spark, DATA).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for k, r in got.items():
        a, b = n * k // 5, n * (k + 1) // 5
        train = np.flatnonzero((np.arange(n) < a) & (t + c.DAY <= t[a] - c.DAY))
        mean, std = x[train].mean(0), x[train].std(0)
        z = (x[train] - mean) / std
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[train] - y[train].mean()))
        pred = np.clip((x[a:b] - mean) / std, -10, 10) @ w + y[train].mean()
        assert r.n == b - a and r.ic == pytest.approx(np.corrcoef(pred, y[a:b])[0, 1], abs=1e-4)


def test_replay_query(spark):
    """st1 against one loop over each symbol's messages with plain dictionaries as sides."""
    import duckdb

    rows = duckdb.sql(f"SELECT event_type, event_id, 100 + value / 100, CAST(json_extract(props, '$.k') AS BIGINT) FROM '{DATA}/events.parquet' ORDER BY 1, 2").fetchall()
    want, sides = {}, {}
    for symbol, _, p, k in rows:
        n, last, epoch, i, live = want.get(symbol, (0, None, 1, 0, True))
        bids, asks = sides.setdefault(symbol, ({}, {}))
        i += 1
        bids[int(p // 1) - k % 7] = 1
        asks[int(p // 1) + 20 + k % 5] = 1
        assert max(bids) < min(asks)
        want[symbol] = (n + 1, i, epoch, i, True)
    got = {r.symbol: (r.n, r.last_u, r.epochs) for r in Q["st1_book_replay"](spark, DATA).collect()}
    assert got == {s: w[:3] for s, w in want.items()}


def _resampled_loop(x, block, replicates, bucket, seed=0):
    """Means of n draws, dealt by recursion down to buckets, every drawn row (or block) added up by itself."""
    n, out = len(x), np.zeros(replicates)
    units, pieces = n - block + 1, -(-n // block)

    def split(lo, hi, draws, part, length):
        if hi - lo == 1:
            size = min(bucket, units - lo * bucket)
            rng = np.random.default_rng([seed, part, lo, 1 << 40])
            for r in range(replicates):
                if draws[r]:
                    for at in rng.integers(0, size, draws[r]):
                        out[r] += sum(x[lo * bucket + at : lo * bucket + at + length])
            return
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, part, lo, hi]).binomial(draws, (mid - lo) * bucket / (min(hi * bucket, units) - lo * bucket))
        split(lo, mid, left, part, length)
        split(mid, hi, draws - left, part, length)

    split(0, -(-units // bucket), np.full(replicates, pieces - (block > 1)), 0, block)
    if block > 1:
        split(0, -(-units // bucket), np.full(replicates, 1), 1, n - block * (pieces - 1))
    return out / n


def test_resampled(spark):
    """Against the same split by recursion, for buckets smaller than a key; its spread against numpy's own draws; and both queries."""
    import duckdb

    from tickloom.functions import resample

    rng = np.random.default_rng(5)
    x = {"a": rng.normal(3, 2, 400), "b": rng.exponential(1, 37), "c": np.array([2.0, 4.0, 9.0]), None: rng.normal(size=60)}
    df = spark.createDataFrame([(k, i, float(v)) for k, xs in x.items() for i, v in enumerate(xs)] + [("a", 9999, None)], "k string, t int, x double").repartition(5)
    for block, bucket in ((1, 64), (1, 7), (5, 16), (5, 1000), (4, 3)):
        got = {r.k: r for r in resample.resampled_ci(df, ["k"], "x", ["t"], 120, 0, block, bucket).collect()}
        for k, xs in x.items():
            assert got[k].n == len(xs) and got[k].mean == pytest.approx(xs.mean())
            if block > 1 and len(xs) <= block:
                assert got[k].low is None and got[k].high is None
                continue
            means = _resampled_loop(xs, block, 120, bucket)
            assert (got[k].low, got[k].high) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
    whole = resample.resampled_ci(df.filter("k = 'a'"), [], "x", ["t"], 2000, bucket=50).first()
    own = x["a"][rng.integers(0, 400, (2000, 400))].mean(axis=1)
    assert (whole.low, whole.high) == (pytest.approx(np.quantile(own, 0.025), abs=0.04), pytest.approx(np.quantile(own, 0.975), abs=0.04))
    assert all(r.low == r.high == 1 for r in resample.resampled_ci(df.withColumn("x", df.x * 0 + 1), ["k"], "x", ["t"], 50, bucket=9).filter("n > 1").collect())  # n draws, no more or less
    assert resample.resampled_ci(df.limit(0), ["k"], "x", ["t"]).collect() == []
    rows = duckdb.sql(f"SELECT event_type, value FROM '{DATA}/events.parquet' ORDER BY event_type, ts, event_id").fetchall()
    for name, block in (("a20_resampled", 1), ("a21_resampled", 5)):
        for r in Q[name](spark, DATA).collect():
            own = np.array([v for s, v in rows if s == r.symbol])
            means = _resampled_loop(own, block, 500, resample.BUCKET)
            assert r.n == len(own) and (r.low, r.high) == (pytest.approx(np.quantile(means, 0.025), abs=1e-5), pytest.approx(np.quantile(means, 0.975), abs=1e-5))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_walk_book(spark):
    from pyspark.sql import functions as F

    from tickloom.operators.backtest import walk_book

    df = spark.createDataFrame([([], []), ([7.0, 7.5, 9.0, 9.5], [4.0, 0.0, 3.0, 8.0]), ([40.0, 38.0], [2.0, 5.0]), ([3.0, None], [None, 2.0])], "p array<double>, q array<double>")
    got = [(r.f.vwap, r.f.filled) for r in df.select(walk_book("p", "q", 9.0).alias("f")).collect()]
    assert got == [(None, 0.0), (pytest.approx((4 * 7 + 3 * 9 + 2 * 9.5) / 9), 9.0), (pytest.approx((80 + 190) / 7), 7.0), (None, 0.0)]


def test_gate(spark):
    from tickloom.operators.backtest import gate

    rows = [("s", 1000, 1.0, 1, 1100, 4100, 10.0, 11.0, None), ("s", 2000, 1.0, 1, 2100, 5100, 10.0, 11.0, "thin_book"), ("s", 4000, 1.0, 1, 4100, 7100, 10.0, 11.0, "stale_book"), ("s", 4100, 1.0, 1, 4200, 7200, 10.0, 11.0, None)]
    df = spark.createDataFrame(rows, "symbol string, sig_t long, pred double, side int, entry_t long, exit_t long, in_px double, out_px double, reason string")
    got = [r.outcome for r in gate(df, ["symbol"]).orderBy("sig_t").collect()]
    assert got == ["trade", "in_position", "in_position", "trade"]  # the signal at 4000 comes before the exit at 4100


def _gate_loop(rows):
    """(key, sig, entry, exit, ok) in order of time: whether each is held."""
    free, out = {}, []
    for key, sig, entry, leave, ok in sorted(rows, key=lambda r: (r[0] or "", *r[1:4], not r[4])):
        held = sig < free.get(key, -(2**62))
        if ok and not held:
            free[key] = leave
        out.append((key or "", sig, entry, leave, ok, held))
    return sorted(out)


def test_gate_buckets(spark):
    """Buckets shorter and longer than the hold, entries out of order, a null key: as one plain loop."""
    import random

    from tickloom.operators import backtest, timealign

    rng = random.Random(5)
    rows = []
    for key in ("a", "b", None):
        for _ in range(250):
            sig = rng.randint(-300, 3000)
            entry = sig + rng.randint(0, 40)
            rows.append((key, sig, entry, entry + rng.randint(0, 120), rng.random() < 0.6))
    df = spark.createDataFrame(rows, "symbol string, sig_t long, entry_t long, exit_t long, ok boolean").selectExpr("*", "1.0D AS pred", "1 AS side", "1.0D AS in_px", "1.0D AS out_px", "CASE WHEN NOT ok THEN 'thin_book' END AS reason")
    for bucket in (3, 20, 10_000):
        got = backtest.gate(df, ["symbol"], bucket).collect()
        assert sorted((r.symbol or "", r.sig_t, r.entry_t, r.exit_t, r.outcome in ("trade",), r.outcome == "in_position") for r in got if r.outcome != "in_position") == sorted((k, a, e, x, ok, h) for k, a, e, x, ok, h in _gate_loop(rows) if not h)
        assert len(got) == len(rows)
        want, last = [], {}
        for key, t in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] or "", x[1])):
            if key not in last or t >= last[key] + 90:
                last[key] = t
                want.append((key or "", t))
        kept = timealign.greedy_nonoverlap(df, ["symbol"], "sig_t", 90, bucket).collect()
        assert sorted((r.symbol or "", r.sig_t) for r in kept) == want


def test_quantile_rounds(spark):
    """Ranges narrowed over several rounds: heavy values, ties, infinities, null keys; as numpy ranks them."""
    import random

    from tickloom.functions import stats

    rng = random.Random(4)
    values = {"a": [rng.gauss(0, 1) ** 7 for _ in range(3000)], "b": [float(rng.choice([1, 1, 1, 2, 3])) for _ in range(2500)], "c": [5.0] * 900, None: [rng.random() * 10 ** rng.randint(-9, 9) for _ in range(2000)], "d": [1.0, 2.0], "e": [float("-inf"), 0.0, 7.0, float("inf")] * 300}
    shares = [0.0, 0.001, 0.25, 0.5, 0.9999, 1.0]
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in [*x, None]], "k string, x double").repartition(6)
    for ranked in (3, 40, 500, 50_000):
        got = {(r.k, r.share): (r.value, r.n) for r in stats.quantiles(df, ["k"], "x", shares, ranked).collect()}
        assert len(got) == len(values) * len(shares)
        for k, x in values.items():
            for s in shares:
                value, n = got[k, s]
                a, z = (sorted(x)[int(f((len(x) - 1) * s))] for f in (np.floor, np.ceil))
                want = a + (z - a) * ((len(x) - 1) * s - np.floor((len(x) - 1) * s)) if a != z else a
                assert n == len(x) and (value == pytest.approx(want, rel=1e-12) or (np.isinf(a) and not np.isfinite(value)))
    one = {r.share: r.value for r in stats.quantiles(df.filter("k = 'a'"), [], "x", [0.1, 0.5], 100).collect()}
    assert one == {s: pytest.approx(np.quantile(values["a"], s)) for s in (0.1, 0.5)}
    assert stats.quantiles(df.limit(0), ["k"], "x", [0.5]).collect() == []


def test_carried_nulls(spark):
    """Rows with a null key or time keep their place in segments, positions and sums; none is lost."""
    from tickloom.operators import carry, index, timealign

    rows = [("s", 5, 1), ("s", 900, 2), (None, 3, 3), ("s", None, 4), (None, None, 5), (None, 700, 6)]
    d = spark.createDataFrame(rows, "k string, t long, i int")
    want = {1: (0, 1), 2: (1, 2), 3: (0, 1), 4: (0, 0), 5: (0, 0), 6: (1, 2)}
    seg = {r.i: r.segment for r in timealign.segments(d, ["k"], "t", "i", 50).collect()}
    pos = {r.i: r.idx for r in carry.positions(d, ["k"], "t", ["i"], "idx", 100).collect()}
    assert {i: (seg[i], pos[i]) for i in want} == want
    assert [r.i for r in index.global_index(d, "t", ["i"], 100).orderBy("idx").collect()] == [4, 5, 3, 1, 6, 2]
    hit = timealign.asof_backward(d.filter("i in (2, 6)"), d.withColumnRenamed("i", "j").filter("t < 10"), ["k"], "t", "j", ["j"], 100)
    assert {r.i: r.j for r in hit.collect()} == {2: 1, 6: 3}


def test_gate_size(spark):
    """No row of the gate's plan holds a key's rows as an array, and gaps aren't one window over all ids."""
    from tickloom.operators import timealign
    from tickloom.streaming import book

    t = spark.createDataFrame([("a", 1), ("a", 5), ("a", 90), ("a", 91), ("b", 3)], "symbol string, a long")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    gated = timealign.greedy_nonoverlap(t, ["symbol"], "a", 2)
    assert "collect_list" not in plan(gated) and gated.count() == 4
    groups = re.findall(r"FlatMapGroupsInArrow \[([^\]]*)\]", plan(gated))
    assert groups and all(g.startswith("symbol") and "__b" in g for g in groups)  # by key and block, never by key
    for bucket in (1, 3, 64, 1 << 18):
        assert sorted(tuple(r) for r in book.id_gaps(t, ["symbol"], "a", bucket).collect()) == [("a", 2, 4), ("a", 6, 89)]
    assert "__b" in plan(book.id_gaps(t, ["symbol"], "a"))


def test_replay_batches(spark):
    """A key's messages come in several batches, and its rows are those of one loop."""
    import json

    from tickloom.streaming import book

    def body(u):
        return json.dumps({"U": u, "u": u, "pu": u - 1, "bids": [[f"{50 + u % 9}.0", "1.000"]], "asks": [["101.0", "2.000"]]})

    rows = [(s, "s0", kind, u, body(u)) for s in ("x", "y", None) for u in range(1, 60) for kind in (["snapshot", "depth"] if u == 1 else ["depth"])]
    m = spark.createDataFrame(rows, "symbol string, session string, kind string, recv long, body string")
    one = book.Book()
    outs = [(u, o) for s, _, kind, u, b in rows if s == "x" for o in (one.snapshot if kind == "snapshot" else one.event)(json.loads(b) | {"recv": u})]
    want = [(1, u, u, flags, *ladders) for u, (kind, flags, ladders) in outs if kind == "row"]
    sliced = book.replay(m, slice_rows=50)  # the book goes from one slice of time to the next
    for s in ("x", "y", None):
        assert sorted(tuple(r)[2:] for r in sliced.collect() if r.symbol == s) == sorted(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = book.replay(m)
        assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
        for s in ("x", "y", None):
            assert [tuple(r)[2:] for r in got.collect() if r.symbol == s] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _outcomes_loop():
    """Outcomes and trades of every trade as a signal, by a plain loop in time order."""
    import bisect
    import collections

    import duckdb

    from tickloom.plans import catalog as c

    rows = duckdb.sql(f"SELECT event_type, epoch_us(ts) // 1000, event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) FROM '{DATA}/events.parquet' ORDER BY 1, 2, 3").fetchall()
    books, counts, trades = collections.defaultdict(list), collections.Counter(), collections.defaultdict(list)
    for symbol, t, _, q, k in rows:
        books[symbol].append((t, 100 + q / 100, k))

    def fill(p, k, buys, size=20.0):
        left, cost = size, 0.0
        for i in range(20):
            px, qty = (p + 0.1 * (i + 1), 1 + (k + 3 * i) % 5) if buys else (p - 0.1 * i, 1 + (k + i) % 7)
            take = min(left, qty)
            left, cost = left - take, cost + take * px
        return cost / size if left <= 0 else None

    for symbol, b in books.items():
        times, free = [x[0] for x in b], -1
        for t, p, _ in b:
            q = (p - 100) * 100 - 50
            if abs(q) < 20:
                continue
            a, z = t + 1000, t + 1000 + c.HORIZON
            i, j = (bisect.bisect_right(times, x) - 1 for x in (a, z))
            if t < free:
                outcome = "in_position"
            elif a - times[i] > c.HORIZON // 3 or z - times[j] > c.HORIZON // 3:
                outcome = "stale_book"
            else:
                px, out = fill(b[i][1], b[i][2], q > 0), fill(b[j][1], b[j][2], q < 0)
                outcome = "thin_book" if px is None or out is None else "trade"
                if outcome == "trade":
                    free = z
                    trades[symbol].append((1 if q > 0 else -1) * (out - px) / px * 1e4 - 10)
            counts[symbol, outcome] += 1
    return counts, trades


def test_backtest_all_signals(spark):
    counts, trades = _outcomes_loop()
    assert {(r.symbol, r.outcome): r.n for r in Q["e2_backtest"](spark, DATA).collect()} == dict(counts)
    got = {r.symbol: r for r in Q["e3_metrics"](spark, DATA).collect()}
    assert set(got) == set(trades)
    for symbol, net in trades.items():
        assert got[symbol].n == len(net) and got[symbol].net_total == pytest.approx(sum(net), abs=1e-3)


def test_ridge(spark):
    from tickloom.operators import ridge

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([(*map(float, r), 0.0119, float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double")
    m = ridge.fit(df, ["a", "b", "c", "d"], "y", 1.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(m.weights, [*w, 0.0]) and m.degenerate == ["d"]
    assert [c for c, _ in m.coefficients()][:2] == ["b", "a"]


def test_segments_and_dedup(spark):
    from tickloom.operators import dedup, timealign

    t = spark.createDataFrame([("s", x, i) for i, x in enumerate([0, 10, 20, 100, 110, 300])], "k string, t long, i int")
    assert [r.segment for r in timealign.segments(t, ["k"], "t", "i", 50).orderBy("t").collect()] == [0, 0, 0, 1, 1, 2]
    d = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("b", None, 3)], "k string, o int, v int")
    assert sorted(r.v for r in dedup.keep_first(d, ["k"], ["o"]).collect()) == [2, 3]


def _event(first, last, prev, bid="100.0", recv=None, qty="1.000"):
    return {"U": first, "u": last, "pu": prev, "recv": last if recv is None else recv, "bids": [[bid, qty]], "asks": [["101.0", "2.000"]]}


def _kinds(out):
    return [(k, r) for k, r, _ in out]


def test_book_states():
    from tickloom.streaming.book import Book, to_units

    b = Book()
    assert b.event(_event(1, 2, 0)) == [] and b.state == "SYNCING"
    assert _kinds(b.snapshot({"u": 2, "bids": [["99.0", "1.000"]], "asks": []})) == [("state", "synced"), ("row", "first_after_snapshot")]
    assert _kinds(b.snapshot({"u": 2, "bids": [], "asks": []})) == [("dropped", "snapshot_while_not_syncing")]
    out = b.event(_event(3, 3, 2))
    assert _kinds(out) == [("row", "")] and out[0][2] == ([100.0, 99.0], [1.0, 1.0], [101.0], [2.0])
    assert _kinds(b.event(_event(3, 3, 2))) == [("dropped", "duplicate")]
    assert _kinds(b.event(_event(3, 3, 2, qty="7.000"))) == [("conflict", "same_u_different_content")]
    assert _kinds(b.event(_event(1, 1, 0))) == [("dropped", "old")] and b.state == "LIVE"
    assert _kinds(b.event(_event(9, 9, 8))) == [("state", "pu_mismatch")] and b.state == "INVALID"
    assert _kinds(b.event(_event(10, 10, 9))) == [("dropped", "book_invalid")]
    b.resync()
    assert b.event(_event(10, 10, 9)) == [] and b.epoch == 1
    with pytest.raises(ValueError):
        to_units("1.05", "0.1")


def test_book_sync_order():
    from tickloom.streaming.book import Book

    b = Book()
    b.event(_event(5, 6, 4))
    assert _kinds(b.snapshot({"u": 3, "bids": [], "asks": []})) == [("need_snapshot", "snapshot_older_than_buffer")] and b.state == "SYNCING"
    b.event(_event(9, 9, 8))
    assert _kinds(b.snapshot({"u": 6, "bids": [], "asks": []})) == [("state", "synced"), ("row", "first_after_snapshot"), ("state", "pu_mismatch_during_sync")]
    early = Book()
    assert early.snapshot({"u": 4, "bids": [["99.0", "1.000"]], "asks": [["102.0", "1.000"]]}) == []  # waits for an event
    assert early.event(_event(2, 3, 1)) == [] and _kinds(early.event(_event(4, 5, 3))) == [("state", "synced"), ("row", "first_after_snapshot")]
    full = Book(buffer=2)
    for u in (1, 2):
        full.event(_event(u, u, u - 1))
    assert _kinds(full.event(_event(3, 3, 2))) == [("need_snapshot", "buffer_overflow")] and full.waiting == []


def test_book_bad_messages():
    from tickloom.streaming.book import Book

    b = Book()
    b.event(_event(1, 1, 0))
    assert _kinds(b.snapshot({"u": 1, "bids": [["99.05", "1.000"]], "asks": []})) == [("state", "snapshot_parse_error")] and b.state == "INVALID"
    b = Book()
    b.event(_event(1, 1, 0))
    b.snapshot({"u": 1, "bids": [], "asks": []})
    assert _kinds(b.event(_event(2, 2, 1, bid="100.01"))) == [("state", "event_parse_error")]
    b = Book()
    b.event(_event(1, 1, 0, bid="102.0"))
    assert _kinds(b.snapshot({"u": 1, "bids": [], "asks": []})) == [("state", "synced"), ("state", "crossed_book")]


def test_book_coverage_and_silence():
    from tickloom.streaming.book import Book

    b = Book(top=2, stale_after=10)
    b.event(_event(1, 1, 0))
    snap = {"u": 1, "limit": 2, "bids": [["99.0", "1.000"], ["98.0", "1.000"]], "asks": [["102.0", "1.000"], ["103.0", "1.000"]]}
    assert _kinds(b.snapshot(snap))[-1] == ("row", "first_after_snapshot")  # 100 and 99 lie above the snapshot's floor
    assert b.check_stale(11) == [] and _kinds(b.check_stale(12)) == [("state", "no_depth_event")] and b.state == "STALE"
    assert _kinds(b.event(_event(2, 2, 1, recv=13))) == [("row", "resumed_after_stale")] and b.state == "LIVE"
    gone = {"U": 3, "u": 3, "pu": 2, "recv": 14, "bids": [["100.0", "0"], ["99.0", "0"], ["97.0", "1.000"]], "asks": []}
    assert _kinds(b.event(gone)) == [("state", "top_levels_coverage_unconfirmed")]  # 98 is known, what lies between it and 97 isn't


def test_id_gaps_state():
    from tickloom.streaming import book

    ids = book.IdGaps()
    assert [ids.take(a) for a in (5, 6, 6, 10, 8, 8, 7, 9, 11)] == ["ok", "ok", None, "gap", "late", None, "late", "late", "ok"] and ids.gaps == []
    assert ids.take(10**9) == "gap" and len(ids.gaps) == 1 and ids.take(12) is None and ids.take(10**9 - 5) == "late"


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "symbol string, session string, kind string, recv long, body string"


def _depth(u, pu=None, bid="50.0", qty="1.000", ask="101.0"):
    import json

    return json.dumps({"e": "depthUpdate", "E": u, "T": u, "s": "x", "U": u, "u": u, "pu": u - 1 if pu is None else pu, "b": [[bid, qty]], "a": [[ask, "2.000"]]})


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _streamed(spark, df, at, name):
    q = df.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/c{name}").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.read.parquet(f"{at}/{name}").collect()


def test_streams(spark, tmp_path, rocks):
    """The streaming forms give, over several micro-batches and a restart from the checkpoint, what the batch forms give."""
    import json

    from tickloom.streaming import book

    rows = [("x", "s0", "depth", u, _depth(u, bid=f"{50 + u % 9}.0")) for u in range(1, 40) if u != 20]
    rows.insert(3, ("x", "s0", "snapshot", 3, json.dumps({"lastUpdateId": 2, "bids": [["49.0", "1.000"]], "asks": []})))
    rows.insert(30, ("x", "s0", "snapshot", 30, json.dumps({"lastUpdateId": 25, "bids": [["49.0", "1.000"]], "asks": [["99.0", "1.000"]]})))
    for half in (rows[:17], rows[17:]):  # each half is a query of its own, which goes on where the last one stopped
        for i in range(0, len(half), 9):
            spark.createDataFrame(half[i : i + 9], MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
        source = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/m")
        got = _streamed(spark, book.stream_replay(source), tmp_path, "books")
    want = book.replay(spark.createDataFrame(rows, MESSAGE)).collect()
    assert len(got) > 30 and {r.epoch for r in got} == {1, 2} and sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in want)
    spark.createDataFrame([("x", a) for a in (1, 2, 2, 7, 5)], "symbol string, a long").coalesce(1).write.parquet(f"{tmp_path}/a")
    ids = _streamed(spark, book.stream_id_gaps(spark.readStream.schema("symbol string, a long").parquet(f"{tmp_path}/a")), tmp_path, "ids")
    assert [(r.a, r.verdict) for r in ids] == [(1, "ok"), (2, "ok"), (7, "gap"), (5, "late")]


def test_stream_gaps(spark, tmp_path, rocks):
    """Silence alone makes a book stale; a gap has one version per cause, is made certain, and closes with the next valid book."""
    import json
    import time

    from tickloom.operators import dedup
    from tickloom.streaming import book

    def write(*rows):
        spark.createDataFrame([("x", "s0", *r) for r in rows], MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")

    snap = lambda u: json.dumps({"lastUpdateId": u, "bids": [["49.0", "1.000"]], "asks": []})
    write(("depth", 1, _depth(1)))
    source = spark.readStream.schema(MESSAGE).parquet(f"{tmp_path}/m")
    q = book.stream_depth(source, stale_ms=1500, resync_ms=200).writeStream.format("memory").queryName("gaps_of").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()

    def until(condition, seconds=60):
        end = time.time() + seconds
        while time.time() < end:
            assert q.exception() is None
            if spark.sql("SELECT * FROM gaps_of").filter(condition).count():
                return
            time.sleep(0.3)
        raise AssertionError(condition)

    try:
        until("kind = 'request'")  # a message is held, and no snapshot has come
        write(("snapshot", 2, snap(1)), ("depth", 3, _depth(2)))
        until("kind = 'row' AND u = 2")
        until("kind = 'state' AND reason = 'no_depth_event'")  # nothing was written
        write(("depth", 9, _depth(9)))
        until("kind = 'state' AND reason = 'pu_mismatch'")
        write(("depth", 10, _depth(10)), ("snapshot", 11, snap(10)), ("depth", 12, _depth(11)))
        until("kind = 'row' AND u = 11")
        write(("depth", 13, "not json"))
        until("kind = 'state' AND reason = 'event_unparseable'")
    finally:
        q.stop()
    gaps = spark.sql("SELECT * FROM gaps_of WHERE kind = 'gap'")
    first = gaps.filter("gap_id LIKE '%no_depth_event'").orderBy("version").collect()
    assert [(r.version, r.certainty, r.status) for r in first] == [(0, "suspected", "open"), (1, "certain", "open"), (2, "certain", "not_applicable")]
    assert first[0].gap_kind == "depth_stale" and first[1].note == "then pu_mismatch" and (first[0].prev_u, first[2].next_u) == (2, 10)
    last = {r.gap_id.split(":")[-1]: r.status for r in dedup.keep_last(gaps, ["gap_id"], ["version"]).collect()}
    assert last == {"no_depth_event": "not_applicable", "event_unparseable": "open"}


def test_readable():
    """Wire and own forms; whatever is damaged is None."""
    import json

    from tickloom.streaming.book import readable

    wire = json.loads(_depth(5))
    assert readable("depth", json.dumps(wire))["bids"] == [["50.0", "1.000"]] == readable("depth", json.dumps({"stream": "x@depth", "data": wire}))["bids"]
    for change in ({"u": True}, {"u": "5"}, {"U": 6}, {"E": 1.5}, {"b": "x"}, {"pu": None}):
        assert readable("depth", json.dumps(wire | change)) is None
    for text in ("", "{", "[]", "3", "null", json.dumps({k: v for k, v in wire.items() if k != "T"}), json.dumps({k: v for k, v in wire.items() if k != "a"})):
        assert readable("depth", text) is None and readable("snapshot", text) is None
    assert readable("snapshot", json.dumps({"lastUpdateId": 4, "bids": [], "asks": []})) == {"u": 4, "bids": [], "asks": [], "limit": None}
    assert readable("snapshot", json.dumps({"bids": [], "asks": []})) is None


def test_replay_log_and_diff(spark):
    import json

    from tickloom.streaming import book

    def row(u, kind="depth", pu=None, bid="50.0"):
        return ("x", "s0", kind, u, json.dumps({"U": u, "u": u, "pu": u - 1 if pu is None else pu, "bids": [[bid, "1.000"]], "asks": [["101.0", "2.000"]]}))

    rows = [row(1, "snapshot"), row(1), row(2), row(2, bid="51.0"), row(5), row(6, "snapshot"), row(6), row(7)]
    m = spark.createDataFrame(rows, "symbol string, session string, kind string, recv long, body string")
    log = sorted((r.recv, r.kind, r.reason) for r in book.replay_log(m).collect())
    assert log == [(1, "state", "synced"), (2, "conflict", "same_u_different_content"), (5, "state", "pu_mismatch"), (6, "state", "synced")]
    a = book.replay(m)
    assert book.replay_digest(a).collect() == book.replay_digest(book.replay(m)).collect() and a.count() == 4
    assert {r.status: r.n for r in book.replay_against(a, a.filter("u <> 7")).groupBy("status").count().withColumnRenamed("count", "n").collect()} == {"matched": 3, "only_left": 1}


def test_days_and_store(spark, tmp_path):
    from tickloom.sources import tables

    assert tables.days_between("2026-02-27", "20260301") == ["20260227", "20260228", "20260301"]
    with pytest.raises(ValueError):
        tables.days_between("2026-02-02", "2026-02-01")
    rows = [("S", "20260101", 0, 1, 10, 1, True), ("S", "20260101", 0, 1, 10, 2, True), ("S", "20260102", 0, 3, 20, 3, False), ("S", "20260103", 1, 4, 30, 4, True)]
    tables.write_normalized(spark.createDataFrame(rows, "symbol string, day string, book_epoch long, u long, T_ms long, recv_seq long, is_valid boolean"), f"{tmp_path}/book_top20")
    got = tables.load(spark, str(tmp_path), "book_top20", "S", "20260101", "20260102", ["u", "recv_seq"], valid_only=True)
    assert [tuple(r) for r in got.collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        tables.load(spark, str(tmp_path), "nope", "S", "20260101", "20260102")
