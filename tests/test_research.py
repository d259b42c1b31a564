"""Nested selection against a plain numpy loop."""

import numpy as np
import pytest
from conftest import DATA, same

from tickloom.operators import research
from tickloom.plans import registry


def plain_nested(t, x, y, horizon, n_folds, shares, expanding=True, min_train=500, least=(500, 200), alphas=research.ALPHAS):
    """Folds (k, alpha, share, threshold, n_train, n_test, n_trades, mean, hit, ic) and trades (t, return) of one key."""

    def ridge(rows, alpha):
        mean, std = x[rows].mean(0), x[rows].std(0)
        flat = x[rows].min(0) == x[rows].max(0)
        z = (x[rows] - mean) / np.where(flat, 1.0, std)
        z[:, flat] = 0
        w = np.zeros(x.shape[1])
        w[~flat] = np.linalg.solve(z[:, ~flat].T @ z[:, ~flat] + alpha * np.eye((~flat).sum()), z[:, ~flat].T @ (y[rows] - y[rows].mean()))
        return lambda of: y[rows].mean() + np.clip((x[of] - mean) / np.where(flat, 1.0, std), -10, 10) @ w

    def traded(pred, of, threshold):
        out, free = [], -1
        for p, i in zip(pred, of):
            if abs(p) >= threshold and t[i] >= free:
                out.append((t[i], np.sign(p) * y[i], p))
                free = t[i] + horizon
        return out

    n, folds, trades, kept = len(t), [], [], 0
    edges = [n * i // (n_folds + 1) for i in range(n_folds + 2)]
    for k in range(n_folds):
        a, b, c = (0 if expanding else edges[k]), edges[k + 1], edges[k + 2]
        train = np.array([i for i in range(a, b) if t[i] + horizon <= t[b] - horizon])
        if len(train) < min_train:
            continue
        kept += 1
        at = int(len(train) * 0.8)
        val = train[at:]
        fit = np.array([i for i in train[:at] if t[i] + horizon <= t[val[0]]])
        if len(fit) < least[0] or len(val) < least[1]:
            continue
        best = None
        for alpha in alphas:
            pred = ridge(fit, alpha)(val)
            for share in shares:
                got = [x[1] for x in traded(pred, val, np.quantile(abs(pred), share))]
                if len(got) >= 5 and (best is None or np.mean(got) > best[0] + 1e-12):
                    best = (np.mean(got), alpha, share)
        if best is None:
            continue
        model, test = ridge(train, best[1]), np.arange(b, c)
        level, pred = np.quantile(abs(model(train)), best[2]), model(test)
        got = traded(pred, test, level)
        r = [x[1] for x in got]
        folds.append((kept - 1, best[1], best[2], level, len(train), len(test), len(r), np.mean(r) if r else None, np.mean(np.array(r) > 0) if r else None, np.corrcoef(pred, y[test])[0, 1]))
        trades += got
    return folds, trades


def _compare(found, trades, want):
    assert len(found) == sum(len(f) for f, _ in want.values()) > 0
    for r in found:
        w = next(f for f in want[r.symbol][0] if f[0] == r.k)
        assert (r.alpha, r.share, r.n_train, r.n_test, r.n_trades) == (w[1], w[2], w[4], w[5], w[6])
        assert r.threshold == pytest.approx(w[3], rel=1e-6) and r.ic == pytest.approx(w[9], abs=1e-6)
        assert (r.mean_bps, r.hit) == ((None, None) if w[7] is None else (pytest.approx(w[7], abs=1e-6), pytest.approx(w[8])))
    got = sorted((r.symbol, r.t_ms, round(r.ret, 6)) for r in trades)
    assert got == sorted((s, int(t), round(float(r), 6)) for s, (_, x) in want.items() for t, r, _ in x)


@pytest.fixture(scope="module")
def made(spark):
    rng, rows = np.random.default_rng(8), []
    for s, n in (("a", 2600), ("b", 1500)):
        t = np.cumsum(rng.choice([100, 100, 100, 700], n))
        x = np.column_stack([rng.normal(size=(n, 3)), np.full(n, 0.1)])
        y = x[:, 0] * 0.7 - x[:, 1] * 0.2 + rng.normal(size=n) * 2
        rows += [(s, int(a), *map(float, b), float(c)) for a, b, c in zip(t, x, y)]
    return rows, spark.createDataFrame(rows, "symbol string, t_ms long, a double, b double, c double, d double, y double").repartition(5)


@pytest.mark.parametrize("expanding", [True, False])
def test_nested(made, expanding):
    rows, df = made
    kw = {"n_folds": 3, "shares": (0.8, 0.95), "min_train": 300, "least": (200, 60), "expanding": expanding}
    found, trades = research.nested(df, ["symbol"], ["a", "b", "c", "d"], "y", 1000, **kw)
    want = {}
    for s in ("a", "b"):
        own = np.array([r[1:] for r in rows if r[0] == s])
        want[s] = plain_nested(own[:, 0].astype(int), own[:, 1:5], own[:, 5], 1000, **kw)
    _compare(found.collect(), trades.collect(), want)


def test_scales(spark):
    """Columns of one key that are 10^8 times those of another don't change the other's model (sums are shifted per key)."""
    rng, rows = np.random.default_rng(6), []
    for s, base in (("big", 1e8), ("small", 20.0)):
        x = np.column_stack([base + rng.normal(size=900), rng.normal(size=900)])
        y = (x[:, 0] - base) - 0.5 * x[:, 1] + rng.normal(size=900)
        rows += [(s, i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "symbol string, idx long, a double, b double, y double")
    bounds = spark.createDataFrame([(s, 0, 0, 700) for s in ("big", "small")], "symbol string, k int, lo long, hi long")
    got = {r.symbol: r for r in research.models(df, bounds, {"full": ("lo", "hi")}, ["symbol"], ["a", "b"], "y", (1.0,)).collect()}
    for s in ("big", "small"):
        own = np.array([r[2:] for r in rows if r[0] == s])[:700]
        x, y = own[:, :2], own[:, 2]
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
        assert got[s].weights == pytest.approx(w, rel=1e-6) and got[s].stds == pytest.approx(x.std(0), rel=1e-6) and got[s].means == pytest.approx(x.mean(0))


def _book_loop(signals, book, size=20.0, delay=1000, fee=10.0):
    """Outcomes and net returns of one symbol's signals (t, pred) over its book rows (t, p, k), one after the other."""
    import bisect
    import collections

    from tickloom.plans import research as plans

    times, free, outcomes, net = [x[0] for x in book], -1, collections.Counter(), []

    def fill(p, k, buys):
        left, cost = size, 0.0
        for i in range(20):
            px, qty = (p + 0.1 * (i + 1), 1 + (k + 3 * i) % 5) if buys else (p - 0.1 * i, 1 + (k + i) % 7)
            take = min(left, qty)
            left, cost = left - take, cost + take * px
        return cost / size if left <= 0 else None

    for t, pred in sorted(signals):
        a, z, side = t + delay, t + delay + plans.HORIZON, 1 if pred > 0 else -1
        i, j = (bisect.bisect_right(times, x) - 1 for x in (a, z))
        if t < free:
            outcome = "in_position"
        elif i < 0 or j < 0:
            outcome = "no_data"
        elif a - times[i] > plans.HORIZON // 3 or z - times[j] > plans.HORIZON // 3:
            outcome = "stale_book"
        else:
            px, out = fill(*book[i][1:], side > 0), fill(*book[j][1:], side < 0)
            outcome = "thin_book" if px is None or out is None else "trade"
            if outcome == "trade":
                free = z
                net.append(side * (out - px) / px * 1e4 - fee)
        outcomes[outcome] += 1
    return outcomes, net


@pytest.fixture(scope="module")
def loops(spark):
    """What a numpy loop over the queries' dataset, and a loop over the book, give: per query."""
    import duckdb

    from tickloom.plans import research as plans

    data = plans._micro(spark, DATA, plans.ONE)
    rows = data.select("symbol", "t_ms", *plans.COLUMNS, "y_bps", "mid").orderBy("symbol", "t_ms").collect()
    books = {}
    for s, t, p, k in duckdb.sql(f"SELECT event_type, epoch_us(ts) // 1000 AS t, 100 + value / 100, CAST(json_extract(props, '$.k') AS BIGINT) FROM '{DATA}/events.parquet' ORDER BY 1, 2, event_id").fetchall():
        books.setdefault(s, []).append((t, p, k))
    want, ahead, stable, backtests = {}, {}, {}, {}
    shares = plans.NESTED["shares"]
    for s in {r.symbol for r in rows}:
        own = np.array([r[1:] for r in rows if r.symbol == s], float)
        t, x, y0 = own[:, 0].astype(int), own[:, 1:-2], own[:, -2]
        want[s], chosen = plain_nested(t, x, y0, plans.HORIZON, 4, shares)
        backtests[s] = _book_loop([(int(a), p) for a, _, p in chosen], books[s])
        for kind, n in (("expanding", 4), ("expanding", 6), ("rolling", 4)):
            stable[s, kind, n] = plain_nested(t, x, y0, plans.HORIZON, n, shares, kind == "expanding", 300, (300, 100))
        h = 2 * plans.STEP
        mid = dict(zip(t, own[:, -1]))
        y = np.array([(mid[a + h] / mid[a] - 1) * 1e4 if a + h in mid else np.nan for a in t])
        ok = np.isfinite(y)
        folds, trades = plain_nested(t[ok], x[ok], y[ok], h, 4, shares)
        r = np.array([x[1] for x in trades])
        ahead[s] = (int(ok.sum()), len(folds), sum(f[9] > 0 for f in folds), len(r), r.mean(), np.mean([f[9] for f in folds]), r.mean() / (r.std(ddof=1) / np.sqrt(len(r))))
    return want, ahead, stable, backtests


def test_query_nested(spark, loops):
    want = loops[0]
    got = registry.queries()["m5_nested"](spark, DATA).collect()
    assert len(got) == sum(map(len, want.values())) > 0
    for r in got:
        w = next(f for f in want[r.symbol] if f[0] == r.k)
        assert (r.alpha, r.share, r.n_train, r.n_test, r.n_trades) == (w[1], w[2], w[4], w[5], w[6]) and r.ic == pytest.approx(w[9], abs=1e-3)


def test_query_scan(spark, loops):
    from tickloom.plans import research as plans

    ahead, h = loops[1], 2 * plans.STEP
    for r in registry.queries()["m8_scan"](spark, DATA).filter(f"horizon = {h}").collect():
        w = ahead[r.symbol]
        assert (r.samples, r.folds, r.ic_positive, r.n_trades) == w[:4]
        assert (r.mean_bps, r.ic_mean, r.t_stat) == (pytest.approx(w[4], abs=1e-2), pytest.approx(w[5], abs=1e-3), pytest.approx(w[6], abs=1e-2)) and r.net_bps == pytest.approx(r.mean_bps - 4, abs=2e-3)
        assert (r.low is None) == (r.n_trades <= 5) and (r.low is None or r.low <= r.mean_bps <= r.high)


def test_query_stability(spark, loops):
    stable = loops[2]
    got = registry.queries()["m9_stability"](spark, DATA).collect()
    assert {(r.symbol, r.kind, r.n_folds) for r in got} == {k for k, (folds, _) in stable.items() if folds} != set()
    for r in got:
        folds, trades = stable[r.symbol, r.kind, r.n_folds]
        x = np.array([v[1] for v in trades])
        assert (r.folds, r.ic_positive, r.n_trades) == (len(folds), sum(f[9] > 0 for f in folds), len(x))
        assert len(x) < 3 or (r.mean_bps, r.hit, r.t_stat) == (pytest.approx(x.mean(), abs=2e-3), pytest.approx((x > 0).mean(), abs=2e-3), pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(len(x))), abs=1e-2))


def test_query_report(spark, loops):
    want, backtests = loops[0], loops[3]
    got = {r.symbol: r for r in registry.queries()["e4_report"](spark, DATA).collect()}
    assert set(got) == {s for s, w in want.items() if w}
    for s, r in got.items():
        outcomes, net = backtests[s]
        assert (r.folds, r.ic_positive, r.n_signals, r.n or 0) == (len(want[s]), sum(f[9] > 0 for f in want[s]), sum(outcomes.values()), outcomes["trade"])
        assert r.ic_mean == pytest.approx(np.mean([f[9] for f in want[s]]), abs=1e-3)
        if net:
            run = np.cumsum(net)
            assert r.net_total == pytest.approx(sum(net), abs=1e-2) and r.net_taker == pytest.approx(np.mean(net), abs=2e-3) and r.net_maker == pytest.approx(np.mean(net) + 6, abs=2e-3)
            assert r.max_drawdown == pytest.approx(max(np.maximum(np.maximum.accumulate(run), 0) - run), abs=1e-2)


def test_segments_at_scale(spark):
    """Datasets over events with many gaps inside symbols."""
    for name in ("b1_micro_segments", "j6_label_segment"):
        sf = "/root/testdata/sf0.01"
        same(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


def test_stability_and_report(spark, made):
    """The summaries over folds, hours and costs are those of the folds and trades that they come from."""
    from pyspark.sql import functions as F

    rows, df = made
    kw = {"shares": (0.8, 0.95), "min_train": 300, "least": (200, 60)}
    cols = ["a", "b", "c", "d"]
    got = {(r.symbol, r.kind): r for r in research.stability(df, ["symbol"], cols, "y", 1000, (3,), (3,), **kw).collect()}
    for s in ("a", "b"):
        own = np.array([r[1:] for r in rows if r[0] == s])
        for kind in ("expanding", "rolling"):
            folds, trades = plain_nested(own[:, 0].astype(int), own[:, 1:5], own[:, 5], 1000, 3, (0.8, 0.95), kind == "expanding", 300, (200, 60))
            if not folds:
                assert (s, kind) not in got
                continue
            r, x = got[s, kind], np.array([x[1] for x in trades])
            assert (r.folds, r.n_trades, r.ic_positive) == (len(folds), len(x), sum(f[9] > 0 for f in folds))
            assert r.mean_bps == pytest.approx(x.mean()) and r.hit == pytest.approx((x > 0).mean()) and r.t_stat == pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(len(x))))
    t = spark.createDataFrame([("s", h * 3_600_000 + i, float(i - 1)) for h, m in ((1, 4), (2, 2), (25, 1)) for i in range(m)], "symbol string, t_ms long, ret double")
    assert [tuple(r) for r in research.by_hour(t, ["symbol"]).orderBy("hour").collect()] == [("s", 1, 5, 0.2, 0.4)]
    gated = spark.createDataFrame([("s", 10, 20, 50, 1.0, 1, 100.0, 101.0, "trade"), ("s", 30, 40, 60, 1.0, 1, 1.0, 1.0, "in_position"), ("s", 90, 95, 150, -1.0, -1, 100.0, 100.5, "trade")], "symbol string, sig_t long, entry_t long, exit_t long, pred double, side int, in_px double, out_px double, outcome string")
    found = spark.createDataFrame([("s", 0, 0.2, 0.1, 100, 10), ("s", 1, -0.1, 0.0, 200, 20)], "symbol string, k int, ic double, r2 double, n_train long, n_test long")
    r = research.report(found, gated, ["symbol"]).first()
    assert (r.folds, r.ic_positive, r.n_test, r.n_signals, r.skipped_in_position, r.n, r.n_long) == (2, 1, 30, 3, 1, 2, 1)
    assert r.gross_mean == pytest.approx(25.0) and r.net_taker == pytest.approx(15.0) and r.net_maker == pytest.approx(21.0) and r.span_h == pytest.approx(140 / 3_600_000)
    e = research.equity(gated, ["symbol"]).orderBy("sig_t").select("net_bps", "cum_bps").collect()
    assert [x.cum_bps for x in e] == pytest.approx([90.0, 30.0])
