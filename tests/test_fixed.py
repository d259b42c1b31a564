"""Trades of a fixed alpha and share, by hour and by halves, against a numpy loop; intervals of a scan."""

import numpy as np
import pytest
from conftest import DATA

from tickloom.plans import registry


def plain_fixed(t, x, y, horizon, n_folds, alpha, share, min_train):
    """Trades (t, return) of one key."""
    n, picked = len(t), []
    edges = [n * i // (n_folds + 1) for i in range(n_folds + 2)]
    for k in range(n_folds):
        b, c = edges[k + 1], edges[k + 2]
        train, test = np.flatnonzero(t[:b] + horizon <= t[b] - horizon), np.arange(b, c)
        if len(train) < min_train:
            continue
        mean, std = x[train].mean(0), x[train].std(0)
        flat = x[train].min(0) == x[train].max(0)
        z = lambda of: np.where(flat, 0, np.clip((x[of] - mean) / np.where(flat, 1, std), -10, 10))  # noqa: E731, B023
        raw = np.where(flat, 0, (x[train] - mean) / np.where(flat, 1, std))[:, ~flat]
        w = np.zeros(x.shape[1])
        w[~flat] = np.linalg.solve(raw.T @ raw + alpha * np.eye(raw.shape[1]), raw.T @ (y[train] - y[train].mean()))
        level, pred = np.quantile(abs(y[train].mean() + z(train) @ w), share), y[train].mean() + z(test) @ w
        picked += [(int(t[i]), float(np.sign(p) * y[i])) for i, p in zip(test, pred) if abs(p) >= level]
    out, free = [], -1
    for at, r in sorted(picked):
        if at >= free:
            out.append((at, r))
            free = at + horizon
    return out


@pytest.fixture(scope="module")
def want(spark):
    from tickloom.plans import research as plans

    rows = plans._micro(spark, DATA, plans.ONE).select("symbol", "t_ms", *plans.COLUMNS, "y_bps").orderBy("symbol", "t_ms").collect()
    out = {}
    for s in {r.symbol for r in rows}:
        own = np.array([r[1:] for r in rows if r.symbol == s], float)
        out[s] = plain_fixed(own[:, 0].astype(int), own[:, 1:-1], own[:, -1], plans.HORIZON, **plans.FIXED)
    return out


def test_hours(spark, want):
    got = {(r.symbol, r.hour): (r.n, r.mean_bps) for r in registry.queries()["m9_fixed_hours"](spark, DATA).collect()}
    hours = {}
    for s, trades in want.items():
        for t, r in trades:
            hours.setdefault((s, t // 3_600_000 % 24), []).append(r)
    hours = {k: v for k, v in hours.items() if len(v) >= 3}
    assert got.keys() == hours.keys() and len(got) > 5
    for k, v in hours.items():
        assert got[k] == (len(v), pytest.approx(np.mean(v), abs=2e-3))


def test_parts(spark, want):
    got = {(r.symbol, r.part): r for r in registry.queries()["m9_fixed_parts"](spark, DATA).collect()}
    rng = np.random.default_rng(0)
    for s, trades in want.items():
        x = np.array([r for _, r in trades])
        n = len(x)
        for part, v in (("all", x), ("first", x[: n // 2]), ("second", x[n // 2 :])):
            r = got[s, part]
            assert (r.n_trades, r.mean_bps, r.hit) == (len(v), pytest.approx(v.mean(), abs=2e-3), pytest.approx((v > 0).mean(), abs=2e-3))
            assert r.t_stat == pytest.approx(v.mean() / (v.std(ddof=1) / np.sqrt(len(v))), abs=1e-2)
        r, spread = got[s, "all"], x.std() / np.sqrt(n)
        low, high = np.percentile(rng.choice(x, (4000, n)).mean(1), [2.5, 97.5])
        assert abs(r.low - low) < 0.3 * spread and abs(r.high - high) < 0.3 * spread
        assert r.block_low < r.mean_bps < r.block_high and got[s, "first"].low is None
    assert len(got) == 3 * len(want) > 0
