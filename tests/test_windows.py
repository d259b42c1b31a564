"""Trailing windows over many rows: what is framed grows with the windows' ends, not with rows times rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import timealign

WINDOWS = [7, 20, 55]


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], int(t), float(x)) for i, (t, x) in enumerate(zip(rng.integers(-150, 400, 6000), rng.integers(0, 1000, 6000)))]
    left = [(s, t) for s in "abc" for t in (-160, -100, -3, 0, 7, 20, 21, 99, 100, 101, 399, 460) for _ in range(1 + (t == 20))]
    return rows, spark.createDataFrame([*rows, ("a", None, 5.0)], "symbol string, t long, x double"), left, spark.createDataFrame(left, "symbol string, t long")


@pytest.mark.parametrize("bucket", [10, 50, 1000])
def test_multi_window_sums(dense, bucket):
    rows, right, left, at = dense
    sums = {"n": F.lit(1).cast("long"), "x": F.col("x")}
    got = timealign.multi_window_sums(at, right, ["symbol"], "t", WINDOWS, sums, bucket).collect()
    key = lambda s, t: [v for w in WINDOWS for v in (sum(r[0] == s and t - w < r[1] <= t for r in rows), sum(r[2] for r in rows if r[0] == s and t - w < r[1] <= t))]
    assert sorted((r.symbol, r.t, *[r[f"{c}_w{w}"] for w in WINDOWS for c in "nx"]) for r in got) == sorted((s, t, *key(s, t)) for s, t in left)
    one = timealign.window_sums(at, right, ["symbol"], "t", 20, sums, bucket)
    assert sorted((r.symbol, r.t, r.n, r.x) for r in one.collect()) == sorted((s, t, *key(s, t)[2:4]) for s, t in left)


def test_condensed(dense):
    """A frame meets pieces, as many as ends and buckets at most, whatever the rows."""
    rows, right, left, at = dense
    pieces = timealign.condensed(right, at, ["symbol"], "t", WINDOWS, {"x": F.col("x")}, 100).filter("t IS NOT NULL").collect()
    ends = {(s, t - w) for s, t in left for w in (0, *WINDOWS)}
    assert len(pieces) <= len(ends) + 2 * 6 < len(rows) / 10 and sum(p["__x"] for p in pieces) == sum(r[2] for r in rows)


def test_walk_book_hard_rows(spark):
    """Ladders of any length, missing ones, missing and unusable levels, and infinite prices beside a quantity of 0."""
    from tickloom.operators.backtest import walk_book

    rows = [(1, [10.0, 11.0, 12.0], [2.0, 0.0, 9.0]), (2, None, [1.0]), (3, [], []), (4, [10.0, None, 12.0], [1.0, 5.0, 2.0]), (5, [float("inf"), 10.0], [0.0, 4.0]), (6, [10.0, 11.0], [1.0]), (7, [10.0, 11.0], [5.0, None])]
    df = spark.createDataFrame(rows, "i int, p array<double>, q array<double>").repartition(3)
    got = {r.i: None if r.f is None else tuple(r.f) for r in df.select("i", walk_book("p", "q", 5.0).alias("f")).collect()}
    assert got == {1: (pytest.approx((20 + 36) / 5), 5.0), 2: None, 3: (None, 0.0), 4: (pytest.approx(34 / 3), 3.0), 5: (10.0, 4.0), 6: (10.0, 1.0), 7: (10.0, 5.0)}


def test_lookups_carry_no_ladders(spark, monkeypatch):
    """Fills are found per book row ahead of the lookups, which carry them in place of four arrays."""
    from tickloom.operators import backtest

    book = spark.createDataFrame([("a", 0, i, [10.0], [9.0], [11.0], [9.0]) for i in range(3)], "symbol string, t_ms long, u long, bid_px array<double>, bid_qty array<double>, ask_px array<double>, ask_qty array<double>")
    seen, asof = [], backtest.asof_backward
    monkeypatch.setattr(backtest, "asof_backward", lambda left, right, *a: seen.append(dict(right.dtypes)) or asof(left, right, *a))
    r = backtest.feasibility(spark.createDataFrame([("a", 5, 1.0)], "symbol string, t_ms long, pred double"), book, ["symbol"], 4.0, 1, 10, 100, 0.0).collect()
    assert [(x.in_px, x.out_px, x.reason) for x in r] == [(11.0, 10.0, None)]
    assert len(seen) == 2 and not any("array" in kind for d in seen for kind in d.values())
