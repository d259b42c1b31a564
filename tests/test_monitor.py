"""Stores, raw shards and reports on small files; monitoring where no query shows it."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import monitor
from tickloom.sources import files, tables


@pytest.fixture
def store(spark, tmp_path):
    rows = [("S", f"2026010{d}", a, str(100 + a), "0.5", a * 10, True) for d in (1, 2, 3) for a in (3 * d, 3 * d + 1, 3 * d + 1)]
    df = spark.createDataFrame(rows, "symbol string, day string, a long, price string, qty string, T_ms long, buyer_is_maker boolean")
    tables.write_normalized(df, f"{tmp_path}/agg_trades")
    return str(tmp_path)


def test_store(spark, store):
    assert files.available_days(spark, store, "agg_trades", "S") == ["20260101", "20260102", "20260103"]
    assert files.available_days(spark, store, "agg_trades", "T") == [] == files.available_days(spark, store, "gaps", "S")
    got = tables.load(spark, store, "agg_trades", "S", "20260101", "20260102", ["a", "price", "aggressor_side"], numbers=True).collect()
    assert [tuple(r) for r in got] == [(3, 103.0, None), (4, 104.0, None), (6, 106.0, None), (7, 107.0, None)]
    for name in tables.KEYS:
        if name != "agg_trades":
            assert tables.load(spark, store, name, "S", "20260101", "20260101").count() == 0
    plan = tables.load(spark, store, "agg_trades", "S", "20260101", "20260101")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.to_numbers(spark.createDataFrame([("x",)], "price string")).collect()
    last = files.latest_files(spark, store, "agg_trades", "S", 1).collect()
    assert len(last) == 1 and last[0].day == "20260103"
    inv = {(r.symbol, r.day): (r.n_rows, r.t_min, r.t_max) for r in files.inventory(spark, store, "agg_trades", "T_ms").collect()}
    assert inv["S", "20260101"] == (3, 30, 40) and inv["S", None] == inv[None, None] == (9, 30, 100)
    total = files.inventory(spark, store, "agg_trades", "T_ms").filter("symbol IS NULL").first()
    assert total.files == files.listing(spark, f"{store}/agg_trades", "*.parquet").count() and total["size"] > 0


def test_raw_shards(spark, tmp_path):
    from tickloom.streaming import book

    def line(recv, first, last, prev, **more):
        return json.dumps({"recv_time_ns": recv, "session_id": "s0", "raw": json.dumps({"U": first, "u": last, "pu": prev, "bids": [["100.0", "1.000"]], "asks": [["101.0", "2.000"]]})} | more)

    for folder in ("depth", "rest"):
        (tmp_path / folder / "X" / "20260101").mkdir(parents=True)
    (tmp_path / "depth/X/20260101/a.jsonl").write_text("\n".join([line(5, 1, 2, 0), line(7, 3, 3, 2), "{broken"]) + "\n")
    (tmp_path / "rest/X/20260101/a.jsonl").write_text("\n".join([line(6, 2, 2, 0, endpoint="/api/depth", status=200), line(1, 9, 9, 0, endpoint="/api/depth", status=429), line(1, 9, 9, 0, endpoint="/api/time", status=200)]) + "\n")
    m = tables.raw_messages(spark, str(tmp_path), "X", "20260101")
    assert sorted((r.recv, r.kind) for r in m.collect()) == [(5, "depth"), (6, "snapshot"), (7, "depth")]
    assert [(r.u, r.flags) for r in book.replay(m).orderBy("u").collect()] == [(2, "first_after_snapshot"), (3, "")]
    assert tables.raw_messages(spark, str(tmp_path), "X", "20260102").count() == 0


@pytest.fixture
def by_case(spark):
    """load() makes the session case sensitive; other tests get it back as it was."""
    old = spark.conf.get("spark.sql.caseSensitive")
    yield
    spark.conf.set("spark.sql.caseSensitive", old)


def test_stored_layout(spark, tmp_path, by_case):
    """Files in folders symbol/day with names that differ by case only, written without Spark."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def put(name, day, rows, file="a"):
        at = tmp_path / name / "S" / day
        at.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.Table.from_pylist(rows), at / f"{file}.parquet")

    def row(u, epoch, valid, t, **more):
        return {"symbol": "S", "book_epoch": epoch, "u": u, "U": u - 1, "pu": u - 2, "T_ms": t, "recv_seq": u, "is_valid": valid, "bid_px_0": f"{100 + u}.5", "bid_qty_0": "1.000"} | more

    put("book_top20", "20260101", [row(5, 0, True, 50), row(1, 0, True, 10), row(2, 0, False, 20)])
    put("book_top20", "20260102", [row(3, 0, True, 30, bid_px_0="999.0", recv_seq=9, flags="late"), row(3, 0, True, 30), row(5, 1, True, 60)], "b")
    put("book_top20", "20260104", [row(7, 0, True, 70)])
    got = tables.load(spark, str(tmp_path), "book_top20", "S", "20260101", "20260102", numbers=True)
    assert [(r.u, r.first_id, r.prev_id, r.book_epoch, r.bid_px_0, r.day) for r in got.collect()] == [(1, 0, -1, 0, 101.5, "20260101"), (3, 2, 1, 0, 103.5, "20260102"), (5, 4, 3, 0, 105.5, "20260101"), (5, 4, 3, 1, 105.5, "20260102")]
    assert "flags" in got.columns and got.filter("flags = 'late'").count() == 0
    assert [r.u for r in tables.load(spark, str(tmp_path), "book_top20", "S", "20260101", "20260104", ["u"], valid_only=False).collect()] == [1, 2, 3, 5, 5, 7]
    trade = {"symbol": "S", "a": 4, "p": "10.5", "q": "2", "nq": "2", "f": 1, "l": 2, "T_ms": 5, "m": True}
    put("agg_trades", "20260101", [trade, trade | {"T_ms": 6, "p": "11"}, trade | {"a": 3}])
    put("mark_price", "20260101", [{"symbol": "S", "E_ms": 1, "p": "5.5", "P": "6.5", "i": "1", "ap": "2", "r": "0.1", "recv_seq": 1}])
    assert [tuple(r) for r in tables.load(spark, str(tmp_path), "agg_trades", "S", "20260101", "20260101", ["a", "p", "m"], numbers=True).collect()] == [(3, 10.5, True), (4, 10.5, True)]
    assert [tuple(r) for r in tables.load(spark, str(tmp_path), "mark_price", "S", "20260101", "20260101", ["price", "settle_price", "funding_rate"], numbers=True).collect()] == [(5.5, 6.5, 0.1)]
    assert tables.load(spark, str(tmp_path), "agg_trades", "S", "20260201", "20260202").count() == 0 == tables.load(spark, str(tmp_path), "gaps", "S", "20260101", "20260102").count()
    back = tables.load(spark, str(tmp_path), "agg_trades", "S", "20260101", "20260101", numbers=True)
    tables.write_normalized(back, f"{tmp_path}/own/agg_trades")  # the engine's own doubles are read as they are
    assert [r.price for r in tables.load(spark, f"{tmp_path}/own", "agg_trades", "S", "20260101", "20260101").collect()] == [10.5, 10.5]


def test_wire_shards(spark, tmp_path):
    """Shards as they are received: events alone and in a stream's envelope, snapshots with their request's limit, gzip, damaged bodies."""
    import gzip

    from tickloom.streaming import book

    def event(recv, u, pu, stream=False, **more):
        m = {"e": "depthUpdate", "E": u, "T": u, "s": "X", "U": pu + 1, "u": u, "pu": pu, "b": [["100.0", "1.000"]], "a": [["101.0", "2.000"]]} | more
        return json.dumps({"recv_time_ns": recv, "session_id": "s0", "connection_id": "c", "raw": json.dumps({"stream": "x@depth", "data": m} if stream else m)})

    def snapshot(recv, u, status=200, **params):
        levels = {"bids": [["100.0", "1.000"], ["99.0", "1.000"]], "asks": [["101.0", "2.000"], ["102.0", "1.000"]]}
        return json.dumps({"recv_time_ns": recv, "session_id": "s0", "endpoint": "/fapi/v1/depth", "status": status, "params": {"symbol": "X"} | params, "raw": json.dumps({"lastUpdateId": u, "E": 1, "T": 1} | levels)})

    for folder in ("depth", "rest"):
        (tmp_path / "raw" / folder / "X" / "20260101").mkdir(parents=True)
    with gzip.open(tmp_path / "raw/depth/X/20260101/a.jsonl.gz", "wt") as f:
        f.write("\n".join([event(5, 2, 0), event(7, 3, 2, True), event(8, 4, 3, U="4"), json.dumps({"recv_time_ns": 9, "session_id": "s0", "raw": "{broken"}), event(10, 5, 3, True), event(12, 6, 5)]) + "\n")
    (tmp_path / "raw/rest/X/20260101/a.jsonl").write_text("\n".join([snapshot(6, 2, limit=1000), snapshot(11, 6, 418), snapshot(13, 6, limit=2)]) + "\n")
    m = tables.raw_messages(spark, str(tmp_path), "X", "20260101")
    assert m.count() == 8
    limits = [json.loads(r.body)["limit"] for r in m.filter("kind = 'snapshot'").orderBy("recv").collect()]
    assert limits == [1000, 2]
    assert [(r.epoch, r.u, r.flags) for r in book.replay(m, top=2).orderBy("recv").collect()] == [(1, 2, "first_after_snapshot"), (1, 3, ""), (1, 5, ""), (1, 6, "")]
    log = [(r.recv, r.kind, r.reason) for r in book.replay_log(m, top=2).orderBy("recv").collect()]
    assert (8, "dropped", "parse_error") in log and (9, "dropped", "parse_error") in log and (13, "dropped", "snapshot_while_not_syncing") in log


def test_footers(spark, store):
    """Counts and ends come from the files' footers: the plan reads no column."""
    plan = files.inventory(spark, store, "agg_trades", "T_ms")._jdf.queryExecution().optimizedPlan().toString() + files.inventory(spark, store, "agg_trades", "T_ms")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(T_ms), MAX(T_ms)]" in plan and spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_long_gap(spark):
    """One jump of 3 * 10^9 ids is one interval, for filling and for membership."""
    far = 3_000_000_000
    gaps = spark.createDataFrame([("S", 2, far), ("S", far + 2, far + 2), (None, 5, 6)], "k string, from_a long, to_a long")
    rows = spark.createDataFrame([("S", 1, 1), ("S", 7, 2), ("S", 7, 1), ("S", far + 2, 5), ("S", far + 3, 5), (None, 6, 1)], "k string, a long, v int")
    assert sorted((r.a, r.from_a) for r in monitor.in_gaps(rows, gaps, ["k"], "a").collect()) == [(6, 5), (7, 2), (7, 2), (far + 2, far + 2)]
    out, found = monitor.filled_gaps(gaps.filter("k = 'S'"), rows.filter("k = 'S'"), ["k"], "a", ["v"])
    assert sorted((r.n_filled, r.repair_status) for r in out.collect()) == [(1, "partial"), (1, "repaired")] and sorted((r.a, r.v) for r in found.collect()) == [(7, 1), (far + 2, 5)]


def test_faults(spark):
    """Types of parsed values: true is no number, a price must be text, a damaged text has one fault."""
    rules = {"integers": ["u", "U"], "texts": ["p"], "ascending": [("U", "u")]}
    cases = [
        ('{"u": 5, "U": 4, "p": "1.50"}', []), ('{"u": true, "U": 4, "p": "1"}', ["u_not_integer"]), ('{"u": "5", "U": 4, "p": 1.5}', ["u_not_integer", "p_not_text"]), ('{"u": 3, "U": 4, "p": "1"}', ["U_above_u"]),
        ('{"u": 5.5, "U": null, "p": null}', ["u_not_integer", "U_not_integer", "p_not_text"]), ("{broken", ["unparseable"]), (None, ["unparseable"]), ("", ["unparseable"]), ("[]", ["u_not_integer", "U_not_integer", "p_not_text"]),
    ]
    df = spark.createDataFrame([(n, b) for n, (b, _) in enumerate(cases)], "n int, body string")
    good, bad = monitor.accepted(df, "body", **rules)
    assert {r.n: r.reasons for r in bad.collect()} == {n: want for n, (_, want) in enumerate(cases) if want}
    assert [r.n for r in good.collect()] == [0] and good.columns == df.columns


def test_day_check(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"u": 4}\n{"u": 5}\n{"u": 9}\n')
    (tmp_path / "b.jsonl").write_text('{"u": 10}\n')
    m = files.shard_manifest(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.n_records, r.first_id, r.last_id) for r in m] == [(3, 4, 9), (1, 10, 10)]
    recorded = spark.createDataFrame([tuple(m[0])], "path string, size long, sha256 string, n_records long, first_id long, last_id long")
    rows = spark.createDataFrame([(1,), (1,), (2,)], "a long")
    got = {(r.what, r.status): (r.n, r.ok) for r in files.verify_day(spark, str(tmp_path), recorded, {"trades": (rows, ["a"])}).collect()}
    assert got == {("raw", "matched"): (1, True), ("raw", "only_right"): (1, True), ("trades", "duplicate_keys"): (1, False)}
    wrong = recorded.withColumn("n_records", F.lit(7).cast("long"))
    assert {r.status for r in files.verify_day(spark, str(tmp_path), wrong, {}).collect()} == {"mismatched", "only_right"}
    assert files.daily_check(spark, str(tmp_path), recorded, {}, f"{tmp_path}/d") and not files.daily_check(spark, str(tmp_path), wrong, {}, f"{tmp_path}/d")
    files.write_report(rows, f"{tmp_path}/r")
    files.write_report(rows.limit(1), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 1


def test_specs(spark):
    old = spark.createDataFrame([("A", "0.1", "0.001"), ("B", "0.1", "1")], "symbol string, tick string, step string")
    new = spark.createDataFrame([("A", "0.01", "0.001"), ("B", "0.1", "1")], "symbol string, tick string, step string")
    assert [tuple(r) for r in files.spec_changes(old, new).collect()] == [("A", "0.1", "0.01", "0.001", "0.001")]
    assert files.required_specs(new, ["A"]).count() == 1
    with pytest.raises(Exception, match="no trading perpetual: C"):
        files.required_specs(new, ["A", "C"]).collect()


def test_validation(spark):
    d = spark.createDataFrame([(1, 2, 0, [["1", "2"]], []), (3, 2, None, None, [])], "first_id long, last_id long, prev_id long, bids array<array<string>>, asks array<array<string>>")
    assert [r.error for r in monitor.validated(d, monitor.depth_rules()).collect()] == [None, "missing_prev_id,missing_bids,first_after_last"]
    t = spark.createDataFrame([(1, "100.5", "2", 1, 1, 5, True), (None, "x", "-1", 2, 1, 5, None)], "a long, p string, q string, f long, l long, T_ms long, m boolean")
    assert [r.error for r in monitor.validated(t, monitor.trade_rules()).collect()] == [None, "missing_a,missing_m,price,quantity,first_after_last"]
    raw = spark.createDataFrame([('{"a": 1, "zz": "x"}',), ('{"a": 1}',), (None,)], "r string")
    assert [r[0] for r in raw.select(monitor.unknown_fields(F.col("r"), ["a"])).collect()] == ['{"zz":"x"}', None, None]
    assert monitor.feature_groups(["k"], ["m"]) == {"kline": ["k"], "micro": ["m"], "combined": ["k", "m"]}
    u = monitor.unioned([spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(1.5,)], "x double")])
    assert u.dtypes == [("x", "double"), ("y", "string")] and sorted(map(tuple, u.collect())) == [(1.0, "a"), (1.5, None)]


def test_histogram_constant(spark):
    from tickloom.functions import stats

    h = stats.histogram(spark.createDataFrame([(2.0,)] * 5, "x double"), "x", bins=3).orderBy("bin").collect()
    assert sum(r.n for r in h) == 5 and len(h) == 3
    b = stats.score_bins(spark.createDataFrame([(float(i), float(i)) for i in range(100)], "y double, p double"), "y", "p")
    assert [r.n for r in b.orderBy("bin").collect()] == [10] * 10 and stats.monotonic_share(b).first().monotonic == 1.0


def test_settings(tmp_path):
    from tickloom.sources import config

    (tmp_path / "c.json").write_text('{"symbols": ["A"], "data_dir": "/d", "book": {"export_levels": 5}}')
    c = config.read(f"{tmp_path}/c.json")
    assert (c.symbols, c.book.export_levels, c.book.stale_after_ms, c.backfill.max_attempts) == (["A"], 5, 5000, 5)
    base = {"symbols": [], "data_dir": "d"}
    for wrong in ({"sym": 1}, {"book": {"levels": 1}}, {"book": {"export_levels": -1}}, {"book": {"export_levels": True}}):
        with pytest.raises(ValueError, match="settings"):
            config.parsed(config.Settings, base | wrong)
    with pytest.raises(ValueError, match="data_dir"):
        config.parsed(config.Settings, {"symbols": []})


def test_reference_bars(spark, tmp_path):
    import zipfile

    assert files.reference_bars(spark, f"{tmp_path}/none").count() == 0
    for name, close in (("a", 1.5), ("b", 9.9)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", f"60000,1,2,0.5,{close},10,119999,15,3,6,9,0\n")
    assert [r.close for r in files.reference_bars(spark, str(tmp_path)).collect()] == [1.5]
