"""Changes of an instrument's units, backfill in rounds, and a day's report."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backfill
from tickloom.sources import files
from tickloom.streaming import book, daily

MESSAGE = "symbol string, session string, kind string, recv long, body string"


def _event(u, bid="50.0"):
    return json.dumps({"e": "depthUpdate", "E": u, "T": u, "U": u, "u": u, "pu": u - 1, "b": [[bid, "1.000"]], "a": [["101.0", "2.000"]]})


def _snapshot(u):
    return json.dumps({"lastUpdateId": u, "bids": [["49.0", "1.000"]], "asks": [["102.0", "1.000"]]})


def _spec(tick, step="0.001"):
    return json.dumps({"tick": tick, "step": step})


#: A tick of 0.1 until 6, then of 0.05: prices of the new unit are books of a second epoch.
CHANGE = [
    ("x", "s0", "depth", 1, _event(1)), ("x", "s0", "snapshot", 2, _snapshot(1)), ("x", "s0", "spec", 3, _spec("0.10")), ("x", "s0", "depth", 4, _event(2, "50.1")), ("x", "s0", "spec", 5, "{broken"),
    ("x", "s0", "depth", 6, _event(3)), ("x", "s0", "spec", 6, _spec("0.05")), ("x", "s0", "depth", 7, _event(4, "50.05")), ("x", "s0", "snapshot", 8, _snapshot(4)), ("x", "s0", "depth", 9, _event(5, "50.15")),
]


@pytest.mark.parametrize("slice_rows", [100, 3])
def test_units_replay(spark, slice_rows):
    m = spark.createDataFrame(CHANGE, MESSAGE)
    got = [(r.epoch, r.u, r.bid_px[0]) for r in book.replay(m, slice_rows=slice_rows).orderBy("recv").collect()]
    assert got == [(1, 1, 50.0), (1, 2, 50.1), (2, 4, 50.05), (2, 5, 50.15)]  # 3 came with the change, waits, and is older than the snapshot
    log = [(r.recv, r.kind, r.reason) for r in book.replay_log(m, slice_rows=slice_rows).orderBy("recv").collect()]
    assert log == [(2, "state", "synced"), (5, "dropped", "parse_error"), (6, "state", "spec_changed"), (8, "state", "synced")]


def test_units_stream(spark, tmp_path):
    """The streaming form, a message a batch: the change opens a gap that the next valid book closes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (CHANGE[:4], CHANGE[4:7], CHANGE[7:]):
            spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
            source = spark.readStream.schema(MESSAGE).parquet(f"{tmp_path}/m")
            q = book.stream_depth(source).writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{tmp_path}/o").collect()
    assert sorted((r.epoch, r.u, r.bid_px[0]) for r in got if r.kind == "row") == [(1, 1, 50.0), (1, 2, 50.1), (2, 4, 50.05), (2, 5, 50.15)]
    gaps = sorted((r.version, r.gap_kind, r.certainty, r.status) for r in got if r.kind == "gap")
    assert [g[1:] for g in gaps if "event" not in g] == [("depth_consistency", "certain", "open"), ("depth_consistency", "certain", "not_applicable")]


def test_spec_messages(spark):
    m = spark.createDataFrame(CHANGE + [("x", "s1", "depth", 90, "{}"), ("y", "s0", "depth", 90, "{}")], MESSAGE)
    specs = spark.createDataFrame([("x", 1, "0.1", "1"), ("x", 50, "0.2", "1"), ("x", 99, "0.3", "1"), ("z", 1, "1", "1"), ("y", 1, None, "1")], "symbol string, recv long, tick string, step string")
    got = sorted((r.symbol, r.session, r.recv, json.loads(r.body)["tick"]) for r in book.spec_messages(specs, m).collect())
    assert got == [("x", "s0", 1, "0.1"), ("x", "s1", 1, "0.1"), ("x", "s1", 50, "0.2")]


GAPS = "k string, from_a long, to_a long, start_t long"


def test_backfill_rounds(spark, tmp_path):
    """Pages, attempts, reach, failed and refused requests, and a round that dies ahead of its gaps."""
    gaps = spark.createDataFrame([("A", 10, 19, 100), ("A", 30, 31, 100), ("B", 5, 6, 1), ("C", 1, 3, 100), ("D", 1, 3, None), (None, 4, 5, 100), ("A", 40, 99, 100)], GAPS)
    f = backfill.Backfill(str(tmp_path / "b"), ["k"], "a", page=3, pages=3, attempts=2, reach=50)
    f.start(gaps)
    f.start(gaps.limit(1))  # goes on, rather than over
    rows = [("A", a) for a in (*range(8, 17), 30, 31, 30, *range(40, 99))] + [("B", 5), ("C", 1), ("D", 2), (None, 4)]
    source = spark.createDataFrame(rows, "k string, a long")
    names = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    (tmp_path / "b/rows/1").mkdir(parents=True)
    (tmp_path / "b/rows/1/part-left.parquet").write_text("of a round that died")
    f.step(source, 120, failed=names("C"), refused=names("D"))
    state = lambda: {(r.k, r.from_a): (r.attempts, r.pages, r.n_filled, r.status) for r in f.gaps(spark).collect()}
    assert state() == {("A", 10): (1, 3, 7, "partial"), ("A", 30): (1, 1, 2, "repaired"), ("B", 5): (1, 0, 0, "unrepairable"), ("C", 1): (1, 0, 0, "open"), ("D", 1): (2, 0, 0, "open"), (None, 4): (1, 1, 1, "open"), ("A", 40): (1, 3, 9, "partial")}
    assert f.pending(spark)
    f.step(spark.createDataFrame([("C", 1), ("C", 2), ("C", 3), ("D", 1), (None, 4)], "k string, a long"), 130)
    after = state()
    assert after["C", 1] == (2, 1, 3, "repaired") and after["D", 1] == (2, 0, 0, "open") and after[None, 4] == (2, 2, 1, "partial")
    assert not f.pending(spark) and f.round(spark) == 2
    found = sorted((r.k or "", r.a) for r in f.rows(spark).collect())
    assert found == sorted([("A", a) for a in (*range(10, 17), 30, 31, *range(40, 49))] + [("C", 1), ("C", 2), ("C", 3), ("", 4)])


def test_day_report(spark, tmp_path):
    """Two symbols' raw shards held against a store: the report fails when a single part does, and takes its place whole."""
    old = spark.conf.get("spark.sql.caseSensitive")
    raw, store, day = tmp_path / "raw", tmp_path / "store", "20260101"
    line = lambda recv, body, **more: json.dumps({"recv_time_ns": recv, "session_id": "s0", "raw": body} | more)
    for symbol in ("X", "Y"):
        for folder in ("depth", "rest"):
            (raw / folder / symbol / day).mkdir(parents=True)
        (raw / "depth" / symbol / day / "a.jsonl").write_text("\n".join(line(u, _event(u)) for u in range(1, 6)) + "\n")
        (raw / "rest" / symbol / day / "a.jsonl").write_text(line(2, _snapshot(1), endpoint="/fapi/v1/depth", status=200, params={"limit": 1000}) + "\n")
        book_rows = [(1, u, 1, u, True, "s0", "50.0" if u != 4 or symbol == "X" else "50.1", "1.000", "49.0", "1.000", "101.0", "2.000", "102.0", "1.000") for u in range(1, 6)]
        names = "book_epoch long, u long, U long, recv_time_ns long, is_valid boolean, session_id string, " + ", ".join(f"{s}_{w}_{i} string" for s in ("bid", "ask") for i in (0, 1) for w in ("px", "qty"))
        try:
            spark.conf.set("spark.sql.caseSensitive", "true")
            spark.createDataFrame(book_rows, names).write.parquet(f"{store}/book_top20/{symbol}/{day}")
        finally:
            spark.conf.set("spark.sql.caseSensitive", old)
    recorded = files.shard_manifest(spark, str(raw)).select("path", "size", "sha256", "n_records").collect()
    recorded = spark.createDataFrame(recorded, "path string, size long, sha256 string, n_records long")
    keyed = {"trades": (spark.createDataFrame([(1,), (2,)], "a long"), ["a"])}
    parts = {"raw": str(raw), "store": str(store), "recorded": recorded, "keyed": keyed, "top": 2}
    try:
        assert daily.day_job(spark, f"file://{tmp_path}/r", day, specs={"X": ("0.1", "0.001")}, **parts)
        first = json.loads((tmp_path / f"r/verify_{day}.json").read_text())
        assert first["ok"] and first["replay"]["X"] == {"sessions": {"s0": {"deterministic": True, "matched": 5, "mismatched": 0, "only_in_replay": 0, "only_in_store": 0}}, "matched": 5, "mismatched": 0, "only_in_replay": 0, "only_in_store": 0, "ok": True}
        both = {"X": ("0.1", "0.001"), "Y": ("0.1", "0.001"), "Z": ("0.1", "0.001")}
        assert not daily.day_job(spark, f"file://{tmp_path}/r", day, specs=both, **parts)
        last = json.loads((tmp_path / f"r/verify_{day}.json").read_text())
        assert (last["replay"]["Y"]["matched"], last["replay"]["Y"]["mismatched"], last["replay"]["Y"]["ok"], last["replay"]["X"]["ok"], last["replay"]["Z"]["ok"]) == (4, 1, False, True, False)
        assert "FAILED" in (tmp_path / f"r/verify_{day}.md").read_text() and sorted(p.name for p in (tmp_path / "r").glob("*") if not p.name.startswith(".")) == [f"verify_{day}.json", f"verify_{day}.md"]
        wrong = recorded.withColumn("sha256", F.lit("0"))
        assert not daily.day_report(spark, day=day, specs={"X": ("0.1", "0.001")}, **(parts | {"recorded": wrong}))["ok"]
    finally:
        spark.conf.set("spark.sql.caseSensitive", old)
