"""Rotating sinks: nothing lost, nothing twice, through failures at every step and a restart."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.sources import files, tables
from tickloom.streaming import sinks

SECOND, DAY = 1_000_000_000, 86_400 * 1_000_000_000
SCHEMA = "kind string, symbol string, recv_time_ns long, id long, line string"


def rows(n0, n, start, kind="depth", symbol="X"):
    return [{"kind": kind, "symbol": symbol, "recv_time_ns": start + i * SECOND, "id": n0 + i, "line": json.dumps({"recv_time_ns": start + i * SECOND, "session_id": "s0", "raw": f'{{"u": {n0 + i}}}'})} for i in range(n)]


BATCHES = [
    rows(0, 40, 0) + rows(0, 3, 0, "aggTrade", "Y"),
    rows(40, 40, 40 * SECOND),
    rows(80, 5, DAY) + rows(3, 1, DAY, "aggTrade", "Y"),
    rows(200, 2, 50 * SECOND) + rows(85, 1, DAY + 9 * SECOND),  # late for the first day, whose shards are closed
    rows(300, 4, 2 * DAY, symbol="Z"),
]


def run(spark, folder, root, sink, upto):
    source = folder / "in"
    source.mkdir(exist_ok=True)
    for n, batch in enumerate(BATCHES[:upto]):
        if not (at := source / f"{n}.json").exists():
            at.write_text("\n".join(map(json.dumps, batch)) + "\n")
            os.utime(at, (1_700_000_000 + n, 1_700_000_000 + n))  # the order in which a stream takes files
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}-commits").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert not q.isActive


def kept(spark, root, kind, symbol, day):
    """Lines of a key's shards, file by file in order."""
    f = spark.read.text(f"{root}/{kind}/{symbol}/{day}").select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at")).collect()
    return [json.loads(json.loads(r.value)["raw"])["u"] for r in sorted(f, key=lambda r: (r.f, r.at))]


def test_restart(spark, tmp_path, monkeypatch):
    """Batches that die ahead of the staging, behind a rename, behind the manifest and ahead of the version are repeated: each row is in one shard, once."""
    root = str(tmp_path / "raw")
    left, real, real_close = ["stage", "depth", "manifests", "parts"], sinks._move, sinks.Rotating._close

    def die(step):
        if left and left[0] == step:
            left.pop(0)
            raise OSError("lost")

    def moving(spark_, path, to):
        if "/parts/" in to:
            die("parts")
        real(spark_, path, to)
        if "/depth/" in to:
            die("depth")

    def closing(self, *args):
        die("stage")
        real_close(self, *args)
        die("manifests")

    monkeypatch.setattr(sinks, "_move", moving)
    monkeypatch.setattr(sinks.Rotating, "_close", closing)
    for _ in range(4):  # each time by what a new process would make
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path, root, sinks.Rotating(root, most=2000, age_s=1000), 5)
    assert not left
    sink = sinks.Rotating(root, most=2000, age_s=1000)
    run(spark, tmp_path, root, sink, 5)
    sink.finish(spark, f"{root}-commits")
    got = Counter((r.kind, r.symbol) for r in sink.manifest(spark).select("kind", "symbol", "day").distinct().collect())
    assert got == {("depth", "X"): 2, ("depth", "Z"): 1, ("aggTrade", "Y"): 2}
    assert kept(spark, root, "depth", "X", "19700101") == [*range(80), 200, 201]
    assert kept(spark, root, "depth", "X", "19700102") == [*range(80, 86)] and kept(spark, root, "depth", "Z", "19700103") == [*range(300, 304)]
    assert kept(spark, root, "aggTrade", "Y", "19700101") == [0, 1, 2]
    m = sink.manifest(spark).filter("symbol = 'X' AND day = '19700101'").orderBy("path").collect()
    assert sum(r.n_records for r in m) == 82 and len(m) >= 4 and m[0].first_id == 0 and m[-1].last_id == 201
    recorded = sink.manifest(spark).filter("symbol = 'X' AND day = '19700101'").withColumn("path", F.concat(F.lit("file:"), "path"))
    found = files.manifest_check(spark, recorded, f"{root}/depth/X/19700101", "*.jsonl.gz", ("size", "sha256", "n_records")).groupBy("status").count().collect()
    assert [(r.status, r["count"]) for r in found] == [("matched", len(m))]


def test_goes_on(spark, tmp_path):
    """A finished sink goes on with its stream; it refuses to finish ahead of a commit; its shards are read as a day's messages."""
    root = str(tmp_path / "raw")
    sink = sinks.Rotating(root, most=1 << 20, age_s=1e9)
    run(spark, tmp_path, root, sink, 1)
    assert sink.manifest(spark).count() == 0
    with pytest.raises(ValueError, match="isn't committed"):
        sink.finish(spark, str(tmp_path / "elsewhere"))
    sink.finish(spark, f"{root}-commits")
    assert sink.manifest(spark).count() == 2
    run(spark, tmp_path, root, sink, 5)
    sink.finish(spark, f"{root}-commits")
    sink.finish(spark, f"{root}-commits")
    assert sink.manifest(spark).agg(F.sum("n_records")).first()[0] == sum(map(len, BATCHES))
    assert kept(spark, root, "depth", "X", "19700101") == [*range(80), 200, 201]
    m = tables.raw_messages(spark, str(tmp_path), "X", "19700101").orderBy("recv").collect()
    assert len(m) == 82 and {r.kind for r in m} == {"depth"} and m[0].body == '{"u": 0}'


def test_typed_rows(spark, tmp_path):
    """Typed rows are flushed by count and age into Parquet files that load() reads."""
    root = str(tmp_path / "store")
    sink = sinks.Rotating(root, most=30, age_s=1e9, text=False, ident="a")

    def typed(batch, n):
        d = batch.filter("kind = 'depth'").select(F.lit("agg_trades").alias("kind"), "symbol", "recv_time_ns", F.col("id").alias("a"), (F.col("recv_time_ns") / 1e6).cast("long").alias("T_ms"), F.lit("1.5").alias("price"))
        sink(d, n)

    run(spark, tmp_path, root, typed, 5)
    sink.finish(spark, f"{root}-commits")
    assert sink.manifest(spark).agg(F.max("n_records")).first()[0] == 30
    before = spark.conf.get("spark.sql.caseSensitive")
    try:
        got = tables.load(spark, root, "agg_trades", "X", "19700101", "19700102", numbers=True).collect()
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)
    assert sorted(r.a for r in got) == [*range(86), 200, 201] and [r.T_ms for r in got] == sorted(r.T_ms for r in got)
    assert {r.price for r in got} == {1.5}


def test_no_place(spark, tmp_path):
    """A row without a kind raises; an empty batch writes an empty version."""
    sink = sinks.Rotating(str(tmp_path / "raw"))
    with pytest.raises(Exception, match="without kind"):
        sink(spark.createDataFrame([(None, "X", 1, 1, "{}")], SCHEMA), 0)
    sink(spark.createDataFrame([], SCHEMA), 0)
    sink(spark.createDataFrame([], SCHEMA), 1)
    assert sink.manifest(spark).count() == 0
