"""File sources and sinks on small files."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tickloom.sources import files


def test_zipped_bars(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "open_time,open\n60000,1,2,0.5,1.5,10,119999,15,3,6,9,0\n120000,1,2,0.5,1.6,10,179999,15,4,6,9,0\n")
    got = files.read_zipped_bars(spark, str(tmp_path)).orderBy("open_ms").collect()
    assert [(r.open_ms, r.close, r.quote_volume, r.n_trades, r.buy_volume, r.line) for r in got] == [(60000, 1.5, 15.0, 3.0, 6.0, 1), (120000, 1.6, 15.0, 4.0, 6.0, 2)]


def test_manifest(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n')
    m = files.manifest(spark, str(tmp_path))
    row = m.first()
    assert (row.size, row.sha256) == (9, hashlib.sha256(b'{"a": 1}\n').hexdigest())
    recorded = spark.createDataFrame([tuple(row), ("gone", 1, "0")], m.schema)
    assert {(r.path == "gone", r.status) for r in files.manifest_check(spark, recorded, str(tmp_path)).collect()} == {(False, "matched"), (True, "only_left")}


def test_route(spark, tmp_path):
    feed = spark.createDataFrame([("trade", 1), ("book", 2), ("trade", 3)], "kind string, v int")
    write = files.route(str(tmp_path), {"trades": (F.col("kind") == "trade", [F.col("v")]), "books": (F.col("kind") == "book", [F.col("v")])})
    write(feed, 0)
    write(feed, 0)
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/trades").collect()) == [1, 3]
    assert [r.v for r in spark.read.parquet(f"{tmp_path}/books").collect()] == [2]


def test_ticks_and_specs(spark, tmp_path):
    df = spark.createDataFrame([("100.10",), (None,)], "p string")
    assert [r[0] for r in df.select(files.ticks(F.col("p"), "0.10")).collect()] == [1001, None]
    with pytest.raises(Exception, match="multiple"):
        spark.createDataFrame([("1.05",)], "p string").select(files.ticks(F.col("p"), "0.1")).collect()
    one = {"symbol": "AUSDT", "contractType": "PERPETUAL", "quoteAsset": "USDT", "status": "TRADING", "filters": [{"filterType": "PRICE_FILTER", "tickSize": "0.1"}, {"filterType": "LOT_SIZE", "stepSize": "0.001"}]}
    (tmp_path / "info.json").write_text(json.dumps({"symbols": [one, one | {"symbol": "B", "status": "BREAK"}]}))
    assert [tuple(r) for r in files.instrument_specs(spark, f"{tmp_path}/info.json").collect()] == [("AUSDT", "0.1", "0.001")]
