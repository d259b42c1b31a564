"""Typed tables of the engine over the event store.

Times are BIGINT milliseconds; nanosecond columns stay BIGINT too, since Spark's
timestamps hold microseconds. Column names that differ only by case on disk are
renamed at this boundary (see RENAMES).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 20

#: Names on disk that differ only by case or are short, and what they are called here.
RENAMES = {
    "book_top20": {"U": "first_id", "pu": "prev_id"},
    "agg_trades": {"p": "price", "q": "qty", "nq": "notional_qty", "f": "first_trade", "l": "last_trade", "m": "buyer_is_maker"},
    "mark_price": {"p": "price", "P": "settle_price", "ap": "avg_price", "i": "index_price", "r": "funding_rate"},
}
#: Dedup key, survivor and order of each normalized table.
KEYS = {
    "book_top20": (("symbol", "book_epoch", "u"), "first", ("T_ms", "u", "recv_seq")),
    "agg_trades": (("symbol", "a"), "first", ("T_ms", "a")),
    "mark_price": (("symbol", "E_ms"), "first", ("E_ms", "recv_seq")),
    "gaps": (("gap_id",), "last", ("detected_time_ns", "update_time_ns")),
    "quality_events": (None, None, None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(col: str) -> Column:
    """Epoch milliseconds of a timestamp without zone, taken as UTC."""
    return F.unix_millis(F.col(col).cast("timestamp"))


def iso(ms: Column) -> Column:
    """Milliseconds as text in UTC, to the millisecond, whatever the session's time zone."""
    of = F.pmod(ms, F.lit(86_400_000))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    part = lambda unit, most, digits: F.lpad((F.floor(of / unit) % most).cast("string"), digits, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def day_of_ns(ns: Column) -> Column:
    """The UTC day of nanoseconds as YYYYMMDD."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ns / 86_400_000_000_000).cast("int")), "yyyyMMdd")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, a (id), t_ms, p, q, side, k: one trade per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("a"), millis("ts").alias("t_ms"),
        (100 + F.col("value") / 100).alias("p"), F.col("value").alias("q"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, u, t_ms and four arrays of LEVELS levels."""
    t = trades(spark, sf_dir)
    level = lambda f: F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), f)
    return t.select(
        "symbol", F.col("a").alias("u"), "t_ms",
        level(lambda i: F.col("p") - 0.1 * i).alias("bid_px"), level(lambda i: (1 + (F.col("k") + i) % 7).cast("double")).alias("bid_qty"),
        level(lambda i: F.col("p") + 0.1 * (i + 1)).alias("ask_px"), level(lambda i: (1 + (F.col("k") + 3 * i) % 5).cast("double")).alias("ask_qty"),
    )


_LADDERS = [f"{side}_{what}_{i}" for side in ("bid", "ask") for what in ("px", "qty") for i in range(LEVELS)]
#: Columns of each normalized table that load() knows the types of; files may have more, or lack some.
SCHEMAS = {
    "book_top20": "book_epoch long, u long, T_ms long, E_ms long, recv_seq long, recv_time_ns long, is_valid boolean, " + ", ".join(f"{c} string" for c in _LADDERS),
    "agg_trades": "a long, price string, qty string, first_trade long, last_trade long, T_ms long, E_ms long, buyer_is_maker boolean, aggressor_side string, recv_time_ns long",
    "mark_price": "E_ms long, recv_seq long, price string, index_price string, settle_price string, funding_rate string, recv_time_ns long",
    "gaps": "gap_id string, stream string, kind string, certainty string, reason string, detected_time_ns long, start_time_ns long, end_time_ns long, prev_known_id long, next_known_id long, repair_status string, update_time_ns long",
    "quality_events": "time_ns long, stream string, event_type string, severity string, detail string",
}
#: Text columns that hold numbers.
NUMERIC = ["price", "qty", "notional_qty", "settle_price", "avg_price", "index_price", "funding_rate", *_LADDERS]


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], f"symbol string, day string, {SCHEMAS[name]}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def _stored(spark: SparkSession, root: str, name: str, symbol: str, start: str, end: str, schema: str | None) -> DataFrame | None:
    """A stored table's files of a symbol and a range of days, under their own names; None if there is none.

    Folders are symbol/day or symbol=x/day=y. Without a schema the files' own are
    merged, so a column that only some have is null in the others, and none is lost.
    """
    reader = spark.read.schema(f"{schema}, symbol string, day string") if schema else spark.read.option("mergeSchema", "true")
    if exists(spark, f"{root}/{name}/{symbol}"):
        found = [at for d in days_between(start, end) if exists(spark, at := f"{root}/{name}/{symbol}/{d}")]
        if not found:
            return None
        df = reader.parquet(*found).withColumn("day", F.regexp_extract("_metadata.file_path", r"/([0-9]+)/[^/]*$", 1))
        return df.withColumn("symbol", F.lit(symbol))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/symbol=*")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        return None
    df = reader.parquet(f"{root}/{name}")
    return df.withColumn("day", F.col("day").cast("string")).filter((F.col("symbol") == symbol) & F.col("day").between(start, end))


def load(spark: SparkSession, root: str, name: str, symbol: str, start: str, end: str, columns=None, valid_only: bool = True, schema: str | None = None, numbers: bool = False) -> DataFrame:
    """A normalized table of one symbol and a closed range of days (YYYYMMDD), deduplicated and in order.

    Unknown tables raise; one without files for the range is empty. Stored names
    that differ by case only (u and U, p and P) are renamed (RENAMES), for which
    the session is made case sensitive, as Parquet files are read by its setting
    when they are scanned. Columns may be asked for by either name; keys are read
    beside them and dropped again. With numbers, prices and quantities in text
    become doubles. Of a book, rows that aren't valid go unless valid_only is
    false. Tables without keys come in the order of time.
    """
    from ..operators.dedup import keep_first, keep_last

    if name not in KEYS:
        raise ValueError(f"unknown table {name!r}")
    if end < start:
        raise ValueError("the range of days ends before it starts")
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = _stored(spark, root, name, symbol, start, end, schema)
    if df is None:
        df = empty(spark, name)
    names = RENAMES.get(name, {})
    df = df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])
    keys, which, order = KEYS[name]
    known = dict(empty(spark, name).dtypes)  # what no file has is null
    df = df.withColumns({c: F.lit(None).cast(kind) for c, kind in known.items() if c not in df.columns})
    if valid_only and "is_valid" in df.columns:
        df = df.filter("is_valid")
    if keys:
        df = (keep_first if which == "first" else keep_last)(df, list(keys), list(order))
        df = df.orderBy(*order)
    elif "time_ns" in df.columns:
        df = df.orderBy("time_ns")
    if numbers:
        df = to_numbers(df)
    return df.select(*[names.get(c, c) for c in columns]) if columns else df


def to_numbers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df with its text columns of NUMERIC (or columns) as doubles; text that is no number raises."""
    text = {c for c, kind in df.dtypes if kind == "string"}
    return df.withColumns({c: F.col(c).cast("double") for c in (columns or NUMERIC) if c in text})


def days_between(start, end) -> list[str]:
    """Days of a closed range as YYYYMMDD; takes dates or YYYY-MM-DD or YYYYMMDD."""
    from datetime import date, datetime, timedelta

    def day(x):
        if isinstance(x, datetime):
            return x.date()
        return x if isinstance(x, date) else datetime.strptime(str(x).replace("-", ""), "%Y%m%d").date()

    a, b = day(start), day(end)
    if b < a:
        raise ValueError("the range of days ends before it starts")
    return [f"{a + timedelta(i):%Y%m%d}" for i in range((b - a).days + 1)]


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip; damaged lines are kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def raw_messages(spark: SparkSession, root: str, symbol: str, day: str, limit: int = 1000) -> DataFrame:
    """(symbol, session, kind, recv, body) of a day's raw shards, as streaming.book.replay takes them.

    Shards lie in depth/symbol/day and rest/symbol/day below root or root/raw, as
    JSON lines (plain or gzip) whose raw holds what was received. Of the requests
    only depth snapshots that succeeded count; a snapshot without a limit of its
    own gets its request's, or the given one. Damaged lines and unfinished files
    (.tmp) go; damaged bodies stay, and the replay logs them.
    """
    root = f"{root}/raw" if exists(spark, f"{root}/raw") else root
    line = "recv_time_ns long, session_id string, endpoint string, status int, params struct<limit: string>, raw string"
    parts = []
    for kind, folder in (("depth", "depth"), ("snapshot", "rest")):
        path = f"{root}/{folder}/{symbol}/{day}"
        if exists(spark, path):
            d = read_jsonl(spark, path, line).filter("_corrupt_record IS NULL AND raw IS NOT NULL AND NOT input_file_name() LIKE '%.tmp'")
            body = F.col("raw")
            if kind == "snapshot":
                d = d.filter("endpoint LIKE '%/depth' AND status = 200")
                own = F.get_json_object("raw", "$.limit").isNotNull() | ~F.col("raw").rlike(r"^\s*\{\s*\"")
                most = F.coalesce(F.expr("try_cast(params.limit AS INT)"), F.lit(limit)).cast("string")
                body = F.when(own, body).otherwise(F.concat(F.lit('{"limit":'), most, F.lit(","), F.regexp_replace("raw", r"^\s*\{", "")))
            parts.append(d.select(F.lit(symbol).alias("symbol"), F.col("session_id").alias("session"), F.lit(kind).alias("kind"), F.col("recv_time_ns").alias("recv"), body.alias("body")))
    if not parts:
        return spark.createDataFrame([], "symbol string, session string, kind string, recv long, body string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def write_normalized(df: DataFrame, path: str, mode: str = "append", rows_per_file: int = 5_000_000, writers: int = 8) -> None:
    """Partitioned store (symbol, day) in zstd Parquet; files stay below a row limit.

    A symbol's day is written by up to `writers` tasks, so that a busy one isn't
    a single task's; small ones have that many small files at most.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(writers))
    df.repartition("symbol", "day", spread).write.partitionBy("symbol", "day").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).mode(mode).parquet(path)
