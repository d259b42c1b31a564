"""Zipped bar files, file manifests, and routing of one feed to several tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "open_ms long, open double, high double, low double, close double, volume double, quote_volume double, n_trades double, buy_volume double"
#: Positions of the columns of BARS in a line.
PLACES = (0, 1, 2, 3, 4, 5, 7, 8, 9)


def read_zipped_bars(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """Bars of zipped CSV files, a task per file; lines that don't begin with a digit are headers.

    Equal open times are all kept: pass the result to dedup.keep_first where one
    of them is wanted. The file's path and the line's place give that order.
    """

    def lines(batches):
        import io
        import zipfile

        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = []
                    for name in sorted(z.namelist()):
                        for at, line in enumerate(z.read(name).decode().splitlines()):
                            if line[:1].isdigit():
                                v = line.split(",")
                                rows.append((int(v[0]), *[float(v[i]) for i in PLACES[1:]], path, at))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BARS.split(", ")] + ["path", "line"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(lines, f"{BARS}, path string, line long")


def reference_bars(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """read_zipped_bars with each open time once, the first by file and line; no bars where path has no such file."""
    from ..operators.dedup import keep_first
    from .tables import exists

    if not exists(spark, path):
        return spark.createDataFrame([], f"{BARS}, path string, line long")
    return keep_first(read_zipped_bars(spark, path, glob), ["open_ms"], ["path", "line"])


def daily_check(spark: SparkSession, raw: str, recorded: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], report: str) -> bool:
    """Write a day's verify_day as a report; whether all of it is well."""
    write_report(verify_day(spark, raw, recorded, tables), report)
    return spark.read.schema("ok boolean").json(report).filter("NOT ok").isEmpty()


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, symbol, day) of the files below path, without their content.

    symbol and day come from folders of the form symbol=x/day=y, else they are null.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    part = lambda k: F.nullif(F.regexp_extract("path", rf"/{k}=([^/]*)/", 1), F.lit(""))
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), part("symbol").alias("symbol"), part("day").alias("day"))


def available_days(spark: SparkSession, root: str, table: str, symbol: str) -> list[str]:
    """Days for which a table has files of a symbol, in order: as many as there are days."""
    from .tables import exists

    if not exists(spark, f"{root}/{table}"):
        return []
    days = listing(spark, f"{root}/{table}", "*.parquet").filter((F.col("symbol") == symbol) & F.col("day").rlike("^[0-9]+$"))
    return [r.day for r in days.select("day").distinct().orderBy("day").collect()]


def latest_files(spark: SparkSession, root: str, table: str, symbol: str, n: int) -> DataFrame:
    """The n last files of a symbol by day and path, in that order."""
    f = listing(spark, f"{root}/{table}", "*.parquet").filter(F.col("symbol") == symbol)
    return f.orderBy(F.desc("day"), F.desc("path")).limit(n).orderBy("day", "path")


def inventory(spark: SparkSession, root: str, table: str, t: str) -> DataFrame:
    """(symbol, day, files, size, n_rows, t_min, t_max) of a partitioned table, with totals per symbol and over all.

    Counts and ends of t are pushed down to the files' footers: the table is read
    by the second Parquet reader with aggregate push-down, in a session of its
    own so that this one's settings stay. Files and sizes come from a listing.
    """
    own = spark.newSession()
    sources = [s for s in own.conf.get("spark.sql.sources.useV1SourceList").split(",") if s != "parquet"]
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(sources))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    d = own.read.parquet(f"{root}/{table}")
    per = d.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi")).withColumn("day", F.col("day").cast("string"))
    found = listing(own, f"{root}/{table}", "*.parquet").groupBy("symbol", "day").agg(F.count("*").alias("files"), F.sum("size").alias("size"))
    both = per.join(found, ["symbol", "day"])
    return both.rollup("symbol", "day").agg(F.sum("files").alias("files"), F.sum("size").alias("size"), F.sum("n").alias("n_rows"), F.min("lo").alias("t_min"), F.max("hi").alias("t_max"))


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of each file; a file is one value, so below 2 GB."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def shard_manifest(spark: SparkSession, path: str, id_field: str = "u", glob: str = "*.jsonl*") -> DataFrame:
    """manifest with n_records, first_id and last_id of JSON-line files, by the place of lines in the file."""
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("at")).filter("value <> ''")
    ident = F.get_json_object("value", f"$.{id_field}").cast("long")
    per = lines.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n_records"), F.min_by(ident, "at").alias("first_id"), F.max_by(ident, "at").alias("last_id"))
    return manifest(spark, path, glob).join(per, "path", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))


def manifest_check(spark: SparkSession, recorded: DataFrame, path: str, glob: str = "*", columns=("size", "sha256")) -> DataFrame:
    """(path, status) of recorded (path, columns) against the files: matched, mismatched, only_left or only_right.

    With n_records among the columns, files are read as lines of JSON.
    """
    from ..operators.dedup import diff

    now = shard_manifest(spark, path, glob=glob) if "n_records" in columns else manifest(spark, path, glob)
    return diff(recorded, now, ["path"], list(columns))


def verify_day(spark: SparkSession, raw: str, recorded: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], glob: str = "*.jsonl*") -> DataFrame:
    """(what, status, n): a day's files against their manifests, and duplicate keys of its tables.

    Files without a manifest (only_right: still open) don't fail the day; others that
    don't match, and duplicate keys, do: their rows have ok = false.
    """
    from ..operators.dedup import duplicate_audit

    out = manifest_check(spark, recorded, raw, glob, ("size", "sha256", "n_records")).groupBy("status").agg(F.count("*").alias("n"))
    out = out.select(F.lit("raw").alias("what"), "status", "n", F.col("status").isin("matched", "only_right").alias("ok"))
    for name, (df, keys) in tables.items():
        a = duplicate_audit(df, keys)
        out = out.unionByName(a.select(F.lit(name).alias("what"), F.lit("duplicate_keys").alias("status"), F.col("duplicate_keys").alias("n"), "ok"))
    return out


def write_report(rows: DataFrame, path: str) -> None:
    """A report's rows as JSON lines: a small table, in one file that replaces the last."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that takes its place at once: readers see the old text or the new one, never a part."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    end = jvm.org.apache.hadoop.fs.Path(path)
    start = jvm.org.apache.hadoop.fs.Path(end.getParent(), f"_{end.getName()}.next")
    out = end.getFileSystem(conf).create(start, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    fs = end.getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(start), fs.makeQualified(end), over)


def route(root: str, tables: dict[str, tuple[Column, list[Column]]]):
    """A foreachBatch function that writes a feed's rows to several tables.

    tables: name to (which rows, their columns). Every batch owns one folder per
    table, which a repeated batch overwrites, so none is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, (which, columns) in tables.items():
                batch.filter(which).select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def ticks(price: Column, unit: str) -> Column:
    """price (text) as a whole number of units; raises where it isn't one, never rounds."""
    n = price.cast("decimal(28,10)") / F.lit(unit).cast("decimal(10,8)")
    return F.when(n == F.floor(n), n.cast("long")).when(price.isNotNull(), F.raise_error(F.concat(price, F.lit(f" isn't a multiple of {unit}"))).cast("long"))


def instrument_specs(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, tick, step) of trading perpetuals quoted in USDT, from an exchange-information file."""
    schema = "symbols array<struct<symbol: string, contractType: string, quoteAsset: string, status: string, filters: array<struct<filterType: string, tickSize: string, stepSize: string>>>>"
    s = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.inline("symbols"))
    pick = lambda kind, field: F.get(F.filter("filters", lambda f: f["filterType"] == kind), F.lit(0))[field]
    live = s.filter("contractType = 'PERPETUAL' AND quoteAsset = 'USDT' AND status = 'TRADING'")
    return live.select("symbol", pick("PRICE_FILTER", "tickSize").alias("tick"), pick("LOT_SIZE", "stepSize").alias("step"))


def required_specs(specs: DataFrame, symbols: list[str]) -> DataFrame:
    """specs of the symbols; a symbol that has none (unknown, or no trading perpetual) raises when the rows are read."""
    want = specs.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    problem = F.raise_error(F.concat(F.lit("no trading perpetual: "), F.col("symbol"))).cast("string")
    return want.join(specs, "symbol", "left").withColumn("tick", F.coalesce("tick", problem))


def spec_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, old_tick, new_tick, old_step, new_step) where a later file of specs differs: their books start over."""
    a, b = (d.select("symbol", F.col("tick").alias(f"{n}_tick"), F.col("step").alias(f"{n}_step")) for d, n in ((old, "old"), (new, "new")))
    return a.join(b, "symbol").filter("NOT (old_tick <=> new_tick AND old_step <=> new_step)").select("symbol", "old_tick", "new_tick", "old_step", "new_step")
