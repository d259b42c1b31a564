"""Sinks of a stream whose files grow over micro-batches and are closed by size, age or day.

A micro-batch writes its rows as a part per key and day below open/. Once a
key's open parts are large or old enough, or its day is over, they are closed:
sorted, cut by size and written as shards, counted again, moved to their final
names and recorded in a manifest. What is open is a small table with a row per
part, one version per batch. Every step of a batch depends only on its rows and
on the version before, and overwrites what an attempt that failed left behind, so
a batch that is repeated after a restart loses nothing and writes nothing twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import carry
from ..sources import files
from ..sources.shared import cut, small
from ..sources.tables import day_of_ns, exists

PART = "kind string, symbol string, day string, batch long, n long, weight long, first_recv long, last_recv long, closed boolean"
MANIFEST = "path string, kind string, symbol string, day string, n_records long, size long, sha256 string, first_id long, last_id long, first_recv long, last_recv long, closed_batch long"
KEY = ["kind", "symbol", "day"]
SECOND = 1_000_000_000


@dataclass
class Rotating:
    """A sink for foreachBatch: rows with kind, symbol, recv_time_ns and a non-negative id are kept as files of root/kind/symbol/day.

    With text, a row is its column line (a JSON text) and its weight the line's
    bytes and the newline; shards are gzip. Without, rows are kept with all their
    columns but kind, a row weighs 1, and shards are zstd Parquet. A part is closed when its
    key's open weight reaches `most`, when `age_s` seconds of receipt lie between
    its first row and the batch's last, or when the batch has a later day. Rows
    that come for a closed day open a new part. A shard weighs `most` at most but
    for its last row. A session belongs to one checkpoint, whose batches number its
    files. Null kinds, symbols and times raise: such a row has no place.
    """

    root: str
    most: int = 256 << 20
    age_s: float = 3600.0
    text: bool = True
    session: str = "s0"
    ident: str = "id"

    @property
    def state(self) -> str:
        return f"{self.root}/_sink-{self.session}"

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        self._forget(spark, batch)
        opened = f"{self.state}/open/{batch}"
        weight = F.octet_length("line") + 1 if self.text else F.lit(1)
        placed = F.col("kind").isNotNull() & F.col("symbol").isNotNull() & F.col("recv_time_ns").isNotNull()
        day = F.when(placed, day_of_ns(F.col("recv_time_ns"))).otherwise(F.raise_error(F.lit("a row without kind, symbol or recv_time_ns")))
        out = rows.withColumns({"day": day, "__weight": weight.cast("long"), "__at": F.monotonically_increasing_id()})
        if self.text:
            out = out.select(*KEY, "recv_time_ns", F.col(self.ident).cast("long").alias("__id"), "line", "__weight", "__at")
        else:
            out = out.withColumn("__id", F.col(self.ident).cast("long"))
        out.write.mode("overwrite").parquet(opened)
        written = spark.read.schema(out.schema).parquet(opened)
        own = written.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("__weight").alias("weight"), F.min("recv_time_ns").alias("first_recv"), F.max("recv_time_ns").alias("last_recv"))
        own = own.select(*KEY, F.lit(batch).cast("long").alias("batch"), "n", "weight", "first_recv", "last_recv", F.lit(False).alias("closed"))
        last = max((v for v in _children(spark, f"{self.state}/parts") if v < batch), default=-1)
        self._rotate(spark, batch, self._open(spark, last).unionByName(own), "parts")

    def finish(self, spark: SparkSession, checkpoint: str) -> None:
        """Close all that is open, once the stream has stopped.

        checkpoint is the stream's: a last batch that isn't committed there would be
        repeated by the next run, so it raises. A later run goes on from here.
        """
        last = max(_children(spark, f"{self.state}/parts"), default=None)
        if last is not None:
            if not exists(spark, f"{checkpoint}/commits/{last}"):
                raise ValueError(f"batch {last} isn't committed: run the stream again first")
            self._rotate(spark, last, self._open(spark, last), "final")

    def manifest(self, spark: SparkSession) -> DataFrame:
        """MANIFEST rows of all closed shards."""
        at = f"{self.state}/manifests"
        return spark.read.schema(MANIFEST).parquet(f"{at}/*") if exists(spark, at) else spark.createDataFrame([], MANIFEST)

    def _open(self, spark: SparkSession, batch: int) -> DataFrame:
        """Parts that are open after a batch, and after a finish() that followed it."""
        at = f"{self.state}/final/{batch}"
        at = at if exists(spark, f"{at}/_SUCCESS") else f"{self.state}/parts/{batch}"
        return (spark.read.schema(PART).parquet(at) if exists(spark, at) else spark.createDataFrame([], PART)).filter("NOT closed")

    def _rotate(self, spark: SparkSession, batch: int, parts: DataFrame, step: str) -> None:
        """Write the version of the parts after a batch, and the shards of those that it closes."""
        now = parts.filter(F.col("batch") == batch).agg(F.max("last_recv")).first()[0]
        due = F.sum("weight").over(_own()) >= self.most
        if now is not None:
            due |= (F.min("first_recv").over(_own()) <= now - int(self.age_s * SECOND)) | (F.col("day") < day_of_ns(F.lit(now)))
        version = parts.withColumn("closed", F.lit(True) if step == "final" else due)  # a row per key and open batch
        at = f"{self.state}/{step}/{batch}"
        version.coalesce(1).write.mode("overwrite").parquet(f"{at}-next")
        done = spark.read.schema(PART).parquet(f"{at}-next").filter("closed")
        batches = [r.batch for r in done.select("batch").distinct().collect()]  # as many as were open
        if batches:
            self._close(spark, batch, done, batches, step)
        _move(spark, f"{at}-next", at)

    def _close(self, spark: SparkSession, batch: int, done: DataFrame, batches: list[int], step: str) -> None:
        rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{self.state}/open/{b}").withColumn("batch", F.lit(b).cast("long")) for b in batches])
        rows = rows.join(F.broadcast(done.select(*KEY, "batch")), [*KEY, "batch"])
        order = ["batch", "__at"]
        rows = carry.running_sum(rows, KEY, "recv_time_ns", order, F.col("__weight"), "__sum", 10 * SECOND)
        rows = cut(rows.withColumn("piece", F.floor((F.col("__sum") - F.col("__weight")) / self.most).cast("long")).drop("__sum"))
        place = F.struct("recv_time_ns", *order)
        shards = rows.groupBy(*KEY, "piece").agg(F.count("*").alias("n_records"), F.min_by("__id", place).alias("first_id"), F.max_by("__id", place).alias("last_id"), F.min("recv_time_ns").alias("first_recv"), F.max("recv_time_ns").alias("last_recv"))
        shards = cut(shards.withColumn("shard", F.row_number().over(Window.orderBy(*KEY, "piece"))))  # a row per shard
        stage = f"{self.state}/stage/{batch}-{step}"
        out = rows.join(small(shards.select(*KEY, "piece", "shard")), [*KEY, "piece"]).repartition("shard").sortWithinPartitions("shard", "recv_time_ns", *order)
        if self.text:
            out.select("shard", "line").write.mode("overwrite").partitionBy("shard").option("compression", "gzip").text(stage)
            back = spark.read.text(stage)
        else:
            own = [c for c in out.columns if c not in ("day", "piece", "batch", "__weight", "__at", "__id", "kind")]
            out.select(*own).write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(stage)
            back = spark.read.parquet(stage)
        counted = back.groupBy(F.col("shard").cast("int").alias("shard")).agg(F.count("*").alias("found"))
        sums = files.manifest(spark, stage, "part-*").withColumn("shard", F.regexp_extract("path", r"/shard=([0-9]+)/", 1).cast("int"))
        end = ".jsonl.gz" if self.text else ".parquet"
        name = F.concat_ws("/", F.lit(self.root), *KEY, F.format_string(f"{self.session}_%06d{'f' if step == 'final' else ''}_%04d{end}", F.lit(batch), F.col("piece")))
        checked = cut(shards.join(counted, "shard", "left").join(sums.withColumnRenamed("path", "staged"), "shard", "left").withColumn("path", name))
        if wrong := checked.filter("NOT found <=> n_records").limit(5).collect():
            raise ValueError(f"shards whose rows aren't those of their parts: {[(r.path, r.n_records, r.found) for r in wrong]}")
        for r in checked.select("staged", "path").toLocalIterator():  # a rename per shard
            _move(spark, r.staged, r.path)
        names = [c.split(" ")[0] for c in MANIFEST.split(", ")]
        checked.withColumn("closed_batch", F.lit(batch).cast("long")).select(*names).coalesce(1).write.mode("overwrite").parquet(f"{self.state}/manifests/{batch}-{step}")

    def _forget(self, spark: SparkSession, batch: int) -> None:
        """Delete what no batch needs any more, now that the one before is committed."""
        last = max((v for v in _children(spark, f"{self.state}/parts") if v < batch), default=None)
        if last is None:
            return
        needed = {r.batch for r in self._open(spark, last).select("batch").distinct().collect()}
        for name in ("open", "parts", "final"):
            for v in _children(spark, f"{self.state}/{name}"):
                if v < last and not (name == "open" and v in needed) or name == "open" and v == last and v not in needed:
                    _delete(spark, f"{self.state}/{name}/{v}")


def _own():
    return Window.partitionBy(*KEY)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[int]:
    """The whole numbers among the names in a folder."""
    fs, at = _at(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def _move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file or folder, in place of what an attempt before left under that name."""
    fs, at = _at(spark, path)
    end = _at(spark, to)[1]
    fs.mkdirs(end.getParent())
    fs.delete(end, True)
    if not fs.rename(at, end):
        raise OSError(f"can't rename {path} to {to}")
