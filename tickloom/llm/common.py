"""Helpers that the text operators share: shared folders, shipping, columns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract: space, and tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python function gets at a time, or one longer text.
SLICE_BYTES = 6_000_000

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and
    the master is local, as in tests, a temporary folder is made and set; on a
    cluster a folder of this machine would be wrong, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts lineage: later stages depend on shared files and not on shuffle
    files of an executor that may be lost.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by saved() that no later plan reads; others are left alone."""
    for df in tables:
        if path := getattr(df, "_saved_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def numbered(rows: DataFrame) -> tuple[DataFrame, bool]:
    """rows (doc_id, text) with key, a long that is unique and ascends with doc_id; whether it is the id itself.

    It is where ids are integers, never null and unique. Else rows are sorted by
    id (nulls last) and text hash and numbered in a saved table, so that every
    row is a document of its own; of wholly equal rows it doesn't matter which
    comes first.
    """
    if dict(rows.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        n, different = rows.agg(F.count("*"), F.count_distinct("doc_id")).first()
        if n == different:
            return rows.withColumn("key", F.col("doc_id").cast("long")), True
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return saved(rows.orderBy(*order).withColumn("key", F.monotonically_increasing_id()), "numbered"), False


def picked(docs: DataFrame, id_col: str, of: Column, kept: DataFrame) -> DataFrame:
    """n of the rows of docs with each (id, of) of kept (id, of, n, rows), with the columns of docs.

    rows is how many there are; only where some but not all of them stay are they counted out.
    """
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    all_rows = docs.select(*own, F.col(id_col).alias("__id"), of.alias("__of"))
    on = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__of") == F.col("of"))
    if kept.filter("n < rows").isEmpty():
        out = all_rows.join(kept.select("id", "of"), on, "left_semi")
    else:
        turn = Window.partitionBy("__id", "__of").orderBy(F.lit(0))
        out = all_rows.withColumn("__turn", F.row_number().over(turn)).join(kept, on).filter("__turn <= n")
    return out.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="tickloom-zip-"), f"{root.name}-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def squeezed(text: Column) -> Column:
    """text with each run of white space as one space.

    The pattern skips runs that are one space already, so most words cost nothing.
    """
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def buckets_for(rows: int, each: int) -> int:
    """Number of buckets so that one holds about `each` of `rows` hashed rows."""
    return max(1, -(-int(rows) // each))


def map_texts(df: DataFrame, make, schema: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Run a function over (id, text) rows, Arrow batch by batch.

    df has the columns doc_id and text (not null). make() is called once a
    task and gives a function from a list of texts to a list of tuples, one per
    text; schema names the tuple's columns. The result has doc_id ahead of them.
    Batches are cut into slices of a few MB of text, so memory follows the
    longest text and not the batch.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    names = StructType.fromDDL(schema).names

    def run(batches):
        work = make()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                end, held = at, 0
                while end < batch.num_rows and (end == at or held < slice_bytes):
                    held += len(texts[end].as_buffer() or b"")
                    end += 1
                rows = work(texts.slice(at, end - at).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), *[pa.array([r[i] for r in rows], type=kinds[i]) for i in range(len(names))]], names=["doc_id", *names])
                at = end

    kind = dict(df.dtypes)["doc_id"]
    out = StructType.fromDDL(f"doc_id {kind}, {schema}")
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in list(to_arrow_schema(out))[1:]]
    return df.select("doc_id", "text").mapInArrow(run, out)


def slices(batches, slice_bytes: int = SLICE_BYTES):
    """(ids, texts) lists of the first two columns of Arrow batches, a few MB of text at a time."""
    for batch in batches:
        ids, texts, at = batch.column(0), batch.column(1), 0
        while at < batch.num_rows:
            end, held = at, 0
            while end < batch.num_rows and (end == at or held < slice_bytes):
                held += len(texts[end].as_buffer() or b"")
                end += 1
            yield ids.slice(at, end - at).to_pylist(), texts.slice(at, end - at).to_pylist()
            at = end


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
