"""Cutting lineage in the folder that the driver and all executors share, sizes, and shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and the master is local, as in tests, a temporary
    folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df from a table written in the shared folder, so that later stages don't compute it again.

    Unlike a checkpoint, which keeps the estimates of the plan that made it (they
    multiply from join to join), a table has its own size, by which joins are planned.
    """
    spark = df.sparkSession
    path = fresh(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that no other call gets."""
    return f"{shared_dir(spark)}/tickloom-{name}/{uuid.uuid4().hex}"


#: Rows up to which a table is small enough to send to every executor.
SMALL = 50_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has been counted to hold `most` rows at most; else left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="tickloom-zip-"), f"{root.name}-core.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
