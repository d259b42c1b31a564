"""Mixing sources to target weights: random order, prefix sums, an exact cut.

Documents of a source stand in a hash-random order with distributed prefix sums
of their sizes. A source whose target is q full epochs and a remainder takes
every document q times, and once more those ahead of the remainder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ranking import BUCKET_ROWS, positions, unit

#: A source is repeated so many times at most.
EPOCHS = 3
#: Weights of the sources in order of their names, null last, repeating.
WEIGHTS = (1, 2, 3)


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): all sizes shared by weight.

    No target exceeds epochs times its source; the excess goes to the others by
    weight. Sources fill in the order of cap over weight: those ahead of the
    level are at their caps, the others share what is left by weight. A source
    without words has target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    df = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    df = df.withColumn("__cap", (F.col("source_size") * epochs).cast("double"))
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ahead = fill.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "__left": F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("__cap").over(ahead), F.lit(0.0)),
        "__wleft": F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(ahead), F.lit(0.0)),
    })
    # The first source that its share leaves below its cap sets the level for all that follow.
    df = df.withColumn("__level", F.when(F.col("__left") / F.col("__wleft") * F.col("__w") <= F.col("__cap"), F.col("__left") / F.col("__wleft")))
    df = df.withColumn("__level", F.first("__level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    return df.select("source", "source_size", F.coalesce(F.least(F.col("__level") * F.col("__w"), F.col("__cap")), F.col("__cap")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, epochs: int = EPOCHS, seed: int = 29, cut: str = "words", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, row_hash.

    size: words of the text, 0 for null. taken: words that the mix takes of the
    row, repeats counted. cut="words" meets each budget to the word: the document
    at the cut gives its first words. cut="document" takes that one whole if at
    least half of it fits. Ties (repeated ids) are ordered by text hash; wholly
    equal rows are interchangeable. Texts aren't shuffled.
    """
    text = common.text_or_empty(text_col)
    size = F.size(F.array_remove(F.split(common.squeezed(text), " "), "")).cast("long")
    rows = common.saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text).alias("row_hash")), "mix-rows")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    buckets = common.buckets_for(rows.count(), bucket_rows)
    rows = rows.withColumn("__u", unit(seed, "doc_id", "row_hash"))
    placed = positions(rows, ["source"], F.floor(F.col("__u") * buckets), ["__u", "doc_id", "row_hash"], "size")
    placed = placed.join(goal.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    full = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    placed = placed.withColumn("__full", full).withColumn("__rest", F.floor(F.col("target")).cast("long") - F.col("__full") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("before")))
    if cut == "document":
        part = F.when((2 * part >= F.col("size")) & (F.col("size") > 0), F.col("size")).otherwise(0)
    taken = F.col("__full") * F.col("size") + part
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "row_hash")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, whole documents only.

    Rows without words are never taken. Repeated rows are each taken as often as
    the one of them that is taken most.
    """
    own = plan(docs, id_col, text_col, source_col, cut="document", **kw)
    own = own.filter("taken > 0").groupBy(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")).agg(F.max(F.expr("taken div size")).cast("int").alias("__times"))
    both = docs.withColumn("__h", F.xxhash64(common.text_or_empty(text_col))).join(own, docs[id_col].eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")))
    both = both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return both.select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return plan(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
