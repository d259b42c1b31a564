"""Exact dedup by an extendible-hash index on shared files.

The key of a text is a 64-bit hash of its normalised form. The directory maps a
prefix of the key to a bucket; while a bucket holds more keys than it may, the
directory doubles (one more bit) and the overfull buckets split, for as many
bits as it takes. Its slots are ranges of keys. Copies of a text collapse to a
few entries ahead of the shuffle (eight salts, so a text that holds a third of
all rows is no hot group); then every slot's owner task gets the entries of its
range, chains those with one key, tells texts of a chain apart by their bytes
and finds each text's smallest id and its number of copies. The index is written
to the shared folder, and rows look their group up in it.

Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Distinct keys that a bucket holds before it splits.
BUCKET_KEYS = 4096
#: Entries that a text's copies collapse to, at most, before they meet at their owner.
SALTS = 8
#: A text with at least this share of all rows is looked up by broadcast; there are no more such texts than this.
HOT_TEXTS = 1024
#: Bits by which buckets can split before the cells are counted anew.
FINER = 10


def _prefix(key, bits: int):
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def global_depth(n_keys: int, bucket_keys: int = BUCKET_KEYS) -> int:
    """Bits of a directory whose buckets hold bucket_keys keys on average at most."""
    depth = 0
    while n_keys > bucket_keys << depth:
        depth += 1
    return depth


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Buckets of the distinct `key`s: (prefix, depth, n_keys).

    Returns one row per bucket. A bucket with more than bucket_keys (1 at least)
    keys splits by its next bits until none is overfull. The driver sees one
    count and one flag per doubling, never the keys. An empty input gives no bucket.
    """
    depth, keys, settled = global_depth(keys.count(), bucket_keys), keys.select("key"), None
    while True:
        fine = min(64, depth + FINER)
        cells = common.saved(keys.groupBy(_prefix(F.col("key"), fine).alias("cell")).agg(F.count("*").alias("n")), "cells")
        while True:
            prefix = F.shiftrightunsigned("cell", fine - depth) if depth else F.lit(0).cast("long")
            level = cells.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n_keys"))
            full = level.filter(F.col("n_keys") > bucket_keys).select("prefix")
            done = level.filter(F.col("n_keys") <= bucket_keys).select("prefix", F.lit(depth).alias("depth"), "n_keys")
            settled = done if settled is None else settled.unionByName(done)
            if full.isEmpty():
                return settled
            if depth == fine:
                break
            cells = cells.withColumn("prefix", prefix).join(full, "prefix", "left_semi").select("cell", "n")
            depth += 1
        keys = common.saved(keys.withColumn("prefix", _prefix(F.col("key"), depth)).join(full, "prefix", "left_semi").select("key"), "overfull")
        depth += 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, hash_bits: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical after each run of white space became one
    space; a null text counts as empty. Of equal texts the row with the smallest
    id stays (null ids sort last; where all ids are null, keep_id is null and
    every row stays). Repeated rows with the smallest id all carry kept = true.
    Other columns of the input are ignored; an empty table gives an empty table.

    hash_bits lowers the number of hash bits, so tests can force collisions.
    bucket is the key's bucket in the directory (depth:prefix), chain the number
    of different texts that share the key.
    """
    text = common.squeezed(common.text_or_empty(text_col))
    whole = F.xxhash64("norm")
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm")).withColumn("key", whole if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(whole, 64 - hash_bits), 64 - hash_bits))
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    keyed = common.saved(base.select("doc_id", "key", sha.alias("text_sha256")), "keyed")
    index, hot = build_index(base, keyed, bucket_keys)

    found = ["key", "text_sha256", "keep_id", "group_size", "chain", "bucket"]
    on = ["key", "text_sha256"]
    # At most HOT_TEXTS texts hold a share of 1 / HOT_TEXTS of the rows each: their rows stay where they are.
    many = F.broadcast(index.filter(F.col("group_size") >= hot).select(*found))
    rows = keyed.join(many, on).unionByName(keyed.join(many, on, "left_anti").join(index.filter(F.col("group_size") < hot).select(*found), on))
    return rows.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256", "bucket", "chain")


def build_index(base: DataFrame, keyed: DataFrame, bucket_keys: int) -> tuple[DataFrame, int]:
    """The index (key, text_sha256, keep_id, group_size, chain, bucket), and the rows from which on a text is hot."""
    keys = common.saved(keyed.select("key").distinct(), "keys")
    buckets = common.saved(directory(keys, bucket_keys), "directory")
    depth = buckets.agg(F.min("depth")).first()[0] or 0
    # Copies collapse within each salt; then a slot's owner gets all entries of its range of keys.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    entries = base.groupBy("key", "norm", salt.alias("salt")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = entries.withColumn("slot", _prefix(F.col("key"), depth)).repartition("slot")
    # The byte comparison: texts of a chain are grouped by their whole text.
    texts = owned.groupBy("slot", "key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    texts = texts.select("slot", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    texts = common.saved(texts.withColumn("chain", F.count("*").over(Window.partitionBy("slot", "key"))).drop("slot"), "texts")
    # A key meets its bucket at whichever depth that has: one candidate prefix per depth in use.
    depths = [r[0] for r in buckets.select("depth").distinct().collect()] or [0]  # 65 at most
    entry = texts.withColumn("at", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("key"), d).alias("prefix")) for d in depths])))
    entry = entry.select("key", "text_sha256", "keep_id", "group_size", "chain", "at.depth", "at.prefix").join(buckets.select("depth", "prefix"), ["depth", "prefix"])
    bucket = F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("prefix").cast("string"))
    index = common.saved(entry.withColumn("bucket", bucket).drop("depth", "prefix"), "index")
    total = index.agg(F.sum("group_size")).first()[0] or 0
    common.discard(keys, texts)
    return index, max(1000, -(-total // HOT_TEXTS))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows with equal texts one, with all its columns: that of the smallest id.

    Texts are equal as in exact_dedup; null ids sort last. Rows of one id and
    different texts are judged apart. Of several rows with the id and the text
    that stay, one stays, whichever. An empty table gives an empty table.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("of")).agg(F.count("*").alias("rows"))
    kept = common.saved(kept.withColumn("n", F.lit(1)), "kept")
    return common.picked(docs, id_col, F.sha2(common.squeezed(common.text_or_empty(text_col)).cast("binary"), 256), kept)


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return exact_dedup(common.documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
