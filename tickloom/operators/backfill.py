"""Filling gaps of ids from a paged source in rounds, with attempts, page limits and the source's reach as state.

A round asks for every open gap at once. What is known of the gaps, and the rows
found, are tables with a version per round; the gaps' version is written last, so
a round that dies is done again and its rows are overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import exists
from . import carry, dedup, monitor


@dataclass
class Backfill:
    """Gaps (keys, from_a, to_a, start_t) of a feed in a folder of their own.

    In a round a gap costs an attempt and gets pages of `page` rows each, `pages`
    at most, of the source's rows inside it that it hasn't yet, by id. Once all its
    ids are there it is repaired; after its last attempt, or where a round used
    all pages, it is partial, or unrepairable if it has none; one that began `reach`
    or longer ago is unrepairable unasked. A failed request costs the attempt and
    leaves the gap open; a refused one takes all its attempts.
    """

    root: str
    keys: list[str]
    a: str = "a"
    page: int = 1000
    pages: int = 50
    attempts: int = 5
    reach: int | None = None

    def start(self, gaps: DataFrame) -> None:
        """Take these gaps as round 0; of ones that begin alike the first by from_a and to_a counts. Gaps known already stay."""
        spark = gaps.sparkSession
        if self.round(spark) is None:
            own = dedup.keep_first(gaps.select(*self.keys, "from_a", "to_a", "start_t"), [*self.keys, "from_a"], ["to_a", "start_t"])
            zero = F.lit(0).cast("long")
            own = own.select("*", zero.alias("attempts"), zero.alias("pages"), zero.alias("n_filled"), F.lit("open").alias("status"))
            own.write.mode("overwrite").parquet(f"{self.root}/gaps/0")

    def round(self, spark: SparkSession) -> int | None:
        """The last round whose gaps are written; None ahead of start()."""
        done = -1
        while exists(spark, f"{self.root}/gaps/{done + 1}/_SUCCESS"):
            done += 1
        return None if done < 0 else done

    def gaps(self, spark: SparkSession) -> DataFrame:
        """All gaps after the last round: keys, from_a, to_a, start_t, attempts, pages, n_filled, status."""
        return spark.read.parquet(f"{self.root}/gaps/{self.round(spark)}")

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """The rows found up to the last round, with from_a of their gap; None ahead of the first."""
        found = [f"{self.root}/rows/{n}" for n in range(1, (self.round(spark) or 0) + 1)]
        return spark.read.parquet(*found) if found else None

    def pending(self, spark: SparkSession) -> bool:
        return not self.gaps(spark).filter((F.col("status") == "open") & (F.col("attempts") < self.attempts)).isEmpty()

    def step(self, source: DataFrame, now: int, failed: DataFrame | None = None, refused: DataFrame | None = None) -> None:
        """A round over what the source has at `now`; failed and refused name keys whose requests came to nothing."""
        spark, keys, a = source.sparkSession, self.keys, self.a
        at, known, gap = (self.round(spark) or 0) + 1, self.gaps(spark), [*self.keys, "from_a"]
        tried = (F.col("status") == "open") & (F.col("attempts") < self.attempts)
        beyond = F.coalesce(F.lit(now) - F.col("start_t") >= self.reach, F.lit(False)) if self.reach is not None else F.lit(False)
        asked = known.filter(tried & ~beyond)
        for other, name in ((failed, "__failed"), (refused, "__refused")):
            mark = F.lit(True).alias(name)
            known = carry.matched(known, other.select(*keys, mark).distinct(), keys, "left") if other is not None else known.withColumn(name, F.lit(None).cast("boolean"))
            asked = carry.matched(asked, other.select(*keys).distinct(), keys, "left_anti") if other is not None else asked

        # rows of the gaps asked for that weren't found before; each gap keeps its first pages, which Spark ranks ahead of the shuffle too
        inside = monitor.in_gaps(dedup.keep_first(source, [*keys, a], source.columns), asked.select(*keys, "from_a", "to_a"), keys, a)
        if (before := self.rows(spark)) is not None:
            inside = carry.matched(inside, before.select(*keys, a), [*keys, a], "left_anti")
        rank = F.row_number().over(Window.partitionBy(*gap).orderBy(a))
        inside.withColumn("__r", rank).filter(F.col("__r") <= self.page * self.pages).drop("__r", "to_a").write.mode("overwrite").parquet(f"{self.root}/rows/{at}")

        got = spark.read.parquet(f"{self.root}/rows/{at}").groupBy(*gap).agg(F.count("*").alias("__n"), F.max(a).alias("__last"))
        d = carry.matched(known, got, gap, "left")
        n = F.coalesce("__n", F.lit(0))
        answered = tried & ~beyond & F.col("__failed").isNull() & F.col("__refused").isNull()
        # a page that ends ahead of the gap's end is followed by another
        used = F.least(F.ceil(n / self.page) + F.when((n % self.page == 0) & (F.coalesce("__last", F.lit(-1)) < F.col("to_a")), 1).otherwise(0), F.lit(self.pages))
        d = d.withColumns({"__tried": tried, "__beyond": tried & beyond, "__answered": answered, "__used": F.when(answered, used).otherwise(0)})
        attempts = F.when(~F.col("__tried"), F.col("attempts")).when(F.col("__refused"), self.attempts).otherwise(F.col("attempts") + 1)
        d = d.withColumns({"attempts": attempts.cast("long"), "pages": (F.col("pages") + F.col("__used")).cast("long"), "n_filled": F.col("n_filled") + n})
        over = (F.col("attempts") >= self.attempts) | (F.col("__used") >= self.pages)
        some = F.when(F.col("n_filled") > 0, "partial").otherwise("unrepairable")
        status = F.when(F.col("__beyond"), "unrepairable").when(~F.col("__answered"), F.col("status")).when(F.col("n_filled") == F.col("to_a") - F.col("from_a") + 1, "repaired").when(over, some).otherwise("open")
        d.withColumn("status", status).select(*keys, "from_a", "to_a", "start_t", "attempts", "pages", "n_filled", "status").write.mode("overwrite").parquet(f"{self.root}/gaps/{at}")
