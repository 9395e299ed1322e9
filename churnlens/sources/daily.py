"""Tables with one folder per day, brought up to date day by day.

The original reports are run again with new dates, and each run stores its
tables anew.  :class:`DailyTable` rewrites only the days whose rows changed:
Spark's dynamic partition overwrite replaces the folders of the days that are
written and leaves all others alone.

Which days are up to date is a small table beside the data (day, number of
rows, digest of the rows), written after the data.  A refresh that was cut off
leaves its days with their old entry, so the next refresh writes them again.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.sources.warehouse import complete_attempts, jvm_fs


def row_digest(df: DataFrame) -> Column:
    """64-bit digest of a row, whatever the order of its map entries."""
    parts = [F.array_sort(F.map_entries(c)) if kind.startswith("map<") else F.col(c) for c, kind in sorted(df.dtypes)]
    # a NULL leaves a hash unchanged; its position tells where it stood
    return F.xxhash64(*[x for i, p in enumerate(parts) for x in (F.when(p.isNull(), F.lit(i)), p)])


class DailyTable:
    """A folder with one sub-folder per value of ``day_col``.

    One refresh at a time may run; a reader that opened the table before a
    refresh opens it again afterwards.  Rows without a day are kept in a folder
    of their own, as Spark's writer does.
    """

    def __init__(self, spark: SparkSession, path: str, day_col: str):
        self.spark, self.path, self.day_col = spark, path, day_col
        self._state = os.path.join(path, "_days")  # not listed as data

    def committed(self) -> DataFrame:
        """day, n, digest of the days that are up to date."""
        done = complete_attempts(self.spark, self._state)
        if not done:
            return self.spark.createDataFrame([], "day int, n bigint, digest decimal(38,0)")
        return self.spark.read.parquet(done[0])

    def _digests(self, rows: DataFrame) -> DataFrame:
        digest = row_digest(rows).cast("decimal(38,0)")
        return (rows.groupBy(F.col(self.day_col).cast("int").alias("day"))
                .agg(F.count(F.lit(1)).alias("n"), F.sum(digest).cast("decimal(38,0)").alias("digest")))

    def _of(self, days: list) -> Column:
        day = F.col(self.day_col)
        known = day.isin([d for d in days if d is not None])
        return known | day.isNull() if None in days else known

    def refresh(self, rows: DataFrame, days: Iterable[int] | None = None) -> tuple[list, list]:
        """Make the table hold ``rows``; with ``days``, only these days are
        read (the test reaches the scan) and written.  Returns the days
        written and the days removed.

        A day is written if its count or digest differs from the committed
        one, and removed if it has no rows any more."""
        listed = None if days is None else list(days)
        rows = rows if listed is None else rows.filter(self._of(listed))
        old = self.committed()
        in_scope = F.lit(True) if listed is None else F.col("day").isin(listed)
        new = self._digests(rows)
        o = old.filter(in_scope).select(F.col("day").alias("o_day"), F.col("n").alias("o_n"), F.col("digest").alias("o_digest"), F.lit(1).alias("o"))
        both = new.withColumn("s", F.lit(1)).join(o, F.col("day").eqNullSafe(F.col("o_day")), "full")
        # one row per day
        state = both.select(F.when(F.col("s") == 1, F.col("day")).otherwise(F.col("o_day")).alias("day"), "n", "digest", "s", "o",
                            (F.col("n").eqNullSafe(F.col("o_n")) & F.col("digest").eqNullSafe(F.col("o_digest"))).alias("same")).collect()
        changed = [r.day for r in state if r.s and not (r.o and r.same)]
        gone = [r.day for r in state if not r.s]
        if changed:
            (rows.filter(self._of(changed)).hint("rebalance", self.day_col).sortWithinPartitions(self.day_col)
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day_col).parquet(self.path))
        for day in gone:
            fs, p = jvm_fs(self.spark, os.path.join(self.path, f"{self.day_col}={'__HIVE_DEFAULT_PARTITION__' if day is None else day}"))
            fs.delete(p, True)
        if changed or gone:
            kept = [tuple(r) for r in old.collect() if listed is not None and r.day not in listed]
            entries = kept + [(r.day, r.n, r.digest) for r in state if r.s]
            table = self.spark.createDataFrame(entries, old.schema).coalesce(1)
            table.write.parquet(os.path.join(self._state, f"attempt-{uuid.uuid4().hex}"))
        return changed, gone

    def read(self) -> DataFrame:
        """The table; an empty one has no folder to read yet."""
        return self.spark.read.parquet(self.path)
