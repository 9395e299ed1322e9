"""Join building blocks.

Physical choices are left to Spark: with AQE a side is broadcast only when
its measured size is under ``spark.sql.autoBroadcastJoinThreshold``; larger
sides stay sort-merge, and skewed partitions are split at runtime.  Explicit
``broadcast()`` is used only for dimensions with a fixed, proven bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.dates import int_date, int_date_to_date


def attach_left(left: DataFrame, right: DataFrame, on: Sequence[str], right_filter: Column | None = None) -> DataFrame:
    """Left join where an ON predicate only tests the right side.

    The predicate is applied to the right input *before* the join, so
    non-matching left rows are kept with NULLs (a WHERE after the join would
    drop them).
    """
    if right_filter is not None:
        right = right.filter(right_filter)
    return left.join(right, on=list(on), how="left")


def existence_flag(df: DataFrame, keys_df: DataFrame, on: Sequence[str], name: str,
                   keys_on: Sequence[str] | None = None) -> DataFrame:
    """Add ``name`` = 1 when the row's key occurs in ``keys_df`` else 0.

    The key side is reduced to distinct keys first, so the left rows are
    never multiplied.
    """
    keys_on = list(keys_on or on)
    marker = "__exists"
    keys = (keys_df.select(*[F.col(k).alias(o) for k, o in zip(keys_on, on)])
            .dropDuplicates().withColumn(marker, F.lit(1)))
    return (df.join(keys, on=list(on), how="left")
            .withColumn(name, F.coalesce(F.col(marker), F.lit(0)))
            .drop(marker))


def semi_by_aggregate(df: DataFrame, qualifying: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep rows whose key is in ``qualifying`` (a grouped, filtered
    aggregate); never multiplies rows."""
    return df.join(qualifying.select(*on), on=list(on), how="left_semi")


def band_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
              left_date: str, right_date: str, before: int, after: int) -> DataFrame:
    """Inner equi join on an id plus a day band on integer dates:
    ``right_date - before <= left_date <= right_date + after``.

    Written as a pure equi join on (id, day): every left row is expanded to
    the ``before + after + 1`` right dates its band can meet
    (``left_date - after .. left_date + before``), and the join key is
    (id, date).  Each matching pair meets on exactly one day, so the result
    is exact; the shuffle is keyed by (id, day), which spreads an id with a
    large share of the rows over its days instead of comparing all its rows
    in one task.  (The original's left join is turned inner by its WHERE
    clause, so only the inner form is needed.)
    """
    day = "__band_day"
    lo = int_date_to_date(left_date)
    days = F.transform(F.sequence(F.lit(0), F.lit(before + after)),
                       lambda i: int_date(F.date_add(lo, i - F.lit(after))))
    expanded = left.withColumn(day, F.explode(days))
    cond = (expanded[left_key] == right[right_key]) & (expanded[day] == right[right_date])
    return expanded.join(right, cond, "inner").drop(day)
