"""Window building blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[Column], name: str) -> DataFrame:
    """``row_number() over (partition by ... order by ...)``.

    ``order_cols`` must give a total order inside a partition, otherwise the
    numbering is not deterministic.
    """
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(name, F.row_number().over(w))


def dedupe_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], nearly_unique: bool = False) -> DataFrame:
    """One row per key: the row that sorts first on ``order_by`` (ascending,
    NULLs first), i.e. ``row_number() over (partition by keys order by ...) = 1``.

    ``nearly_unique``: hardly any key repeats, so that reducing before the
    shuffle saves little.  The row is then taken by a window, whose group limit
    Spark also applies inside each map task, so a key that does repeat often
    still costs one row per task.  All other columns break ties.

    Otherwise written as ``min(struct(order_by..., rest...))`` per key.  A struct has no
    fixed-width buffer, so Spark plans a sort-based aggregate: each map task
    sorts its rows by key and keeps one candidate per key before the shuffle.
    A key holding a third of all rows then costs one row per task.
    """
    keys = list(keys)
    order_by = list(order_by)
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    if nearly_unique:
        sortable = [c for c in order_by + rest if not df.schema[c].dataType.typeName().startswith("map")]
        ranked = rank_within(df, keys, [F.col(c).asc_nulls_first() for c in sortable], "__rank")
        return ranked.filter("__rank = 1").select(*df.columns)
    packed = F.min(F.struct(*[F.col(c) for c in order_by + rest])).alias("__first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col("__first")[c].alias(c) for c in order_by + rest]).select(*df.columns)


def event_sequence(df: DataFrame, key: str, order_col: str, tie_col: str, bucket_col: str,
                   name: str = "row_cnt") -> DataFrame:
    """``row_number() over (partition by key order by order_col, tie_col)``
    that stays balanced when one key holds a large share of the rows.

    Rows are cut into (key, bucket) slices, where ``bucket_col`` is a coarse
    value that never decreases as ``order_col`` grows (for example the event
    day; a NULL bucket sorts first).  Slice sizes are
    counted (map-side aggregation), turned into per-key offsets with a window
    over the small slice table, and each slice is numbered on its own.  A hot
    key is therefore numbered by as many tasks as it has buckets.
    """
    sizes = df.groupBy(key, bucket_col).agg(F.count(F.lit(1)).alias("__n"))
    w_prev = Window.partitionBy(key).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("__off", F.coalesce(F.sum("__n").over(w_prev), F.lit(0)))
               .select(F.col(key).alias("__k"), F.col(bucket_col).alias("__b"), "__off"))
    # null-safe: rows with a NULL key or bucket are numbered too, as row_number does
    cond = df[key].eqNullSafe(offsets["__k"]) & df[bucket_col].eqNullSafe(offsets["__b"])
    w = Window.partitionBy(key, bucket_col).orderBy(F.col(order_col), F.col(tie_col))
    return (df.join(offsets, cond, "inner").drop("__k", "__b")
            .withColumn(name, (F.row_number().over(w) + F.col("__off")).cast("int"))
            .drop("__off"))


def event_sequence_by_range(df: DataFrame, key: str, order_col: str, tie_col: str, store: Callable[[DataFrame], DataFrame],
                            name: str = "row_cnt") -> DataFrame:
    """``row_number() over (partition by key order by order_col, tie_col)``
    for keys of any size: rows are sorted over all tasks by (key, order, tie),
    so that a key, and any one moment of it, spans as many tasks as its rows
    need.

    ``store`` writes a table and reads it again; it fixes the order of the
    rows in their tasks, so that the numbers do not change when a task is run
    again.  A row's number is its place among its key's rows in its task, plus
    the key's rows in earlier tasks: a window over one row per (key, task).
    """
    order = [F.col(c).asc_nulls_first() for c in (key, order_col, tie_col)]
    ordered = store(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(F.col(key).alias("__k"), part.alias("__p")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    rows = ordered.withColumn("__part", part)
    cond = rows[key].eqNullSafe(sizes["__k"]) & (rows["__part"] == sizes["__p"])
    return (rows.join(sizes, cond, "inner").withColumn(name, (F.col("__at") - F.col("__first") + F.col("__off") + 1).cast("int"))
            .select(*df.columns, name))
