"""Aggregation building blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_distinct_counts(
    df: DataFrame,
    group_cols: Sequence[str],
    id_col: str,
    counts: Mapping[str, Column | None],
) -> DataFrame:
    """Several ``count(distinct case when p then id end)`` at one grain.

    ``counts`` maps an output name to a predicate (``None`` counts every
    non-NULL id).  Instead of one ``Expand`` copy of the input per distinct
    expression, the input is reduced once to one row per (group, id) holding
    ``max(flag)`` per predicate, then the flags are summed per group.  Both
    steps aggregate map-side before their shuffle, and the first shuffle is
    keyed by (group, id), so a hot group is spread over many tasks.

    A group whose ids are all NULL or never match still gets a row of zeros,
    as ``count(distinct ...)`` gives.
    """
    ident = F.col(id_col)
    flags = []
    for name, pred in counts.items():
        hit = ident.isNotNull() if pred is None else (ident.isNotNull() & pred)
        flags.append(F.max(F.when(hit, F.lit(1)).otherwise(F.lit(0))).alias(name))
    per_id = df.groupBy(*group_cols, id_col).agg(*flags)
    return per_id.groupBy(*group_cols).agg(
        *[F.sum(name).cast("bigint").alias(name) for name in counts]
    )


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator * 1.0 / denominator`` as DOUBLE; NULL when the denominator
    is 0 or NULL (plain division fails the job under ANSI mode)."""
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(num.cast("double"), den.cast("double"))


def missingness_crosstab(df: DataFrame, cols: Mapping[str, str], count_name: str = "cnt",
                         weight: str | None = None) -> DataFrame:
    """Row counts per combination of NULL indicators.

    ``cols`` maps an output flag name to the column tested for NULL;
    ``weight`` names a column of row counts, for pre-aggregated input.
    """
    flags = [F.when(F.col(c).isNull(), F.lit(1)).otherwise(F.lit(0)).alias(name) for name, c in cols.items()]
    return df.groupBy(*flags).agg((F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")).alias(count_name))
