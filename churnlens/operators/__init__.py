"""Relational building blocks shared by the analyses."""

from churnlens.operators.aggregates import (
    conditional_distinct_counts,
    missingness_crosstab,
    safe_ratio,
)
from churnlens.operators.joins import (
    attach_left,
    band_join,
    existence_flag,
    semi_by_aggregate,
)
from churnlens.operators.windows import dedupe_first, event_sequence, event_sequence_by_range, rank_within

__all__ = [
    "attach_left", "band_join", "conditional_distinct_counts", "dedupe_first", "event_sequence",
    "event_sequence_by_range", "existence_flag", "missingness_crosstab", "rank_within", "safe_ratio", "semi_by_aggregate",
]
