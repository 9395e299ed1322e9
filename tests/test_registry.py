"""The driver compares Spark and oracle results column by column name:
every registered query must have unique names made of letters, digits and underscores (names of
external report files keep their camelCase)."""

import re

from churnlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_column_names_unique_and_plain(spark):
    for name, fn in QUERIES.items():
        cols = fn(spark, SF).columns
        assert len(cols) == len(set(cols)), name
        assert all(re.fullmatch(r"[a-z][A-Za-z0-9_]*", c) for c in cols), \
            (name, cols)
