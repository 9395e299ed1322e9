"""Lazy access to the driver's Parquet tables.

Every read is a plain ``spark.read.parquet``: projections and filters
written later reach the scan (``ReadSchema`` / ``PushedFilters``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Tables:
    """``Tables(spark, root).orders`` -> DataFrame of ``root/orders.parquet``.

    ``buckets``: rows of one subscription are dealt out to that many tasks
    (for views that are stored in buckets); without it, Spark decides."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark = spark
        self.root = root
        self.buckets = buckets

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, f"{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)
