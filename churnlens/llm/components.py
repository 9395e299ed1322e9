"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.frames import written


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each vertex that has an edge and is not the smallest of its
    component, with that smallest vertex.

    Large-star / small-star rounds (Kiveris et al. 2014): every step is a
    minimum per vertex, which map tasks reduce, and a join with it, so
    neighbour lists are never gathered.  Minima and edges are written tables:
    both sides of a join are then plain shuffles, and AQE splits a vertex that
    holds more bytes than a skewed partition may.  The driver sees only a count
    and a checksum per round."""
    both = edges.select("u", "v").where("u != v")
    state = None
    while True:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = written(large.distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        to_least = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        both = to_least.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
        both = written(both, "components")
        now = both.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return both
        state = now
