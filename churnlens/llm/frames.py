"""Shared DataFrame shapes of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from churnlens.session import shared_dir

#: Stands for a null id in join keys, so that the key is never null.
NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """One given table, by a path that Spark's reader resolves."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``key``, ``tag``, ``text``, ``row``.

    (key, tag) stands for a document in joins.  ``key`` is the id; ``tag``
    is the text's CRC, so that rows that share an id but not a text stay
    apart, and is over 2**32 where the id is null.  Neither is ever null:
    two joins on them then shuffle the text in the same way, and Spark uses
    one exchange for both.  ``row`` holds every other column of the input,
    whatever its name.
    """
    rest = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("key"),
        (F.crc32(text.cast("binary")) + F.when(F.col(f"`{id_col}`").isNull(), F.lit(1 << 33)).otherwise(F.lit(0))).alias("tag"),
        text.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
    )


def has_id() -> Column:
    return F.col("tag") < (1 << 33)


def unkeyed(df: DataFrame, docs: DataFrame, text_col: str, text: Column | None, **results: Column) -> DataFrame:
    """The input's columns again, in their order (with ``text`` in place of
    the text), then the results.  An input column that has a result's name
    gives way to the result."""
    out = [
        (text if text is not None else F.col("text")).alias(c) if c == text_col else F.col("row")[c].alias(c)
        for c in docs.columns if c not in results
    ]
    return df.select(*out, *[v.alias(k) for k, v in results.items()])


def other_columns(docs: DataFrame, text_col: str) -> StructType:
    """Type of ``row`` in :func:`keyed`."""
    return StructType([f for f in docs.schema.fields if f.name != text_col])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it again:
    lineage ends there, and losing an executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
