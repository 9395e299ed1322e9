"""Delimited text sources.

``read_delimited`` reads a Hive-style delimited text table (no quoting,
``\\N`` for NULL) with a declared schema.  ``read_pipe_columns`` keeps
selected fields of raw pipe-separated report files after dropping the
leading lines of each file, the distributed form of ``tail -n +N | cut``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIVE_SEP = "\u0001"

FRAUD_FILE_SCHEMA = T.StructType([
    T.StructField("referenceID", T.StringType()),
    T.StructField("experiation_date", T.IntegerType()),
    T.StructField("sale_amt", T.DoubleType()),
    T.StructField("fraud_reason", T.StringType()),
])


def _text_options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": "", "escape": "\\", "nullValue": "\\N", "header": "false"}


def write_delimited(df: DataFrame, path: str, sep: str = HIVE_SEP) -> None:
    """Write ``df`` as delimited text (one file per partition)."""
    df.write.mode("overwrite").options(**_text_options(sep)).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType = FRAUD_FILE_SCHEMA,
                   sep: str = HIVE_SEP) -> DataFrame:
    """Read a delimited text table with an explicit schema (no inference).

    Malformed numbers become NULL rather than failing the scan.
    """
    return spark.read.schema(schema).options(**_text_options(sep)).option("mode", "PERMISSIVE").csv(path)


def read_pipe_columns(spark: SparkSession, path: str, positions: Sequence[int], names: Sequence[str],
                      skip: int = 0, sep: str = "|") -> DataFrame:
    """Fields ``positions`` (1-based, like ``cut -f``) of every line of the
    files under ``path``, after dropping the first ``skip`` lines of *each*
    file.

    The first lines of a file are all in the split that starts at byte 0,
    and ``monotonically_increasing_id`` numbers a split's lines
    consecutively in file order.  So the lines to drop are those of block 0
    whose id is below the smallest id of that file plus ``skip``; the
    smallest id per file is a small aggregate (one row per file).
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__rid"),
    )
    if skip:
        heads = (raw.filter(F.col("__block") == 0).groupBy("__file")
                 .agg(F.min("__rid").alias("__first")))
        raw = (raw.join(heads, on="__file", how="left")
               .filter(~((F.col("__block") == 0) & (F.col("__rid") < F.col("__first") + F.lit(skip)))))
    parts = F.split(F.col("value"), _regex_literal(sep))
    return raw.select(*[F.try_element_at(parts, F.lit(p)).alias(n) for p, n in zip(positions, names)])


def _regex_literal(sep: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()" else ch for ch in sep)
