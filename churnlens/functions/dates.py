"""Integer ``yyyymmdd`` dates.

The fact tables carry dates as integers; range filters stay on the plain
integer column (so Parquet statistics and partition pruning apply), and the
conversions below are only used where day arithmetic is needed.  All are
built-in expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_date(ts: ColumnOrName) -> Column:
    """Date or timestamp -> ``yyyymmdd`` integer."""
    ts = _col(ts)
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def int_date_to_date(d: ColumnOrName) -> Column:
    """``yyyymmdd`` integer -> DATE; an impossible date (``20180230``, ``0``)
    gives NULL instead of failing the job under ANSI mode."""
    return F.try_to_date(_col(d).cast("int").cast("string"), "yyyyMMdd")


def int_date_diff(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Days from ``start`` to ``end`` (``end - start``), both ``yyyymmdd``."""
    return F.datediff(int_date_to_date(end), int_date_to_date(start))


def int_date_add(d: ColumnOrName, days: int | Column) -> Column:
    """``yyyymmdd`` plus ``days`` -> ``yyyymmdd``."""
    n = days if isinstance(days, Column) else F.lit(int(days))
    return int_date(F.date_add(int_date_to_date(d), n))


def int_date_month(d: ColumnOrName) -> Column:
    """First day of the month of a ``yyyymmdd`` integer, as ``yyyymmdd``."""
    d = _col(d).cast("int")
    return ((d / 100).cast("int") * 100 + 1).cast("int")


def int_date_timestamp(d: ColumnOrName) -> Column:
    """``yyyymmdd`` integer -> midnight timestamp (without time zone)."""
    return int_date_to_date(d).cast("timestamp_ntz")


def epoch_ms_to_int_date(ms_text: ColumnOrName) -> Column:
    """Epoch milliseconds (possibly dirty text) -> UTC ``yyyymmdd``.

    Non-numeric text gives NULL (``try_cast``).  Computed from the epoch day,
    so it does not depend on the session time zone.
    """
    ms = _col(ms_text).try_cast("bigint")
    day = F.floor(ms / F.lit(86400000)).cast("int")
    return int_date(F.date_from_unix_date(day))
