"""Value mapping, sentinels, maps and casts as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(predicate: Column) -> Column:
    """0/1 indicator; a NULL predicate gives 0 (``case when p then 1 else 0``)."""
    return F.when(predicate, F.lit(1)).otherwise(F.lit(0))


def null_default(c: ColumnOrName, default: str = "Unknown") -> Column:
    """NULL -> ``default``; other values unchanged."""
    return F.coalesce(_col(c), F.lit(default))


def null_safe_zero(c: ColumnOrName) -> Column:
    """NULL -> 0 (for null-as-zero flags and sums)."""
    return F.coalesce(_col(c), F.lit(0))


def decode(c: ColumnOrName, mapping: Mapping[str, str], passthrough: bool = True,
           default: str | None = None) -> Column:
    """Map codes to labels with a literal map; unknown codes pass through
    (or become ``default`` when ``passthrough`` is False)."""
    c = _col(c)
    pairs = []
    for key, value in mapping.items():
        pairs += [F.lit(key), F.lit(value)]
    looked_up = F.try_element_at(F.create_map(*pairs), c)
    fallback = c if passthrough else F.lit(default)
    return F.coalesce(looked_up, fallback)


def bucket(c: ColumnOrName, groups: Mapping[str, Iterable[str]], default: str | None = None) -> Column:
    """List-to-label bucketing: first group whose list holds the value wins.

    Long lists become hash-set membership tests (``InSet``), so no lookup
    join or shuffle is needed.
    """
    c = _col(c)
    expr = None
    for label, values in groups.items():
        values = list(values)
        expr = (F.when(c.isin(values), F.lit(label)) if expr is None
                else expr.when(c.isin(values), F.lit(label)))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def capped(c: ColumnOrName, cap: int, overflow: int) -> Column:
    """``case when c <= cap then c else overflow`` (NULL also overflows)."""
    c = _col(c)
    return F.when(c <= F.lit(cap), c).otherwise(F.lit(overflow))


def not_sentinel(c: ColumnOrName, sentinels: Iterable[str] = ("--",)) -> Column:
    """True when the value is present and not a sentinel (NULL is rejected,
    as SQL ``<>`` does)."""
    c = _col(c)
    return c.isNotNull() & ~c.isin(list(sentinels))


def map_get(m: ColumnOrName, key: str) -> Column:
    """Value of ``key`` in a map column; a missing key gives NULL."""
    return F.try_element_at(_col(m), F.lit(key))


#: Metadata of a stored key column: the map that it was taken from.
KEY_OF = "key_of_map"


def with_stored_keys(df: DataFrame, keys: Mapping[str, Iterable[str]]) -> DataFrame:
    """Add a column per listed map key, named like the key.

    Written beside the maps, the columns have statistics of their own: a test
    on a key reaches the scan, and a query that needs some keys does not read
    the maps.  The column's metadata names its map, so that :func:`map_key`
    never takes another column of that name for it.
    """
    columns = [map_get(m, k).alias(k, metadata={KEY_OF: m}) for m, ks in keys.items() for k in ks]
    taken = {k for ks in keys.values() for k in ks} & set(df.columns)
    if taken:
        raise ValueError(f"columns and map keys share names: {sorted(taken)}")
    return df.select("*", *columns)


def map_key(df: DataFrame, m: str, key: str) -> Column:
    """Value of ``key`` in the map column ``m`` of ``df``: the stored key
    column where the table has one, else looked up in the map."""
    if key in df.columns and df.schema[key].metadata.get(KEY_OF) == m:
        return df[key]
    return map_get(df[m], key)


def safe_cast(c: ColumnOrName, to: str) -> Column:
    """Cast that gives NULL for dirty text (``'null'``, ``''``) instead of
    failing the job under ANSI mode."""
    return _col(c).try_cast(to)


def zip5(c: ColumnOrName) -> Column:
    """Five-character postal key: ``trim(substr(c, 1, 5))``."""
    return F.trim(F.substring(_col(c), 1, 5))


def normalise_institution(grouped: ColumnOrName, desc: ColumnOrName) -> Column:
    """Issuer label: the grouped name when known, else the raw name with
    double quotes doubled and trimmed; upper-cased."""
    raw = F.trim(F.regexp_replace(_col(desc), '"', '""'))
    return F.upper(F.coalesce(_col(grouped), raw))
