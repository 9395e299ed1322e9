"""Column expressions (JVM-side, code-generated; no Python UDFs)."""

from churnlens.functions.dates import (
    epoch_ms_to_int_date,
    int_date,
    int_date_add,
    int_date_diff,
    int_date_month,
    int_date_timestamp,
    int_date_to_date,
)
from churnlens.functions.values import (
    bucket,
    decode,
    flag,
    map_get,
    map_key,
    normalise_institution,
    not_sentinel,
    null_default,
    null_safe_zero,
    capped,
    safe_cast,
    with_stored_keys,
    zip5,
)

__all__ = [
    "bucket", "capped", "decode", "epoch_ms_to_int_date", "flag", "int_date", "int_date_add",
    "int_date_diff", "int_date_month", "int_date_timestamp", "int_date_to_date", "map_get", "map_key",
    "normalise_institution", "not_sentinel", "null_default", "null_safe_zero", "safe_cast",
    "with_stored_keys", "zip5",
]
