"""Domain views materialised once as Parquet tables.

The analyses read the same derived tables many times (the original reports
stored them with ``create table ... as``).  ``Warehouse`` writes each
domain view once per input folder to the shared checkpoint folder
(``spark.checkpoint.dir``) and reads it back, which

- turns integer dates into stored columns, so date ranges reach the Parquet
  scan (``PushedFilters``, row-group skipping on date-sorted files); keys of
  property maps are stored as columns beside the maps, so predicates on them
  reach the scan too;
- buckets the subscription facts by subscription, so joins and group-bys on
  (account, subscription) need no shuffle;
- cuts lineage at a written table in the shared folder, so a lost executor
  re-reads files instead of recomputing the adapter joins;
- builds each adapter join once instead of once per analysis.

Tables are keyed by the input folder, its size and modification time and
the source of the rules (adapters and the column functions they use), so a
changed input or rule gives a new table.
"""

from __future__ import annotations

import hashlib
import inspect
import os
import re
import uuid
import weakref
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from churnlens.functions import dates as _dates
from churnlens.functions import values as _values
from churnlens.functions.values import with_stored_keys
from churnlens.session import shared_dir
from churnlens.sources import adapters as ad
from churnlens.sources.tables import TABLES, Tables


@dataclass(frozen=True)
class View:
    """How a domain view is stored.

    sort: column the files are sorted on, so that row groups can be skipped;
    by_day: one folder per value of it (event facts), so that date ranges
    prune folders; keys: bucketed by these columns, so that joins and
    group-bys on them (and more) need no shuffle; its adapter deals the rows
    out to the buckets (``Tables.buckets``); map_keys: keys of property maps that
    are stored as columns beside the maps; then_by: further sort columns.
    """

    adapter: Callable[[Tables], DataFrame]
    sort: str | None = None
    by_day: bool = False
    keys: tuple[str, ...] = ()
    map_keys: Mapping[str, Sequence[str]] = field(default_factory=dict)
    then_by: tuple[str, ...] = ()

    def rows(self, tables: Tables) -> DataFrame:
        return with_stored_keys(self.adapter(tables), self.map_keys)


#: A subscription has one account.  Its id alone is what the input tables are
#: joined on, so the rows that a view's last join gives lie in their buckets.
SUBSCRIPTION = ("subscrn_id",)

#: Bytes of input tables per bucket, and the bounds of the number of buckets.
#: Compressed input grows some 15 times as rows to sort: a bucket is one task's.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 13

#: Keys of the payment events' property maps that the analyses use.
PAYMENT_KEYS = {
    "degenerate_values_map": [
        "mop_postal_code", "bin_metadata_type", "original_txn_pmt_processor", "original_txn_type", "billing_period", "retry_mode",
        "original_txn_date", "token_used", "is_chained_txn", "is_duplicate", "txn_type", "txn_status", "mop_type"],
    "natural_key_map": ["original_txn_id", "req_proc_ref_id"],
    "dimension_sk_map": ["pmt_mop_metadata_sk"],
    "facts_map": ["chargeback_amount", "record_count"],
}

VIEWS = {
    "subscription": View(ad.subscription, "signup_date", keys=SUBSCRIPTION),
    "signup_retention": View(ad.signup_retention, "signup_date", keys=SUBSCRIPTION),
    "subscription_signup": View(ad.subscription_signup, keys=SUBSCRIPTION),
    "signup_funnel": View(ad.signup_funnel, "event_region_date", keys=SUBSCRIPTION),
    "partner_cohort": View(ad.partner_cohort, "enrollment_date"),
    "subscription_hold": View(ad.subscription_hold, "event_date", keys=SUBSCRIPTION),
    "billing_period": View(ad.billing_period, "billing_period_end_date", keys=SUBSCRIPTION),
    "billing_subscription": View(ad.billing_subscription, "billing_end_date", keys=SUBSCRIPTION),
    "device_activity": View(ad.device_activity, "billing_period_end_date", keys=SUBSCRIPTION),
    "title_views": View(ad.title_views, "region_date", by_day=True),
    "device_type": View(ad.device_type),
    "connection_event": View(ad.connection_event, "utc_date", by_day=True),
    "stream_block": View(ad.stream_block, "event_utc_date", by_day=True),
    "partner_signup_service": View(ad.partner_signup_service, "processing_utc_date", by_day=True),
    "geo_market": View(ad.geo_market),
    "geo_postal": View(ad.geo_postal),
    "geo_subdivision": View(ad.geo_subdivision),
    "geo_country": View(ad.geo_country),
    "account_geo": View(ad.account_geo),
    "institution": View(ad.institution),
    "institution_group": View(ad.institution_group),
    "payment_method": View(ad.payment_method),
    "payment_event": View(ad.payment_event, "event_utc_date", by_day=True, map_keys=PAYMENT_KEYS, then_by=("pmt_event_type", "txn_type")),
    "payment_txn_event": View(ad.payment_txn_event, "dateint", by_day=True,
                              map_keys={"other_properties": ["customerId", "isoCountryCode", "referenceId"]}),
    "chargeback_summary": View(ad.chargeback_summary, "cb_event_utc_date", by_day=True),
    "fraud_file": View(ad.fraud_file),
    "renewal_agg": View(ad.renewal_agg, "event_utc_date"),
    "validation_agg": View(ad.validation_agg, "event_utc_date"),
    "event_signups": View(ad.event_signups, "signup_date", by_day=True),
}


def jvm_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = jvm_fs(spark, path)
    return bool(fs.exists(p))


def complete_attempts(spark: SparkSession, folder: str) -> list[str]:
    """Attempt folders under ``folder`` whose write committed (``_SUCCESS``),
    newest first."""
    fs, p = jvm_fs(spark, folder)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        child = st.getPath().toString()
        if st.isDirectory() and st.getPath().getName().startswith("attempt-") \
                and _exists(spark, child + "/_SUCCESS"):
            out.append((-st.getModificationTime(), child))
    return [child for _, child in sorted(out)]


def _fingerprint(spark: SparkSession, root: str, version: str | None = None) -> str:
    """Key of the materialised views: input identity + rules + layout.

    ``version`` (a snapshot id or load date) identifies the input directly.
    Without it, each input table's total size and modification time are
    read, which lists the table's files: fine for test data, but on an
    object store holding millions of files pass ``version`` instead.
    """
    h = hashlib.sha1(root.encode())
    for module in (ad, _dates, _values):  # the rules that define the views
        h.update(inspect.getsource(module).encode())
    h.update(inspect.getsource(Warehouse).encode())  # and the storage layout
    h.update(repr([(k, v.sort, v.by_day, v.keys, v.map_keys, v.then_by) for k, v in sorted(VIEWS.items())]).encode())
    if version is not None:
        h.update(f"version:{version}".encode())
    else:
        for name in TABLES:
            fs, p = jvm_fs(spark, os.path.join(root, f"{name}.parquet"))
            if fs.exists(p):
                st = fs.getFileStatus(p)
                h.update(f"{name}:{fs.getContentSummary(p).getLength()}:{st.getModificationTime()}".encode())
    return h.hexdigest()[:16]


def _default_buckets(spark: SparkSession, root: str, version: str | None) -> int:
    if version is not None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = _state(spark)["buckets"]
    if root not in known:
        size = 0
        for name in TABLES:
            fs, p = jvm_fs(spark, os.path.join(root, f"{name}.parquet"))
            size += fs.getContentSummary(p).getLength() if fs.exists(p) else 0
        known[root] = max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    return known[root]


def _table_name(path: str) -> str:
    """Catalog name of a stored attempt: its last three folders (input and
    rules, view, attempt)."""
    return "churnlens_" + re.sub(r"\W", "_", "_".join(path.rstrip("/").split("/")[-3:]))


# Per-session memo of resolved folders and opened views: a view is listed
# and its schema read once per session, later analyses reuse the same
# relation (a plan node, not data).
_SESSION_STATE: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def _state(spark: SparkSession) -> dict:
    st = _SESSION_STATE.get(spark)
    if st is None:
        st = {"base": {}, "views": {}, "buckets": {}}
        _SESSION_STATE[spark] = st
    return st


class Warehouse:
    """``Warehouse(spark, root).billing_period`` -> the materialised view.

    ``materialize=False`` returns the lazy adapter plans instead (used to
    inspect the end-to-end plan of an analysis over the raw tables).
    Raw driver tables stay available as ``.tables``.

    ``buckets`` is the number of buckets of the subscription facts, by default
    one per ``BUCKET_BYTES`` of the input tables (with ``version``, which spares
    the listing: the session's number of shuffle partitions).  Tables built
    with another number stay apart, since only equal numbers of buckets join
    without a shuffle.
    """

    def __init__(self, spark: SparkSession, root: str, materialize: bool = True, version: str | None = None,
                 buckets: int | None = None):
        self.spark = spark
        self.root = root
        self.version = version
        self.tables = Tables(spark, root)
        self.materialize = materialize
        self.buckets = buckets or _default_buckets(spark, root, version)
        self._base = None
        self._forced: dict[str, str] = {}

    def _path(self, name: str) -> str:
        if self._base is None:
            bases = _state(self.spark)["base"]
            key = (self.root, self.version, self.buckets)
            if key not in bases:
                fp = _fingerprint(self.spark, self.root, self.version)
                bases[key] = shared_dir(self.spark, f"churnlens/warehouse/{fp}-{self.buckets}")
            self._base = bases[key]
        return os.path.join(self._base, name)

    def build(self, name: str, force: bool = False) -> str:
        """Path of a complete copy of view ``name``, writing one if needed.

        Every write goes to its own ``attempt-<id>`` folder and is never
        overwritten, so concurrent builders (threads or jobs) cannot clash:
        readers take the newest committed attempt, and all attempts hold the
        same rows.  ``force`` always writes (and then uses) a fresh attempt;
        :meth:`drop` removes the others.
        """
        folder = self._path(name)
        if not force:
            done = complete_attempts(self.spark, folder)
            if done:
                return done[0]
        view = VIEWS[name]
        df = view.rows(Tables(self.spark, self.root, self.buckets) if view.keys else self.tables)
        path = os.path.join(folder, f"attempt-{uuid.uuid4().hex}")
        if view.by_day:
            # cluster by day; AQE splits a day that is larger than the advisory
            # partition size over several tasks (and files)
            (df.hint("rebalance", view.sort).sortWithinPartitions(view.sort, *view.then_by)
             .write.mode("errorifexists").partitionBy(view.sort).parquet(path))
        elif view.keys:
            self._write_bucketed(df, view, path)
        else:
            (df.sortWithinPartitions(view.sort) if view.sort else df).write.mode("errorifexists").parquet(path)
        if force:
            self._forced[name] = path
        return path

    def _write_bucketed(self, df: DataFrame, view: View, path: str) -> None:
        """One file per bucket: the adapter has dealt the rows by the same
        hash that assigns buckets.  Subscriptions hardly repeat, so buckets
        are even.  The catalog entry lies over files in the shared folder; it
        is made when the view is opened (a session's catalog may not outlive
        it)."""
        writer = df.write.bucketBy(self.buckets, *view.keys)
        if view.sort:
            writer = writer.sortBy(view.sort)
        writer.option("path", path).saveAsTable(_table_name(path))

    def _open_bucketed(self, view: View, path: str) -> DataFrame:
        table = _table_name(path)
        if not self.spark.catalog.tableExists(table):
            columns = self.spark.read.parquet(path)._jdf.schema().toDDL()
            sort = f"SORTED BY ({view.sort})" if view.sort else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
                           f"CLUSTERED BY ({', '.join(view.keys)}) {sort} INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def drop(self, name: str, keep: str | None = None) -> None:
        """Delete the stored attempts of a view (but ``keep``).  For callers
        who know that nothing reads them any more."""
        for path in complete_attempts(self.spark, self._path(name)):
            if path.rstrip("/").rsplit("/", 1)[-1] != (keep or "").rstrip("/").rsplit("/", 1)[-1]:
                self.spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
                fs, p = jvm_fs(self.spark, path)
                fs.delete(p, True)
        views = _state(self.spark)["views"]
        for key in [k for k in views if k[0] == self.root and k[2] == name]:
            del views[key]

    def prepare(self, names=None, force: bool = False, parallel: int = 8) -> None:
        """Build several views at once: each build is an independent Spark
        job, and jobs submitted from different threads share the cluster."""
        names = list(names or VIEWS)
        self._path(names[0])  # resolve the folder once, before the threads start
        if parallel <= 1:
            for name in names:
                self.build(name, force=force)
            return
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            for future in [pool.submit(self.build, n, force) for n in names]:
                future.result()

    def view(self, name: str) -> DataFrame:
        if not self.materialize:
            return VIEWS[name].adapter(self.tables)
        path = self._forced.get(name) or None
        views = _state(self.spark)["views"]
        key = (self.root, self.version, name, path, *([self.buckets] if VIEWS[name].keys else []))
        if key not in views:
            stored = path or self.build(name)
            views[key] = self._open_bucketed(VIEWS[name], stored) if VIEWS[name].keys else self.spark.read.parquet(stored)
        return views[key]

    def intermediate(self, name: str, rule: Callable[..., DataFrame], *inputs: DataFrame, about: str = "", **parameters) -> DataFrame:
        """``rule(*inputs, **parameters)``, stored once and shared by all
        analyses that ask for it: a table that several reports read, as the
        original reports store theirs.  Its key is the warehouse's input, the
        name, the parameters, the source of the rule's module, and ``about``:
        whatever else the inputs depend on."""
        if not self.materialize:
            return rule(*inputs, **parameters)
        key = hashlib.sha1((inspect.getsource(inspect.getmodule(rule)) + repr(sorted(parameters.items())) + about).encode()).hexdigest()[:16]
        folder = self._path(os.path.join("intermediate", f"{name}-{key}"))
        views = _state(self.spark)["views"]
        if (folder, "intermediate", name) not in views:
            done = complete_attempts(self.spark, folder)
            path = done[0] if done else os.path.join(folder, f"attempt-{uuid.uuid4().hex}")
            if not done:
                rule(*inputs, **parameters).write.mode("errorifexists").parquet(path)
            views[folder, "intermediate", name] = self.spark.read.parquet(path)
        return views[folder, "intermediate", name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)
