"""How domain views are stored: key columns beside maps, buckets, shared
intermediate tables, day tables; and numbering across tasks."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from churnlens.functions import values as V
from churnlens.operators import windows as W
from churnlens.plans import cohorts, payments
from churnlens.plans import registry as R
from churnlens.sources import adapters, warehouse
from churnlens.sources.daily import DailyTable
from churnlens.sources.tables import Tables
from churnlens.sources.warehouse import Warehouse

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return Warehouse(spark, SF)


@pytest.fixture
def static(spark):
    """Plans as for inputs too large to broadcast."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.maxMetadataStringLength")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield
    for k, v in saved.items():
        spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> int:
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single|RoundRobin)", text)) - text.count("ReusedExchange")


# stored map keys


def test_map_key_reads_the_stored_column_or_the_map(spark):
    maps = spark.createDataFrame([({"k": "1", "q": "2"}, "own"), ({}, "own")], "m map<string,string>, q string")
    stored = V.with_stored_keys(maps, {"m": ["k"]})
    assert [tuple(r) for r in stored.select(V.map_key(stored, "m", "k"), V.map_key(stored, "m", "q")).collect()] == [("1", "2"), (None, None)]
    with pytest.raises(ValueError):
        V.with_stored_keys(maps, {"m": ["q"]})  # q is another column


def test_refund_filters_reach_the_scan_and_maps_are_not_read(spark, t, static):
    scan = next(x for x in plan(R._refunds(t)).splitlines() if "FileScan" in x and "txn_type" in x)
    pushed = re.search(r"PushedFilters: \[(.*?)\]", scan)[1]
    assert "EqualTo(txn_type,REFUND)" in pushed and "EqualTo(txn_status,APPROVED)" in pushed
    assert "_map" not in re.search(r"ReadSchema: (.*)", scan)[1]
    for name in ("chargeback_cube", "postal_attribution", "match_fraud_to_txn", "chargeback_amounts"):
        text = plan(R.QUERIES[name](spark, SF))
        assert "map<" not in "".join(re.findall(r"ReadSchema: .*", text)), name


def test_analyses_give_the_same_rows_without_stored_keys(spark, t):
    bare = Warehouse(spark, SF, materialize=False)
    for run in (R._refunds, R._cb_vs, R._matched):
        a, b = run(t), run(bare)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# one aggregation for both grains


def test_both_grains_share_one_scan_and_star_join(spark, t, static):
    text = plan(R.q_chargeback_vs_approved_aligned(spark, SF))
    assert shuffles(text) <= 12
    assert sum("FileScan" in x and "pmt_event_type" in x for x in text.splitlines()) == 1


def test_chargebacks_may_come_at_any_grain(spark, t):
    rows = payments.chargeback_rows(*R._payment_star(t), 20240101, 20231001)
    cube = payments.chargeback_cube(*R._payment_star(t), 20240101, 20231001)
    approved = [payments.approved_rejoin_charges(t.validation_agg, 20231001), payments.approved_renewals(t.renewal_agg, 20231001)]
    for null_safe in (False, True):
        a, b = (payments.chargeback_vs_approved(x, *approved, null_safe=null_safe, txn_type_map={"SALE": "RENEWAL"}) for x in (rows, cube))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


# buckets


def test_subscription_facts_join_without_a_shuffle(spark, t, static):
    joined = cohorts.signup_cancel_reason(t.signup_retention, t.billing_subscription, None, None, 19950101)
    assert shuffles(plan(joined)) == 0
    flagged = plan(cohorts.inactivity_flag(joined, t.device_activity, 1, 19950101))
    assert shuffles(flagged) <= 1  # viewing is summed per fraud flag too, the keys suffice
    assert "SelectedBucketsCount" in flagged


def test_bucketed_views_open_in_a_session_with_an_empty_catalog(spark, t):
    name = "billing_subscription"
    rows = t.view(name).count()
    other = spark.newSession()
    for table in other.catalog.listTables():
        if name in table.name:
            other.sql(f"DROP TABLE {table.name}")  # the files stay
    again = Warehouse(other, SF).view(name)
    assert again.count() == rows and "Bucketed: true" in plan(again.groupBy("account_id", "subscrn_id").count())


@pytest.mark.parametrize("name, most", [("billing_period", 4), ("subscription", 6), ("signup_retention", 6), ("billing_subscription", 3)])
def test_joined_rows_lie_in_their_buckets(spark, static, name, most):
    # the last join is on the buckets' key: no shuffle comes after it
    text = plan(warehouse.VIEWS[name].rows(Tables(spark, SF, 8)))
    assert shuffles(text) <= most
    assert text.index("Join") < text.index("Exchange")
    own = Warehouse(spark, SF, version="test-dealt", buckets=8)
    files = glob.glob(own.build(name, force=True).removeprefix("file:") + "/*.parquet")
    assert len(files) <= 8
    a, b = own.view(name), warehouse.VIEWS[name].rows(Tables(spark, SF))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_largest_reason_is_the_largest_string(spark):
    lines = spark.read.parquet(LARGER + "/lineitem.parquet").groupBy("l_orderkey")
    both = lines.agg(F.max(adapters._cancel_reason()).alias("a"), adapters._largest_reason().alias("b"))
    assert both.where("not a <=> b").count() == 0 and both.where("a is null").count() > 0


def test_a_bucket_is_small(spark, monkeypatch):
    class Of:
        def getContentSummary(self, p): return self
        def getLength(self): return (1 << 30) // len(warehouse.TABLES)
        def exists(self, p): return True
    monkeypatch.setattr(warehouse, "jvm_fs", lambda spark, path: (Of(), path))
    assert warehouse._default_buckets(spark, "/a folder of 1 GB", None) >= 60


def test_drop_removes_stored_attempts(spark):
    own = Warehouse(spark, SF, version="test-drop")
    kept, gone = own.build("subscription_hold", force=True), own.build("geo_market")
    old = own.build("subscription_hold", force=True)
    assert os.path.isdir(kept.removeprefix("file:")) and os.path.isdir(old.removeprefix("file:"))
    own.drop("subscription_hold", keep=old)
    assert not os.path.exists(kept.removeprefix("file:")) and os.path.isdir(old.removeprefix("file:"))
    assert own.subscription_hold.count() == Warehouse(spark, SF).subscription_hold.count()
    own.drop("geo_market")
    assert not os.path.exists(gone.removeprefix("file:"))
    assert own.geo_market.count() == 25  # built anew


# shared intermediate table


def test_link_summary_is_stored_once_and_read_by_both_reports(spark, static):
    R._link_summary(Warehouse(spark, LARGER))
    text = plan(R.q_market_region_rollup(spark, LARGER))
    assert shuffles(text) <= 10
    for other in (text, plan(R.q_missingness_by_source(spark, LARGER))):
        assert sum("FileScan" in x and "intermediate/link_summary" in x for x in other.splitlines()) == 1
        assert sum("FileScan" in x for x in other.splitlines()) == 2  # activations and the summary


# day tables


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/day=*/*.parquet")}


def test_a_refresh_writes_changed_days_only(spark, tmp_path):
    path = str(tmp_path / "table")
    table = DailyTable(spark, path, "day")

    def rows(extra=()):
        return spark.createDataFrame([(20240101, 1, {"a": 1, "b": 2}), (20240102, 2, None), (20240102, 3, {}), (None, 9, None), *extra],
                                     "day int, id int, m map<string,int>")

    assert set(table.refresh(rows())[0]) == {None, 20240101, 20240102}
    first = files(path)
    assert table.refresh(rows()) == ([], []) and files(path) == first
    assert table.refresh(rows([(20240103, 4, None)])) == ([20240103], [])
    second = files(path)
    assert {f: second[f] for f in first} == first and len({os.path.dirname(f) for f in second}) == len({os.path.dirname(f) for f in first}) + 1
    # a row moved to null values, an order of map entries: only real changes count
    changed = spark.createDataFrame([(20240101, 1, {"b": 2, "a": 1}), (20240102, 2, None), (20240102, 3, None), (None, 9, None)],
                                    "day int, id int, m map<string,int>")
    written, removed = table.refresh(changed)
    assert written == [20240102] and removed == [20240103]
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 3, 9]


def test_a_refresh_of_given_days_reads_only_them(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "table")
    spark.range(100).select((F.col("id") % 5 + 20240101).cast("int").alias("day"), "id").write.partitionBy("day").parquet(source)
    table = DailyTable(spark, path, "day")
    table.refresh(spark.read.parquet(source))
    before = files(path)
    doubled = spark.read.parquet(source).select("day", (F.col("id") * 2).alias("id"))
    assert table.refresh(doubled, days=[20240103]) == ([20240103], [])
    after = files(path)
    kept = {f: at for f, at in before.items() if "20240103" not in f}
    assert {f: after[f] for f in kept} == kept
    assert table.read().filter("day = 20240103").agg(F.sum("id")).first()[0] == 2 * sum(range(2, 100, 5))
    assert table.refresh(doubled, days=[20240103]) == ([], [])
    # a refresh without days still knows the others
    assert table.refresh(table.read().select("day", "id")) == ([], [])


def test_a_refresh_cut_off_before_its_entry_is_repeated(spark, tmp_path):
    path = str(tmp_path / "table")
    table = DailyTable(spark, path, "day")
    df = spark.createDataFrame([(1, 1), (2, 2)], "day int, id int")
    df.write.partitionBy("day").parquet(path)  # data without an entry
    assert sorted(table.refresh(df)[0]) == [1, 2] and table.read().count() == 2


# windows


def test_one_hour_of_one_account_is_numbered_by_several_tasks(spark, tmp_path):
    df = spark.range(4000).select(F.lit(7).alias("key"), (F.col("id") % 3).alias("at"), "id").repartition(5)
    df = df.unionByName(spark.createDataFrame([(None, 1, 1), (None, 0, 2), (8, None, 3)], "key int, at long, id long"))
    tasks = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart

    def store(ordered):
        path = str(tmp_path / "ordered")
        ordered.write.parquet(path)
        out = spark.read.schema(ordered.schema).parquet(path)
        tasks.append(out.filter("key = 7").select(F.shiftright("__at", 33)).distinct().count())
        return out

    try:
        got = {(r.key, r.id): r.row_cnt for r in W.event_sequence_by_range(df, "key", "at", "id", store).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks[0] > 1
    want = {}
    for key in (None, 7, 8):
        own = sorted((r for r in df.collect() if r.key == key), key=lambda r: (r["at"] is not None, r["at"] or 0, r.id))
        want |= {(key, r.id): i for i, r in enumerate(own, 1)}
    assert got == want


def test_both_ways_to_take_the_first_row_agree(spark):
    df = spark.createDataFrame([(1, None, 2), (1, 3, 1), (2, 5, 5), (2, 5, 4), (None, 1, 1), (None, 1, 1)], "k int, o int, r int")
    a, b = (sorted(map(str, W.dedupe_first(df, ["k"], ["o"], nearly_unique=x).collect())) for x in (False, True))
    assert a == b
    assert "WindowGroupLimit" in plan(W.dedupe_first(df, ["k"], ["o"], nearly_unique=True))


# factors


def test_factors_expand_to_the_wide_rows(spark):
    from churnlens.plans import geo

    t = Warehouse(spark, LARGER)
    factors, wide = R._wide_factors(t), R._wide(t)
    expanded = geo.expand_wide_geo(R._activations(t), factors).select(wide.columns)
    assert expanded.exceptAll(wide).count() == 0 and wide.exceptAll(expanded).count() == 0
    per_link = factors.groupBy("link", "source").agg(F.sum("n").alias("n")).collect()
    product = {}
    for r in per_link:
        product[r.link] = product.get(r.link, 1) * r.n
    assert sum(product.values()) == wide.count() == 3565
    weighted = R.q_activation_geo_weighted(spark, LARGER)
    assert weighted.agg(F.sum("n_activations")).first()[0] == R.q_activation_geo(spark, LARGER).count()
