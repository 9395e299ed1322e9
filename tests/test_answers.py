"""Comparisons and samples have something to show on the driver tables."""

import pytest
from pyspark.sql import functions as F

from churnlens.functions import lookups as L
from churnlens.functions.values import bucket
from churnlens.plans import payments
from churnlens.plans import registry as R

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query, count, renewals", [
    (R.q_chargeback_vs_approved, "chargeback_cnt", 0), (R.q_chargeback_vs_approved_aligned, "chargeback_cnt", 1)])
def test_chargebacks_meet_approved_rows(spark, query, count, renewals):
    got = dict(query(spark, SF).groupBy("txn_type").agg(F.sum(count)).collect())
    assert got.pop("REJOIN_CHARGE") > 0
    assert (next(iter(got.values())) > 0) == bool(renewals)


def test_refunds_meet_approved_rows(spark):
    assert R.q_refund_vs_approved(spark, SF).agg(F.sum("refund_cnt")).first()[0] > 0


def test_postal_attribution_has_payment_types(spark):
    assert R.q_postal_attribution(spark, SF).select("signup_pmt_type_desc").distinct().count() >= 2


@pytest.mark.parametrize("name", ["paid_but_inactive_sample", "cancel_reason_same_day", "partner_retention_by_pmt",
                                  "eligible_partners", "postal_attribution_country", "inactivity_flag_country"])
def test_query_returns_rows(spark, name):
    assert R.QUERIES[name](spark, SF).count() > 0


def test_fraud_status_weights_are_the_repeated_rows(spark):
    matched = spark.createDataFrame([("1", "US", "R1", "A"), ("1", "US", "R2", "B"), ("2", "US", "R3", "A")],
                                    "acct_id string, country_code string, referenceId string, fraud_reason_text string")
    subs = spark.createDataFrame([(1, 20190101, 0), (1, 20190102, 0), (1, 20190103, None)],
                                 "account_id long, signup_date int, fraud_flag int")
    backs = spark.createDataFrame([(1, 20190105)] * 3, "account_id long, cb_event_utc_date int")
    got = payments.fraud_chargeback_status(matched, subs, backs, 20181101, 20190101)
    assert got.agg(F.sum("row_weight")).first()[0] == 2 * 3 * 3
    assert {(r.fraud_flag, r.row_weight) for r in got.collect()} == {(0, 6), (None, 3)}


def test_real_region_lists(spark):
    df = spark.createDataFrame([("Ohio",), ("Texas",), ("Miami-Ft. Lauderdale, FL",), ("CA",), (None,)], "s string")
    got = [tuple(r) for r in df.select(bucket("s", L.SUBDIVISION_REGIONS, L.SUBDIVISION_DEFAULT),
                                       bucket("s", L.MARKET_REGIONS, L.MARKET_DEFAULT)).collect()]
    assert got == [("Northeast", "NorthEast"), ("West", "Central"), ("Other", "SouthEast"), ("Other", "West"),
                   ("Other", "missing")]
