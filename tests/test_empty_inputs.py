"""Every building block and a sample of analyses accept empty inputs and
return empty (or all-zero) results without failing."""

from pyspark.sql import functions as F

from churnlens.operators import aggregates as A
from churnlens.operators import joins as J
from churnlens.operators import windows as W
from churnlens.plans import cohorts, geo, partners, payments


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_operators_on_empty(spark):
    e = empty(spark, "g int, id int, p int, d int")
    assert A.conditional_distinct_counts(e, ["g"], "id", {"n": None}).count() == 0
    assert A.missingness_crosstab(e, {"m": "p"}).count() == 0
    assert W.dedupe_first(e, ["g"], ["p"]).count() == 0
    assert W.event_sequence(e, "g", "p", "id", "d").count() == 0
    assert J.existence_flag(e, e, ["g"], "f").count() == 0
    assert J.band_join(e, e.select(F.col("g").alias("h"), F.col("d").alias("e")), "g", "h", "d", "e", 1, 2).count() == 0


def test_analyses_on_empty(spark):
    flagged = empty(spark, "account_id long, subscrn_id long, cancellation_reason_desc string, subscrn_status string, "
                    "fraud_flag int, signup_dateint int, last_billing_end_date int, p1_inactivity_t_f int")
    assert cohorts.cancel_type_matrix(flagged).count() == 0
    assert cohorts.paid_but_inactive_sample(flagged).count() == 0
    views = empty(spark, "account_id long, hw_category string, region_date int, profile_id long, darwin_t_f int, "
                  "stb_t_f int, view_secs long, session_cnt long")
    assert cohorts.main_device(views, mode="per_account").count() == 0
    wide = empty(spark, "account_id long, signup_date int, subdivision_desc string, prim_subdivision_iso_code string, "
                 "geo_desc string")
    assert geo.market_region_rollup(wide, {"X": ["a"]}, 20200101).count() == 0
    rej = empty(spark, "account_id long, subscrn_id long, signup_date int, is_rejoin int, "
                "p1_possible_complete_cnt int, p1_invol_cancel_cnt int, p1_vol_cancel_cnt int")
    assert partners.monthly_rejoin_rate(rej).count() == 0
    status = empty(spark, "acct_id string, fraud_flag int, cb_t_f int, fraud_reason_text string")
    assert payments.fraud_summary(status).count() == 0
