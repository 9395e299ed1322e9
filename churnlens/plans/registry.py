"""Registered queries: every analysis applied to the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
*whole* tables (filters are the analyses' own business filters, chosen for
the value ranges of the driver data: signups 1995-2001, events January 2024).
The matching DuckDB SQL lives in ``oracle/queries.py``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions import dates as D
from churnlens.functions import values as V
from churnlens.functions.lookups import FOCUS_ISSUERS, MARKET_DEFAULT, MARKET_REGIONS, SUBDIVISION_DEFAULT, SUBDIVISION_REGIONS
from churnlens.operators import aggregates as A
from churnlens.operators import joins as J
from churnlens.operators import windows as W
from churnlens.plans import cohorts, geo, partners, payments
from churnlens.session import shared_dir
from churnlens.sources import text
from churnlens.sources.daily import DailyTable
from churnlens.sources.warehouse import Warehouse

# Business parameters of the registered runs (values of the driver data).
P = {
    "partner": "AUTOMOBILE",
    "partner2": "BUILDING",
    "partner3": "FURNITURE",
    "channel": "1-URGENT",
    "since": 19960101,
    "country": "1",            # nation key as country code (subscription side)
    "country_desc": "NATION_1",
    "stb": "STANDARD",
    "eligible_country": "NATION_7",
    "event_country": "NATION_19",
    "pay_country": "19",
}

# Region buckets for the driver's nation names (the fixed lists in
# ``lookups`` name real states, which the driver data does not contain).
REGION_MAP = {
    "Northeast": [f"NATION_{i}" for i in range(0, 8)],
    "West": [f"NATION_{i}" for i in range(8, 16)],
}
MARKET_MAP = {
    "NorthEast": [f"NATION_{i}" for i in range(0, 5)] + [str(i) for i in range(0, 5)],
    "SouthEast": [f"NATION_{i}" for i in range(5, 10)] + [str(i) for i in range(5, 10)],
    "Central": [f"NATION_{i}" for i in range(10, 15)] + [str(i) for i in range(10, 15)],
    "West": [f"NATION_{i}" for i in range(15, 20)] + [str(i) for i in range(15, 20)],
}
POSTAL_SLICES = [(20240101, 20240115), (20240110, 20240131)]

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse(spark, sf_dir)


# --- cohorts ------------------------------------------------------------------------

def _cohort_c1(t: Warehouse) -> DataFrame:
    return cohorts.signup_cancel_reason(t.signup_retention, t.billing_subscription,
                                        P["partner"], P["channel"], P["since"])


def _flagged(t: Warehouse) -> DataFrame:
    return cohorts.inactivity_flag(_cohort_c1(t), t.device_activity, 1, P["since"],
                                   partner=P["partner"], channel=P["channel"])


def _outcome(t: Warehouse) -> DataFrame:
    return cohorts.subscription_outcome(cohorts.signup_cohort(t.subscription, 19980101, 19981231),
                                        t.billing_period, 2, 19980101)


def _views_by_device(t: Warehouse) -> DataFrame:
    return cohorts.title_views_by_device(t.title_views, t.device_type, 2, 20240101, 20240131,
                                         "darwin", P["stb"])


def q_signup_cancel_reason(s, d): return _cohort_c1(_t(s, d))
def q_inactivity_flag(s, d): return _flagged(_t(s, d))
def q_inactivity_flag_country(s, d):
    t = _t(s, d)
    return cohorts.inactivity_flag(_cohort_c1(t), t.device_activity, 1, P["since"], partner=P["partner"],
                                   channel=P["channel"], country=P["country_desc"])


def _flagged_all(t: Warehouse) -> DataFrame:
    """Every partner and channel: ends on one given day are rare."""
    return cohorts.inactivity_flag(
        cohorts.signup_cancel_reason(t.signup_retention, t.billing_subscription, None, None, 19950101),
        t.device_activity, 1, 19950101)


def q_paid_but_inactive_sample(s, d): return cohorts.paid_but_inactive_sample(_flagged_all(_t(s, d)), 31, 10)
def q_cancel_type_matrix(s, d): return cohorts.cancel_type_matrix(_flagged(_t(s, d)))
def q_daily_early_cancel(s, d): return cohorts.daily_early_cancel(_flagged(_t(s, d)), 7)
def q_days_in_subscription_hist(s, d): return cohorts.days_in_subscription_hist(_flagged(_t(s, d)), 19970101, 19991231)
def q_cancel_reason_same_day(s, d): return cohorts.cancel_reason_same_day(_flagged_all(_t(s, d)), 19950101, 20011231)
def q_signup_cohort(s, d): return cohorts.signup_cohort(_t(s, d).subscription, 19980101, 19980131)
def q_title_views_by_device(s, d): return _views_by_device(_t(s, d))
def q_subscription_outcome(s, d): return _outcome(_t(s, d))
def q_main_device(s, d): return cohorts.main_device(_views_by_device(_t(s, d)), 360, "per_category")
def q_main_device_per_account(s, d): return cohorts.main_device(_views_by_device(_t(s, d)), 360, "per_account")


def q_retention_by_exposure(s, d):
    t = _t(s, d)
    return cohorts.retention_by_exposure(_outcome(t), cohorts.main_device(_views_by_device(t), 360, "per_category"))


def q_account_period_rollup(s, d):
    return cohorts.account_period_rollup(_t(s, d).signup_retention, P["partner2"], 19950101, 20011231)


# --- partners ------------------------------------------------------------------------

def _eligible(t: Warehouse) -> DataFrame:
    return partners.eligible_partners(t.signup_retention, "OWN", 19980101, 19981231, P["eligible_country"], "STB")


def q_eligible_partners(s, d): return _eligible(_t(s, d))


def q_partner_retention_by_pmt(s, d):
    t = _t(s, d)
    return partners.partner_retention_by_pmt(t.signup_retention, t.billing_period, _eligible(t),
                                             19980101, 19981231, P["eligible_country"], "STB", P["partner2"],
                                             19950101)


def q_involuntary_cancel_list(s, d):
    t = _t(s, d)
    return partners.involuntary_cancel_list(t.signup_retention, t.billing_subscription, P["partner2"],
                                            19970101, 19971231, 19970101, 19981231)


def q_cancel_reason_by_hold(s, d):
    t = _t(s, d)
    return partners.cancel_reason_by_hold(t.signup_retention, t.billing_subscription, t.billing_period,
                                          t.subscription_hold, P["partner2"], 19970101, 19971231,
                                          19970101, 19981231, 19970101, 410, 19970101)


def q_cancel_reasons_eligible_partners(s, d):
    t = _t(s, d)
    return partners.cancel_reasons_eligible_partners(t.signup_retention, t.billing_subscription,
                                                     t.billing_period, _eligible(t), 19970101, 19971231,
                                                     19970101, 19981231, 19970101)


def q_partner_cancel_totals(s, d):
    return partners.partner_cancel_totals(_t(s, d).billing_period, 2, P["partner"], "Credit", P["country"],
                                          19950101)


def _activations(t: Warehouse, clean: bool = True) -> DataFrame:
    return partners.activated_bundles(t.subscription, P["since"], P["country"], P["partner"], "P", clean)


def q_stream_limit_by_plan(s, d):
    t = _t(s, d)
    return partners.stream_limit_by_plan(_activations(t, clean=False), t.stream_block, P["country"], 20240101)


def q_accounts_with_device_prefix(s, d):
    t = _t(s, d)
    return partners.accounts_with_device_prefix(_activations(t), t.signup_retention, "Customer#0000001",
                                                P["since"])


def _rejoins(t: Warehouse) -> DataFrame:
    return partners.rejoin_with_handle(t.signup_retention, t.partner_signup_service, P["partner3"],
                                       P["since"], 20240101)


def q_rejoin_with_handle(s, d): return _rejoins(_t(s, d))


def q_monthly_rejoin_rate(s, d):
    return partners.monthly_rejoin_rate(partners.rejoin_cohort(_t(s, d).signup_retention, P["partner3"],
                                                               P["since"]))


def q_top_accounts_by_subs(s, d):
    t = _t(s, d)
    return partners.top_accounts_by_subs(partners.rejoin_cohort(t.signup_retention, P["partner3"], P["since"]),
                                         partners.partner_handles(t.partner_signup_service, 20240101), 20)


def q_account_history(s, d): return partners.account_history(_rejoins(_t(s, d)), 2)


# --- geography ------------------------------------------------------------------------

def _ip_geo(t: Warehouse) -> DataFrame:
    return geo.ip_geo_attribution(t.signup_retention, t.connection_event, t.geo_market, P["partner2"],
                                  19950101, 20011231, 20240101, 20240131, "US")


def q_ip_geo_attribution(s, d): return _ip_geo(_t(s, d))
def q_involuntary_by_region(s, d): return geo.involuntary_by_region(_ip_geo(_t(s, d)))


def _postal(t: Warehouse, slices=None, country=None, pay_country=None) -> DataFrame:
    return geo.postal_attribution(t.event_signups, t.billing_period, t.payment_event, "STB", country,
                                  [P["partner"], P["partner2"], P["partner3"]], 19950101, pay_country, 1, 2, slices)


def q_postal_attribution(s, d): return _postal(_t(s, d))
def q_postal_attribution_slices(s, d): return _postal(_t(s, d), POSTAL_SLICES)
def q_postal_attribution_country(s, d):
    return _postal(_t(s, d), None, P["event_country"], P["pay_country"])


def q_postal_daily_rates(s, d): return geo.postal_daily_rates(_postal(_t(s, d)))


def q_postal_enrich(s, d):
    t = _t(s, d)
    return geo.postal_enrich(_postal(t), t.geo_postal)


def q_partner_state_summary(s, d):
    t = _t(s, d)
    return geo.partner_state_summary(_postal(t), t.geo_postal)


def _region_daily(t: Warehouse, activated_since=None) -> DataFrame:
    return geo.region_daily_signups(t.signup_funnel, t.geo_subdivision, t.subscription_signup,
                                    t.subscription, REGION_MAP, P["partner"], P["since"], P["country"],
                                    19951231, activated_since)


def q_region_daily_signups(s, d): return _region_daily(_t(s, d))
def q_region_daily_signups_activated(s, d): return _region_daily(_t(s, d), 19980701)
def q_bundle_activations(s, d):
    return _activations(_t(s, d)).select("account_id", "subscrn_id", "signup_date", "current_connected_to_account_id")


def _activation_geo(t: Warehouse, multiplicity: bool = True) -> DataFrame:
    return geo.activation_geo(t.signup_funnel, t.geo_subdivision, _activations(t), REGION_MAP, 19951231,
                              P["country"], multiplicity=multiplicity)


def _primary(t: Warehouse) -> DataFrame:
    return geo.attach_primary_geo(_activations(t), _activation_geo(t, False), t.account_geo, P["country"])


def _cohort_geo(t: Warehouse) -> DataFrame:
    return geo.attach_cohort_geo(_primary(t), t.partner_cohort)


def _wide(t: Warehouse) -> DataFrame:
    return geo.wide_geo(_activations(t), _activation_geo(t, False), t.account_geo, t.partner_cohort, P["country"])


def q_activation_geo(s, d): return _activation_geo(_t(s, d))
def q_activation_geo_weighted(s, d):
    t = _t(s, d)
    return geo.activation_geo_weighted(t.signup_funnel, t.geo_subdivision, _activations(t), REGION_MAP, 19951231, P["country"])


def _wide_factors(t: Warehouse) -> DataFrame:
    return geo.wide_geo_factors(_activations(t), _activation_geo(t, False), t.account_geo, t.partner_cohort, P["country"])


def q_wide_geo_factors(s, d): return _wide_factors(_t(s, d))
def q_attach_primary_geo(s, d): return _primary(_t(s, d))
def q_attach_cohort_geo(s, d): return _cohort_geo(_t(s, d))
def q_state_counts_priority(s, d): return geo.state_counts_priority(_cohort_geo(_t(s, d)), 20000101)
def q_wide_geo(s, d): return _wide(_t(s, d))


def _link_summary(t: Warehouse) -> DataFrame:
    """Stored once per input; both reports over the wide rows read it."""
    return t.intermediate("link_summary", geo.link_summary, _activation_geo(t, False), t.account_geo, t.partner_cohort,
                          about=repr((P, REGION_MAP)), country=P["country"])


# ``missingness_by_source`` and the roll-up are computed from the per-link
# summary (no activation x funnel x report rows are built);
# ``missingness_crosstab`` applies the operator to the rows of ``wide_geo``.
def q_missingness_crosstab(s, d):
    return A.missingness_crosstab(_wide(_t(s, d)), {
        "geo_acct_missing_t_f": "prim_subdivision_iso_code", "nm_geo_missing_t_f": "region", "rpt_missing_t_f": "geo_desc"})


def q_missingness_by_source(s, d):
    t = _t(s, d)
    return geo.missingness_from_summary(_activations(t), _link_summary(t))


def q_market_region_rollup(s, d):
    t = _t(s, d)
    return geo.market_rollup_from_summary(_activations(t), _link_summary(t), MARKET_MAP, 20000101)


def q_cohort_size(s, d): return geo.cohort_size(_t(s, d).partner_cohort, P["partner"], "PS", 19970520)


# --- payments ------------------------------------------------------------------------

def _attempt(spark: SparkSession, name: str, sf_dir: str) -> str:
    """A fresh folder for each write, so that earlier results stay readable."""
    return shared_dir(spark, f"{name}_{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}-{uuid.uuid4().hex}")


def q_ingest_delimited(s, d):
    t = _t(s, d)
    path = _attempt(s, "fraud_file", d)
    text.write_delimited(t.fraud_file, path)
    return text.read_delimited(s, path, text.FRAUD_FILE_SCHEMA)


def _pipe_lines(t: Warehouse) -> DataFrame:
    """Raw report lines: 16 pipe-separated fields from purchase events."""
    e = t.tables.events.filter(F.col("event_type") == "purchase")
    k = F.get_json_object("props", "$.k")
    fields = [F.lit("TC40"), F.col("event_id").cast("string"), F.col("user_id").cast("string"),
              F.concat(F.lit("R"), F.col("event_id").cast("string")), F.col("event_type"), k,
              F.lit("USD"), F.lit("-"), F.lit("-"), F.lit("-"), F.lit("-"),
              D.int_date("ts").cast("string"), F.lit("-"), F.col("value").cast("string"), F.lit("-"),
              (k.cast("int") % 10).cast("string")]
    # The column name is the file banner: the CSV writer puts it on top of
    # every part file, so each file starts with these two lines.
    return e.select(F.concat_ws("|", *fields).alias("TC40 ISSUER REPORT\nFIELDS 1-16"))


def q_ingest_pipe_columns(s, d):
    t = _t(s, d)
    path = _attempt(s, "pipe_file", d)
    # Each written file starts with two banner lines (report title and a
    # column header line), as issuer report files do.
    (_pipe_lines(t).write.mode("overwrite")
     .options(sep="\u0002", quote="", header="true").csv(path))
    raw = text.read_pipe_columns(s, path, [4, 12, 14, 16],
                                 ["referenceID", "experiation_date", "sale_amt", "fraud_reason"], skip=2)
    return raw.select("referenceID", F.col("experiation_date").cast("int").alias("experiation_date"),
                      F.col("sale_amt").cast("double").alias("sale_amt"), "fraud_reason")


def _reports(t: Warehouse) -> DataFrame:
    return payments.decode_reason(t.fraud_file)


def _matched(t: Warehouse) -> DataFrame:
    return payments.match_fraud_to_txn(t.payment_txn_event, _reports(t), 20240101)


def _status(t: Warehouse) -> DataFrame:
    return payments.fraud_chargeback_status(_matched(t), t.subscription, t.chargeback_summary,
                                            P["since"], 20240101)


def q_decode_reason(s, d): return _reports(_t(s, d))
def q_match_fraud_to_txn(s, d): return _matched(_t(s, d))
def q_fraud_chargeback_status(s, d): return _status(_t(s, d))
def q_fraud_summary(s, d): return payments.fraud_summary(_status(_t(s, d)))


def _payment_star(t: Warehouse) -> tuple[DataFrame, ...]:
    return t.payment_event, t.payment_method, t.institution, t.institution_group, t.geo_country


def q_chargeback_cube(s, d): return payments.chargeback_cube(*_payment_star(_t(s, d)), 20240101, 20231001)
def q_chargeback_amounts(s, d):
    return payments.chargeback_events(_t(s, d).payment_event, 20240101).select(
        "original_txn_id", "country_code", "processor", "original_txn_utc_date", "chargeback_amount")
def q_approved_renewals(s, d): return payments.approved_renewals(_t(s, d).renewal_agg, 20231001)
def q_approved_rejoin_charges(s, d): return payments.approved_rejoin_charges(_t(s, d).validation_agg, 20231001)


def _cb_vs(t: Warehouse, txn_type_map=None) -> DataFrame:
    return payments.chargeback_vs_approved(
        payments.chargeback_rows(*_payment_star(t), 20240101, 20231001), payments.approved_rejoin_charges(t.validation_agg, 20231001),
        payments.approved_renewals(t.renewal_agg, 20231001), FOCUS_ISSUERS, txn_type_map)


def q_chargeback_vs_approved(s, d): return _cb_vs(_t(s, d))
def q_chargeback_vs_approved_aligned(s, d): return _cb_vs(_t(s, d), {"SALE": "RENEWAL"})


def _refunds(t: Warehouse) -> DataFrame:
    return payments.refund_count_monthly(*_payment_star(t), 20231001)


def q_refund_count_monthly(s, d): return _refunds(_t(s, d))
def q_approved_monthly(s, d): return payments.approved_monthly(_t(s, d).renewal_agg, 20231001)


def q_refund_vs_approved(s, d):
    t = _t(s, d)
    return payments.refund_vs_approved(payments.approved_monthly(t.renewal_agg, 20231001), _refunds(t),
                                       FOCUS_ISSUERS)


def q_refresh_daily_view(s, d):
    """The payment events kept as a day table: first the days before the
    middle of the month, then a refresh that writes only the days since."""
    t = _t(s, d)
    rows = t.payment_event.select("event_utc_date", "account_id", "event_utc_ms_ts", "pmt_event_type", "country_code")
    table = DailyTable(s, _attempt(s, "daily", d), "event_utc_date")
    table.refresh(rows.filter(F.col("event_utc_date") < 20240115))
    table.refresh(rows)
    return table.read().select(rows.columns)


def q_drop_and_recreate(s, d):
    """A stored view (holds) that is written, dropped and written again."""
    own = Warehouse(s, d, version=f"dropped-{uuid.uuid4().hex}")
    own.build("subscription_hold")
    own.drop("subscription_hold")
    return own.subscription_hold


# --- building blocks on their own -------------------------------------------------------

def q_existence_flag(s, d):
    t = _t(s, d)
    cust = t.tables.customer.select(F.col("c_custkey").alias("account_id"))
    buyers = t.tables.events.filter(F.col("event_type") == "purchase").select(F.col("user_id").alias("account_id"))
    return J.existence_flag(cust, buyers, ["account_id"], "has_purchase")


def q_dedupe_first(s, d):
    li = _t(s, d).tables.lineitem
    order = [c for c in li.columns if c not in ("l_orderkey", "l_linenumber")]
    return W.dedupe_first(li, ["l_orderkey", "l_linenumber"], order, nearly_unique=True)


def q_dedupe_first_repeated(s, d):
    """The first event of each (user, type): keys repeat, so that map tasks
    reduce them."""
    e = _t(s, d).tables.events.select("user_id", "event_type", "ts", "event_id")
    return W.dedupe_first(e, ["user_id", "event_type"], ["ts", "event_id"])


def q_event_sequence(s, d):
    """Events numbered per user in time order; slices are (user, hour)."""
    e = _t(s, d).tables.events.select(
        "event_id", "user_id", "ts",
        (D.int_date("ts").cast("bigint") * 100 + F.hour("ts")).alias("event_hour"))
    return W.event_sequence(e, "user_id", "ts", "event_id", "event_hour", "row_cnt").select(
        "event_id", "user_id", "row_cnt")


def q_event_sequence_by_range(s, d):
    """The same numbers from rows sorted over all tasks: one user, or one
    hour of a user, may hold any share of the events."""
    def store(df: DataFrame) -> DataFrame:
        path = _attempt(s, "sequence", d)
        df.write.parquet(path)
        return s.read.schema(df.schema).parquet(path)

    e = _t(s, d).tables.events.select("event_id", "user_id", "ts")
    return W.event_sequence_by_range(e, "user_id", "ts", "event_id", store).select("event_id", "user_id", "row_cnt")


def q_distinct_pairs(s, d): return _t(s, d).tables.events.select("user_id", "event_type").distinct()


def q_region_bucket(s, d):
    """Region of every customer's nation (list-to-label bucketing)."""
    t = _t(s, d)
    nation = F.broadcast(t.tables.nation.select("n_nationkey", "n_name"))
    return (t.tables.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "n_name", V.bucket("n_name", REGION_MAP, "Other").alias("region")))


def q_region_bucket_states(s, d):
    """Both region lists over real state names, dealt to customers by number
    (the driver data name no states)."""
    names = sorted({x for values in [*SUBDIVISION_REGIONS.values(), *MARKET_REGIONS.values()] for x in values}) + ["Atlantis"]
    state = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("c_custkey") % len(names) + 1).cast("int"))
    named = _t(s, d).tables.customer.select("c_custkey", state.alias("state"))
    return named.select("c_custkey", "state", V.bucket("state", SUBDIVISION_REGIONS, SUBDIVISION_DEFAULT).alias("region"),
                        V.bucket("state", MARKET_REGIONS, MARKET_DEFAULT).alias("market"))


def q_normalise_institution(s, d):
    """Issuer label of every payment method (grouped name, else the cleaned
    raw name, upper-cased)."""
    t = _t(s, d)
    j = (t.payment_method.select("pmt_mop_metadata_sk", "pmt_institution_sk")
         .join(t.institution, "pmt_institution_sk")
         .join(t.institution_group, "pmt_institution_desc", "left"))
    return j.select("pmt_mop_metadata_sk",
                    V.normalise_institution("grouped_pmt_institution_desc", "pmt_institution_desc")
                    .alias("issuer_institution_desc_grp"))


def q_safe_cast_keys(s, d):
    txn = _t(s, d).payment_txn_event
    acct = V.map_key(txn, "other_properties", "customerId")
    return txn.select(acct.alias("acct_text"), V.safe_cast(acct, "bigint").alias("acct_id"))


def q_map_extract(s, d):
    pe = _t(s, d).payment_event
    m = "degenerate_values_map"
    return pe.select("account_id", "event_utc_ms_ts",
                     V.map_key(pe, m, "mop_postal_code").alias("mop_postal_code"),
                     V.map_key(pe, m, "is_duplicate").alias("is_duplicate"),
                     V.map_key(pe, m, "q").alias("q"))  # not stored: looked up in the map


def q_int_date_diff(s, d):
    bs = _t(s, d).billing_subscription
    return bs.select("subscrn_id", D.int_date_diff("billing_start_date", "billing_end_date").alias("days"))


def q_int_date_add(s, d):
    sub = _t(s, d).subscription
    return sub.select("subscrn_id", "signup_date", D.int_date_add("signup_date", 45).alias("plus_45"),
                      D.int_date_add("signup_date", -1).alias("minus_1"))


def q_int_date_month(s, d):
    sub = _t(s, d).subscription
    return sub.select("subscrn_id", D.int_date_month("signup_date").alias("signup_month"))


def q_int_date_timestamp(s, d):
    sub = _t(s, d).subscription
    return sub.select("subscrn_id", D.int_date_timestamp("signup_date").alias("signup_midnight"))


def q_epoch_ms_to_int_date(s, d):
    pe = _t(s, d).payment_event
    ms = V.map_key(pe, "degenerate_values_map", "original_txn_date")
    return pe.select("account_id", "event_utc_ms_ts", D.epoch_ms_to_int_date(ms).alias("original_txn_utc_date"))


def q_filter_date_range(s, d):
    sub = _t(s, d).subscription
    return sub.filter(F.col("signup_date").between(19970301, 19970331)).select("subscrn_id", "signup_date")


def q_filter_in_list(s, d):
    return _t(s, d).tables.part.filter(F.col("p_type").isin("PROMO", "SMALL")).select("p_partkey", "p_type")


def q_filter_sentinels(s, d):
    pe = _t(s, d).payment_event
    code = V.map_key(pe, "degenerate_values_map", "mop_postal_code")
    return pe.select("account_id", "event_utc_ms_ts", code.alias("mop_postal_code")).filter(
        V.not_sentinel("mop_postal_code", ("--",)))


def q_filter_clean_accounts(s, d):
    sub = _t(s, d).subscription
    return sub.filter(V.null_safe_zero("fraud_flag") == 0).select("subscrn_id", "fraud_flag")


def q_conditional_ratio(s, d):
    """Safe ratio with zero denominators: invol / complete per partner."""
    sr = _t(s, d).signup_retention
    c = A.conditional_distinct_counts(sr, ["partner_name", "acquisition_channel"], "subscrn_id",
                                      {"n_complete": F.col("p1_possible_complete_cnt") == 1,
                                       "n_invol": F.col("p1_invol_cancel_cnt") == 1})
    return c.withColumn("invol_rate", A.safe_ratio("n_invol", "n_complete"))


QUERIES: dict[str, Query] = {name[2:]: fn for name, fn in sorted(globals().items())
                             if name.startswith("q_") and callable(fn)}
