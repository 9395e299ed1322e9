"""Partner retention, cancel reasons, bundle plans and rejoin cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.dates import int_date_month
from churnlens.functions.values import flag, null_default
from churnlens.operators.aggregates import conditional_distinct_counts, safe_ratio
from churnlens.operators.joins import existence_flag, semi_by_aggregate

SUB_KEYS = ["account_id", "subscrn_id"]


def _period_one(periods: DataFrame, since: int) -> DataFrame:
    return (periods.filter((F.col("billing_period_nbr") == 1) & (F.col("billing_period_end_date") >= since))
            .select(*SUB_KEYS, "first_try_pmt_type_desc"))


def _pmt_type() -> F.Column:
    return null_default("first_try_pmt_type_desc", "Unknown").alias("signup_pmt_type_desc")


def eligible_partners(signups: DataFrame, native_mop: str, lo: int, hi: int, country: str, hw_category: str,
                      require_known: bool = False) -> DataFrame:
    """Partners whose signups in the window never used a non-native payment
    method.  As written, a NULL method adds to neither count, so a partner
    with only NULL methods qualifies; ``require_known`` also demands that no
    method is NULL."""
    scoped = signups.filter(F.col("signup_date").between(lo, hi) & (F.col("country_desc") == country)
                            & (F.col("signup_hw_category") == hw_category))
    agg = scoped.groupBy("partner_name").agg(
        F.sum(flag(F.col("mop_type") == native_mop)).cast("bigint").alias("native_mop"),
        F.sum(flag(F.col("mop_type") != native_mop)).cast("bigint").alias("partner_mop"),
        F.sum(flag(F.col("mop_type").isNull())).cast("bigint").alias("unknown_mop"))
    cond = F.col("partner_mop") == 0
    if require_known:
        cond = cond & (F.col("unknown_mop") == 0)
    return agg.filter(cond).drop("unknown_mop")


def partner_retention_by_pmt(signups: DataFrame, periods: DataFrame, eligible: DataFrame, lo: int, hi: int,
                             country: str, hw_category: str, focus_partner: str, p1_since: int) -> DataFrame:
    """Period-1 denominators and cancels by partner and signup payment type,
    for eligible partners only (a semi join: the partner list never
    multiplies rows).  Grouped by the three dimensions only (the original's
    ``group by 1,2,3,4,5`` names two aggregates)."""
    alloc = signups.filter((F.col("signup_hw_category") == hw_category) & (F.col("country_desc") == country)
                           & F.col("signup_date").between(lo, hi))
    alloc = semi_by_aggregate(alloc, eligible, ["partner_name"])
    j = alloc.join(_period_one(periods, p1_since), SUB_KEYS, "left")
    group = F.when(F.col("partner_name") == focus_partner, F.lit(focus_partner)).otherwise(F.lit("other"))
    return (j.groupBy("partner_name", group.alias("partner_name_grp"), _pmt_type())
            .agg(F.sum("p1_possible_complete_cnt").cast("bigint").alias("p1_denominator"),
                 F.sum("p1_invol_cancel_cnt").cast("bigint").alias("p1_invol_cancel"),
                 F.sum("p1_vol_cancel_cnt").cast("bigint").alias("p1_vol_cancel")))


def _ended(billing_subs: DataFrame, end_lo: int, end_hi: int) -> DataFrame:
    return (billing_subs.filter(F.col("billing_end_date").between(end_lo, end_hi))
            .select(*SUB_KEYS, "cancellation_reason_desc"))


def involuntary_cancel_list(signups: DataFrame, billing_subs: DataFrame, partner: str, lo: int, hi: int,
                            end_lo: int, end_hi: int) -> DataFrame:
    """Involuntarily cancelled subscriptions of one partner with reason."""
    alloc = signups.filter((F.col("p1_invol_cancel_cnt") == 1) & (F.col("partner_name") == partner)
                           & F.col("signup_date").between(lo, hi))
    return alloc.join(_ended(billing_subs, end_lo, end_hi), SUB_KEYS, "inner").select(
        *SUB_KEYS, "cancellation_reason_desc")


def cancel_reason_by_hold(signups: DataFrame, billing_subs: DataFrame, periods: DataFrame, holds: DataFrame,
                          partner: str, lo: int, hi: int, end_lo: int, end_hi: int, p1_since: int,
                          hold_type: int, hold_since: int) -> DataFrame:
    """Involuntary cancels by reason, signup payment type and on-hold flag."""
    alloc = signups.filter((F.col("p1_invol_cancel_cnt") == 1) & (F.col("partner_name") == partner)
                           & F.col("signup_date").between(lo, hi))
    j = (alloc.join(_ended(billing_subs, end_lo, end_hi), SUB_KEYS, "inner")
         .join(_period_one(periods, p1_since), SUB_KEYS, "left"))
    held = holds.filter((F.col("hold_type_id") == hold_type) & (F.col("event_date") >= hold_since))
    j = existence_flag(j, held, SUB_KEYS, "esn_hold_t_f")
    return (j.groupBy("cancellation_reason_desc", _pmt_type(), "esn_hold_t_f")
            .agg(F.count(F.lit(1)).alias("cnt_cancel_reason")))


def cancel_reasons_eligible_partners(signups: DataFrame, billing_subs: DataFrame, periods: DataFrame,
                                     eligible: DataFrame, lo: int, hi: int, end_lo: int, end_hi: int,
                                     p1_since: int) -> DataFrame:
    """Cancel reasons (voluntary or involuntary) for eligible partners."""
    alloc = signups.filter(((F.col("p1_invol_cancel_cnt") == 1) | (F.col("p1_vol_cancel_cnt") == 1))
                           & F.col("signup_date").between(lo, hi))
    alloc = semi_by_aggregate(alloc, eligible, ["partner_name"])
    j = (alloc.join(_ended(billing_subs, end_lo, end_hi), SUB_KEYS, "inner")
         .join(_period_one(periods, p1_since), SUB_KEYS, "left"))
    return (j.groupBy("cancellation_reason_desc", "p1_invol_cancel_cnt", "p1_vol_cancel_cnt", _pmt_type())
            .agg(F.count(F.lit(1)).alias("cnt_cancel_reason")))


def partner_cancel_totals(periods: DataFrame, period: int, partner: str, pmt_type: str, country: str,
                          since: int) -> DataFrame:
    """Denominator, voluntary and involuntary cancels of one partner's
    billing period, by end date, reason and payment method."""
    f = periods.filter((F.col("billing_period_nbr") == period) & (F.col("billing_partner_desc") == partner)
                       & (F.col("final_try_pmt_type_desc") == pmt_type)
                       & (F.coalesce(F.col("fraud_flag"), F.lit(0)) == 0)
                       & (F.col("country_iso_code") == country) & (F.col("billing_period_end_date") >= since))
    return (f.groupBy("billing_period_end_date", "cancellation_reason_desc", "final_try_pmt_method_desc")
            .agg(F.sum("possible_complete_cnt").cast("bigint").alias("denominator"),
                 F.sum("vol_cancel_cnt").cast("bigint").alias("num_vol_cancel"),
                 F.sum("invol_cancel_cnt").cast("bigint").alias("num_invol_cancel")))


def activated_bundles(subs: DataFrame, since: int, country: str, partner: str, sub_type: str = "P",
                      clean: bool = True) -> DataFrame:
    """Bundle subscriptions whose streaming account is linked (activated).
    ``clean`` also drops fraud (NULL counts as 0) and test accounts."""
    cond = ((F.col("signup_date") >= since) & (F.col("country_iso_code") == country)
            & (F.col("signup_subscription_type") == sub_type)
            & (F.col("signup_billing_partner_desc") == partner)
            & F.col("current_connected_to_account_id").isNotNull())
    if clean:
        cond = cond & (F.coalesce(F.col("fraud_flag"), F.lit(0)) == 0) & (F.col("is_tester") == 0)
    return subs.filter(cond)


def stream_limit_by_plan(activations: DataFrame, blocks: DataFrame, block_country: str,
                         block_since: int) -> DataFrame:
    """Activations and activations whose linked account hit the stream
    limit, by plan and signup month."""
    hit = (blocks.filter((F.col("country_iso_code") == block_country) & (F.col("event_utc_date") >= block_since))
           .select("customer_id").distinct())
    j = activations.join(hit, activations["current_connected_to_account_id"] == hit["customer_id"], "left")
    return (j.groupBy("signup_plan_id", "latest_plan_id", int_date_month("signup_date").alias("signup_month"))
            .agg(F.count_distinct("subscrn_id").alias("num_activations"),
                 F.count_distinct("customer_id").alias("num_activate_exceed")))


def accounts_with_device_prefix(activations: DataFrame, signups: DataFrame, prefix: str,
                                since: int) -> DataFrame:
    """Activations and activations whose linked account signed up on a
    device whose extended name starts with ``prefix``, by plan and month."""
    dev = (signups.filter(F.col("signup_device_type_extended_name").startswith(prefix)
                          & (F.col("signup_dateint") >= since))
           .select(F.col("account_id").alias("dev_account_id"), "signup_device_type_extended_name").distinct())
    j = activations.join(dev, activations["current_connected_to_account_id"] == dev["dev_account_id"], "left")
    return (j.groupBy("latest_plan_id", int_date_month("signup_date").alias("signup_month"))
            .agg(F.count_distinct("subscrn_id").alias("num_activations"),
                 F.count_distinct("dev_account_id").alias("num_activate_exceed")))


REJOIN_COLUMNS = ["account_id", "subscrn_id", "signup_date", "is_rejoin", "p1_possible_complete_cnt",
                  "p1_invol_cancel_cnt", "p1_vol_cancel_cnt"]


def rejoin_cohort(signups: DataFrame, partner: str, since: int) -> DataFrame:
    """One partner's signups since a date (no handle attached)."""
    return (signups.filter((F.col("partner_name") == partner) & (F.col("signup_date") >= since))
            .select(*REJOIN_COLUMNS))


def partner_handles(services: DataFrame, since: int) -> DataFrame:
    """Distinct (account, partner handle) pairs since a date."""
    return (services.filter(F.col("processing_utc_date") >= since)
            .select("account_id", F.col("billing_partner_handle").alias("pai")).distinct())


def rejoin_with_handle(signups: DataFrame, services: DataFrame, partner: str, since: int,
                       handle_since: int) -> DataFrame:
    """Rejoin cohort with the partner handle of the account (left join: an
    account with several handles has one row per handle)."""
    return (rejoin_cohort(signups, partner, since)
            .join(partner_handles(services, handle_since), "account_id", "left")
            .select("account_id", "pai", *REJOIN_COLUMNS[1:]))


def monthly_rejoin_rate(rejoins: DataFrame) -> DataFrame:
    """Completed signups, involuntary cancels and their ratio by signup
    month and rejoin flag (distinct subscriptions)."""
    counts = conditional_distinct_counts(
        rejoins.withColumn("signup_month", int_date_month("signup_date")),
        ["signup_month", "is_rejoin"], "subscrn_id",
        {"num_signup": F.col("p1_possible_complete_cnt") == 1,
         "num_invol": F.col("p1_invol_cancel_cnt") == 1})
    return counts.withColumn("invol_rate", safe_ratio("num_invol", "num_signup"))


def top_accounts_by_subs(signups: DataFrame, handles: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` (handle, account) pairs with the most distinct rejoin
    subscriptions (ties by handle then account).

    Subscriptions are counted per account first and the handles attached
    afterwards, which gives the same counts as counting over the
    subscription x handle rows without ever building them.
    """
    per_account = (signups.filter(F.col("is_rejoin") == 1)
                   .groupBy("account_id").agg(F.count_distinct("subscrn_id").alias("num_subs")))
    j = per_account.join(handles, "account_id", "left")
    return (j.select("pai", "account_id", "num_subs")
            .orderBy(F.col("num_subs").desc(), F.col("pai").asc_nulls_first(), F.col("account_id").asc())
            .limit(k))


def account_history(rejoins: DataFrame, account_id: int) -> DataFrame:
    """Signup dates of one account (one row per cohort row)."""
    return rejoins.filter(F.col("account_id") == account_id).select("signup_date")
