"""Signup cohorts, first-period inactivity, retention and main device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.dates import int_date_diff
from churnlens.functions.lookups import (
    HISTOGRAM_CAP,
    HISTOGRAM_OVERFLOW,
    INVOLUNTARY_REASONS,
    QUALIFIED_PLAY_SECS,
    VOLUNTARY_REASONS,
)
from churnlens.functions.values import bucket, capped, flag
from churnlens.operators.aggregates import conditional_distinct_counts

SUB_KEYS = ["account_id", "subscrn_id"]


def _days_in_subscription() -> Column:
    return int_date_diff("signup_dateint", "last_billing_end_date")


def signup_cancel_reason(signups: DataFrame, billing_subs: DataFrame, partner: str | None, channel: str | None,
                         since: int) -> DataFrame:
    """Partner signup cohort with cancel reason, status, latest period and
    last billing end date (one row per subscription x reason x status).

    The billing side's date floor sits in the WHERE clause in the original
    report, which turns its left join into an inner join; it is written as
    an inner join here.  Without ``partner`` or ``channel`` all of them count.
    """
    base = signups.filter(F.col("signup_dateint") >= since)
    if partner is not None:
        base = base.filter(F.col("signup_mop_partner_name") == partner)
    if channel is not None:
        base = base.filter(F.col("acquisition_channel") == channel)
    bs = billing_subs.filter(F.col("billing_start_date") >= since).select(
        *SUB_KEYS, "cancellation_reason_desc", "subscrn_status",
        "latest_billing_period_nbr", "billing_end_date")
    return (base.join(bs, SUB_KEYS, "inner")
            .groupBy("account_id", "subscrn_id", "signup_mop_partner_name", "acquisition_channel",
                     "signup_dateint", "cancellation_reason_desc", "subscrn_status")
            .agg(F.max("latest_billing_period_nbr").alias("latest_billing_period_nbr"),
                 F.max("billing_end_date").alias("last_billing_end_date")))


def inactivity_flag(cohort: DataFrame, activity: DataFrame, period: int, since: int,
                    partner: str | None = None, channel: str | None = None, country: str | None = None,
                    null_is_inactive: bool = False) -> DataFrame:
    """Cohort rows with period viewing seconds and an inactivity flag.

    Viewing is summed per (account, subscription, fraud flag) before the
    left join (so a subscription whose rows carry two fraud flags yields two
    rows, as in the original).  As written, a subscription with no viewing
    row has NULL seconds and is flagged 0; ``null_is_inactive=True`` flags
    it 1 instead.
    """
    cond = (F.col("billing_period_nbr") == period) & (F.col("billing_period_end_date") >= since)
    if partner is not None:
        cond = cond & (F.col("signup_mop_partner_name") == partner)
    if channel is not None:
        cond = cond & (F.col("signup_acquisition_channel") == channel)
    if country is not None:
        cond = cond & (F.col("country_desc") == country)
    view = (activity.filter(cond)
            .groupBy(*SUB_KEYS, "fraud_flag")
            .agg(F.sum("device_billing_period_view_secs").alias("view_secs")))
    secs = F.coalesce(F.col("view_secs"), F.lit(0)) if null_is_inactive else F.col("view_secs")
    return (cohort.join(view, SUB_KEYS, "left")
            .withColumn("p1_inactivity_t_f", flag(secs == 0)))


def paid_but_inactive_sample(flagged: DataFrame, days: int = 31, n: int = 10,
                             order_by: Sequence[str] = ("account_id", "subscrn_id", "cancellation_reason_desc",
                                                        "subscrn_status", "fraud_flag")) -> DataFrame:
    """A deterministic sample of subscriptions that lasted exactly ``days``
    days (the original shows ``limit 10`` without an order; a total order is
    imposed so the sample is reproducible).  The limit is the feature here:
    Spark keeps a per-partition top-n, then merges."""
    return (flagged.filter(_days_in_subscription() == days)
            .orderBy(*[F.col(c).asc_nulls_first() for c in order_by])
            .limit(n))


def cancel_type_matrix(flagged: DataFrame) -> DataFrame:
    """Counts by cancel type (vol / invol / open), days since signup and
    inactivity.  NULL or unlisted reasons count as ``open``."""
    kind = bucket("cancellation_reason_desc",
                  {"vol_cancel": VOLUNTARY_REASONS, "invol_cancel": INVOLUNTARY_REASONS}, "open")
    return (flagged.groupBy(kind.alias("subscrn_status"),
                            _days_in_subscription().alias("cancel_days_since_signup"),
                            F.col("p1_inactivity_t_f"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def daily_early_cancel(flagged: DataFrame, days: int = 7) -> DataFrame:
    """Signups per day and how many ended within ``days`` days."""
    return flagged.groupBy("signup_dateint").agg(
        F.count(F.lit(1)).alias("num_signups"),
        F.sum(flag(_days_in_subscription() <= days)).cast("bigint").alias(f"num_cancel_within_{days}_days"))


def days_in_subscription_hist(flagged: DataFrame, lo: int, hi: int, cap: int = HISTOGRAM_CAP,
                              overflow: int = HISTOGRAM_OVERFLOW) -> DataFrame:
    """Histogram of days in subscription, values above ``cap`` (and NULL)
    in the ``overflow`` bucket, with the number of inactive signups."""
    return (flagged.filter(F.col("signup_dateint").between(lo, hi))
            .groupBy(capped(_days_in_subscription(), cap, overflow).alias("days_in_subscrn"))
            .agg(F.count(F.lit(1)).alias("total_signups"),
                 F.sum("p1_inactivity_t_f").cast("bigint").alias("sum_p1_inactivity")))


def cancel_reason_same_day(flagged: DataFrame, lo: int, hi: int) -> DataFrame:
    """Reasons of subscriptions that ended on their signup day."""
    return (flagged.filter(F.col("signup_dateint").between(lo, hi) & (_days_in_subscription() == 0))
            .groupBy("cancellation_reason_desc")
            .agg(F.count(F.lit(1)).alias("total_signups")))


SIGNUP_COHORT_COLUMNS = [
    "account_id", "subscrn_id", "signup_date", "signup_ts", "signup_billing_partner_desc",
    "package_offer_provider_desc", "is_channel_giftcard", "is_free_trial_at_signup", "fraud_flag",
    "country_iso_code", "signup_plan_id", "latest_plan_id", "is_voluntary_cancel", "signup_device_type_id",
    "signup_utc_ts", "is_dcb_signup", "is_mds", "is_rejoin", "latest_service_stop_date", "latest_subscrn_period_nbr",
]


def signup_cohort(subs: DataFrame, lo: int, hi: int, columns: Sequence[str] = SIGNUP_COHORT_COLUMNS) -> DataFrame:
    """Subscriptions that signed up between ``lo`` and ``hi`` (inclusive)."""
    return subs.filter(F.col("signup_date").between(lo, hi)).select(*columns)


def title_views_by_device(views: DataFrame, devices: DataFrame, title: int, lo: int, hi: int,
                          ui_token: str = "darwin", stb_category: str = "MVPD Set Top Box") -> DataFrame:
    """Viewing of one title by account, profile and device, with device
    attributes (left join: unknown devices keep NULL attributes)."""
    a = views.filter(F.col("region_date").between(lo, hi) & (F.col("show_title_id") == title)
                     & (F.col("is_test_play") == 0))
    d = devices.select("device_type_id", "device_type_name", "brand", "mso_partner", "hw_category")
    j = a.join(d, a["play_device_type_id"] == d["device_type_id"], "left")
    return (j.groupBy(
                "country_iso_code", "region_date", "play_device_type_id", "play_device_model", "account_id",
                "profile_id",
                flag(F.lower(F.col("play_ui_version")).contains(ui_token.lower())).alias("darwin_t_f"),
                "device_type_name", "brand", "mso_partner", "hw_category",
                flag(F.col("hw_category") == stb_category).alias("stb_t_f"))
            .agg(F.sum("standard_sanitized_duration_sec").alias("view_secs"),
                 F.sum("session_cnt").alias("session_cnt")))


OUTCOME_MAX = ["vol_cancel_cnt", "invol_cancel_cnt", "invol_vol_cancel_cnt", "onhold_cnt", "recovered_cnt"]


def subscription_outcome(cohort: DataFrame, periods: DataFrame, max_period: int, since: int,
                         base_unique: bool = True) -> DataFrame:
    """Outcome of each cohort subscription over its first ``max_period``
    completed periods: latest period, cancel / hold flags (max) and net
    revenue (NULL revenue counts as 0).

    The billing fact is aggregated per subscription *before* the join, so
    the join reads one row per subscription instead of every period.  If
    the cohort may hold duplicate rows, ``base_unique=False`` regroups on
    all cohort columns after the join, which reproduces the original
    group-by exactly (duplicates multiply the revenue sum).
    """
    bp = (periods.filter((F.col("possible_complete_cnt") == 1) & (F.col("billing_period_end_date") >= since)
                         & (F.col("is_tester_account") == 0) & (F.col("billing_period_nbr") <= max_period))
          .groupBy(*SUB_KEYS)
          .agg(F.max("billing_period_nbr").alias("billing_period_nbr"),
               *[F.max(c).alias(c) for c in OUTCOME_MAX],
               F.sum(F.coalesce(F.col("adjusted_revenue_amt_usd"), F.lit(0))).alias("net_revenue")))
    out = cohort.join(bp, SUB_KEYS, "inner")
    if not base_unique:
        out = out.groupBy(*cohort.columns).agg(
            F.max("billing_period_nbr").alias("billing_period_nbr"),
            *[F.max(c).alias(c) for c in OUTCOME_MAX],
            F.sum("net_revenue").alias("net_revenue"))
    return out.withColumn("net_revenue", F.col("net_revenue").cast("double"))


def main_device(views_by_device: DataFrame, min_secs: int = QUALIFIED_PLAY_SECS,
                mode: str = "per_category") -> DataFrame:
    """Qualified viewing per (account, device category) with a device rank.

    ``per_category`` reproduces the original: the rank is partitioned by the
    same keys the rows were grouped by, so every row has rank 1 (no window
    is computed for a constant).  ``per_account`` ranks categories within an
    account by minutes (ties by category), the evident intent.
    """
    a = (views_by_device.filter(F.col("view_secs") >= min_secs)
         .groupBy("account_id", "hw_category")
         .agg(F.min("region_date").alias("first_view_date"),
              F.count_distinct("profile_id").alias("num_profiles"),
              F.max("darwin_t_f").alias("darwin_t_f"),
              F.max("stb_t_f").alias("stb_t_f"),
              (F.sum("view_secs") / 60).alias("view_minutes"),
              F.sum("session_cnt").alias("total_sessions")))
    if mode == "per_category":
        return a.withColumn("device_rank", F.lit(1))
    if mode == "per_account":
        w = Window.partitionBy("account_id").orderBy(F.col("view_minutes").desc(),
                                                     F.col("hw_category").asc_nulls_first())
        return a.withColumn("device_rank", F.row_number().over(w))
    raise ValueError(f"unknown mode {mode!r}")


def retention_by_exposure(outcome: DataFrame, devices: DataFrame) -> DataFrame:
    """Signups and period-2 retained subscriptions by main device category
    and whether the account watched at all.  Every account of ``devices``
    has a row of rank 1, so one join gives both the category and the flag."""
    top = devices.filter(F.col("device_rank") == 1).select("account_id", "hw_category", F.lit(1).alias("watched"))
    j = outcome.join(top, "account_id", "left").withColumn("watch_t_f", F.coalesce("watched", F.lit(0)))
    retained = (F.col("billing_period_nbr") == 2) & (F.col("invol_vol_cancel_cnt") != 1)
    return conditional_distinct_counts(j, ["hw_category", "watch_t_f"], "subscrn_id",
                                       {"num_signups": None, "num_retained": retained})


def account_period_rollup(signups: DataFrame, partner: str, lo: int, hi: int) -> DataFrame:
    """Per account: any period-1 completion / cancel (max of 0/1 flags) and
    the first signup date."""
    return (signups.filter((F.col("partner_name") == partner) & F.col("signup_date").between(lo, hi))
            .groupBy("account_id")
            .agg(F.max("p1_possible_complete_cnt").alias("p1_possible_complete_cnt"),
                 F.max("p1_invol_cancel_cnt").alias("p1_invol_cancel_cnt"),
                 F.max("p1_vol_cancel_cnt").alias("p1_vol_cancel_cnt"),
                 F.min("signup_date").alias("signup_date")))
