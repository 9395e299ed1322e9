"""Fraud reports, chargebacks, refunds and approved transactions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.dates import epoch_ms_to_int_date, int_date_month
from churnlens.functions.lookups import FOCUS_ISSUERS, FRAUD_REASONS
from churnlens.functions.values import decode, flag, map_key, normalise_institution, not_sentinel, safe_cast

# --- issuer fraud reports ------------------------------------------------------------


def decode_reason(reports: DataFrame, col: str = "fraud_reason", mapping: Mapping[str, str] = FRAUD_REASONS,
                  name: str = "fraud_reason_text") -> DataFrame:
    """Add the reason text; unknown codes pass through unchanged."""
    return reports.withColumn(name, decode(col, mapping, passthrough=True))


def match_fraud_to_txn(txns: DataFrame, reports: DataFrame, since: int) -> DataFrame:
    """Payment transactions named by a fraud report (inner join on the
    report reference, read from the transaction's property map)."""
    def prop(key):
        return map_key(txns, "other_properties", key)

    t = (txns.filter(F.col("dateint") >= since)
         .select(prop("customerId").alias("acct_id"), prop("isoCountryCode").alias("country_code"),
                 prop("referenceId").alias("referenceId")))
    r = reports.select(F.col("referenceID").alias("report_ref"), "fraud_reason_text")
    return t.join(r, t["referenceId"] == r["report_ref"], "inner").drop("report_ref")


def fraud_chargeback_status(matched: DataFrame, subs: DataFrame, chargebacks: DataFrame, sub_since: int,
                            cb_since: int, keep_unmatched: bool = False) -> DataFrame:
    """Fraud-reported transactions with the account's fraud flag and a
    chargeback flag.

    The original left-joins every subscription and every chargeback of the
    account and then requires both to exist, so each report row is repeated
    (subscriptions x chargebacks of the account) times with identical
    values, and the chargeback flag is always 1.  Here the subscription side
    is reduced to distinct (account, fraud flag) and the chargeback side to
    distinct accounts before joining: the same distinct rows, without the
    per-account pairs; ``row_weight`` is the number of times the original
    repeats the row.  ``keep_unmatched`` keeps reports whose account has
    no subscription or chargeback (flag 0).
    """
    m = matched.filter(F.col("acct_id") != "null").withColumn("acct_key", safe_cast("acct_id", "bigint"))
    a = (subs.filter(F.col("signup_date") >= sub_since)
         .groupBy(F.col("account_id").alias("a_account_id"), "fraud_flag").agg(F.count(F.lit(1)).alias("a_rows")))
    cb = (chargebacks.filter(F.col("cb_event_utc_date") >= cb_since)
          .groupBy(F.col("account_id").alias("cb_account_id")).agg(F.count(F.lit(1)).alias("cb_rows")))
    how = "left" if keep_unmatched else "inner"
    return (m.join(a, m["acct_key"] == a["a_account_id"], how)
            .join(cb, m["acct_key"] == cb["cb_account_id"], how)
            .withColumn("cb_t_f", flag(F.col("cb_account_id").isNotNull()))
            .withColumn("row_weight", F.coalesce("a_rows", F.lit(1)) * F.coalesce("cb_rows", F.lit(1)))
            .drop("acct_key", "a_account_id", "cb_account_id", "a_rows", "cb_rows"))


def fraud_summary(status: DataFrame) -> DataFrame:
    """Distinct accounts by fraud flag, chargeback flag and reason text."""
    return (status.groupBy("fraud_flag", "cb_t_f", "fraud_reason_text")
            .agg(F.count_distinct("acct_id").alias("num_accts")))


# --- chargebacks against approved transactions -----------------------------------------

CUBE_KEYS = ["event_utc_date", "txn_type", "processor", "retry_mode", "billing_period_nbr", "token_used",
             "estaff_subregion_desc", "country_desc", "issuer_institution_desc_grp", "pmt_brand", "pmt_type",
             "bin"]
JOIN_KEYS = ["txn_type", "processor", "billing_period_nbr", "token_used", "country_desc",
             "issuer_institution_desc_grp", "pmt_brand", "pmt_type", "bin"]


def chargeback_events(payments: DataFrame, since: int) -> DataFrame:
    """Chargeback events with their map properties (stored key columns where
    the table has them); duplicates and unknown processors removed, amounts in
    units, not cents."""
    def value(key):
        return map_key(payments, "degenerate_values_map", key)

    cb = payments.filter((F.col("pmt_event_type") == "chargeback_transaction") & (F.col("event_utc_date") >= since))
    cb = cb.select(
        F.col("event_utc_date").alias("chargeback_event_utc_date"),
        "country_code",
        value("original_txn_pmt_processor").alias("processor"),
        map_key(payments, "natural_key_map", "original_txn_id").alias("original_txn_id"),
        value("original_txn_type").alias("original_txn_type"),
        safe_cast(value("billing_period"), "int").alias("billing_period_nbr"),
        value("retry_mode").alias("raw_retry_mode"),
        epoch_ms_to_int_date(value("original_txn_date")).alias("original_txn_utc_date"),
        value("token_used").alias("token_used"),
        F.coalesce(value("is_chained_txn"), F.lit("false")).alias("is_chained_txn"),
        F.coalesce(value("is_duplicate"), F.lit("false")).alias("is_duplicate"),
        map_key(payments, "dimension_sk_map", "pmt_mop_metadata_sk").alias("pmt_mop_metadata_sk"),
        map_key(payments, "facts_map", "record_count").alias("chargeback_cnt"),
        (map_key(payments, "facts_map", "chargeback_amount") / 100).alias("chargeback_amount"),
    )
    return cb.filter((F.col("is_duplicate") != "true") & not_sentinel("processor", ("--",)))


def _issuer_dims(methods: DataFrame, institutions: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    inst = institutions.select("pmt_institution_sk", "pmt_institution_desc")
    grp = groups.select(F.col("pmt_institution_desc").alias("g_desc"), "grouped_pmt_institution_desc")
    mop = methods.join(inst, "pmt_institution_sk", how)
    return mop.join(grp, mop["pmt_institution_desc"] == grp["g_desc"], "left").drop("g_desc")


def chargeback_rows(payments: DataFrame, methods: DataFrame, institutions: DataFrame, groups: DataFrame,
                    countries: DataFrame, cb_since: int, event_since: int) -> DataFrame:
    """Chargebacks with the twelve dimensions of the cube (star join to
    payment method, issuer, issuer group and country), one row per event."""
    cb = chargeback_events(payments, cb_since)
    dims = _issuer_dims(methods, institutions, groups, "inner")
    geo = countries.select(F.col("country_iso_code").alias("geo_country"), "estaff_subregion_desc", "country_desc")
    j = (cb.join(dims, "pmt_mop_metadata_sk", "inner")
         .join(geo, cb["country_code"] == geo["geo_country"], "inner")
         .filter(F.col("original_txn_utc_date") >= event_since))
    sale = F.col("original_txn_type") == "SALE"
    return j.select(
        F.col("original_txn_utc_date").alias("event_utc_date"),
        F.when(sale, "RENEWAL").otherwise("REJOIN_CHARGE").alias("txn_type"),
        "processor",
        F.when(F.col("original_txn_type") != "SALE", F.lit("REJOIN_CHARGE"))
        .otherwise(F.col("raw_retry_mode")).alias("retry_mode"),
        "billing_period_nbr", "token_used", "estaff_subregion_desc", "country_desc",
        normalise_institution("grouped_pmt_institution_desc", "pmt_institution_desc")
        .alias("issuer_institution_desc_grp"),
        F.col("affiliation").alias("pmt_brand"), F.col("pmt_type_desc").alias("pmt_type"),
        F.col("clear_bin").alias("bin"), "chargeback_cnt")


def chargeback_cube(payments: DataFrame, methods: DataFrame, institutions: DataFrame, groups: DataFrame,
                    countries: DataFrame, cb_since: int, event_since: int) -> DataFrame:
    """Chargeback counts by original transaction day and eleven dimensions."""
    rows = chargeback_rows(payments, methods, institutions, groups, countries, cb_since, event_since)
    return rows.groupBy(*CUBE_KEYS).agg(F.sum("chargeback_cnt").alias("chargeback_cnt"))


def approved_renewals(renewals: DataFrame, since: int) -> DataFrame:
    """Approved renewals by day and dimensions (transaction type 'SALE')."""
    keys = [k for k in CUBE_KEYS if k != "txn_type"]
    out = (renewals.filter(F.col("event_utc_date") >= since)
           .groupBy(*keys).agg(F.sum("approved_cnt").cast("bigint").alias("approved_cnt")))
    return out.select("event_utc_date", F.lit("SALE").alias("txn_type"), *keys[1:], "approved_cnt")


def approved_rejoin_charges(validations: DataFrame, since: int) -> DataFrame:
    """Approved rejoin charges by day and dimensions, with the constant
    type, retry mode, period 1 and no token."""
    keys = ["event_utc_date", "processor", "estaff_subregion_desc", "country_desc", "issuer_institution_desc_grp",
            "pmt_brand", "pmt_type", "bin"]
    out = (validations.filter(F.col("event_utc_date") >= since)
           .groupBy(*keys).agg(F.sum("charge_approved_cnt").cast("bigint").alias("approved_cnt")))
    return out.select(
        "event_utc_date", F.lit("REJOIN_CHARGE").alias("txn_type"), "processor",
        F.lit("REJOIN_CHARGE").alias("retry_mode"), F.lit(1).alias("billing_period_nbr"),
        F.lit("false").alias("token_used"), "estaff_subregion_desc", "country_desc",
        "issuer_institution_desc_grp", "pmt_brand", "pmt_type", "bin", "approved_cnt")


def _key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    conds = [(left[k].eqNullSafe(r[f"r_{k}"]) if null_safe else left[k] == r[f"r_{k}"]) for k in keys]
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    return left.join(r, cond, "left").drop(*[f"r_{k}" for k in keys])


GRAIN = "grain"
#: The period that renewals, and chargebacks compared with them, are put in.
RENEWAL_PERIOD = 2


def _at_grain(df: DataFrame, issuers: Sequence[str], measure: str) -> DataFrame:
    return (df.filter(F.col("issuer_institution_desc_grp").isin(list(issuers)))
            .groupBy(GRAIN, *JOIN_KEYS).agg(F.sum(measure).alias(measure)))


def approved_by_grain(rejoin_charges: DataFrame, renewals: DataFrame, issuers: Sequence[str],
                      txn_type_map: Mapping[str, str] | None = None) -> DataFrame:
    """Positive approved counts of both branches at the nine-key grain:
    rejoin charges with their own period (grain 0), renewals with the forced
    one (grain 1)."""
    kind = F.col("txn_type")
    if txn_type_map:
        kind = decode("txn_type", txn_type_map, passthrough=True)
    own = [k for k in JOIN_KEYS if k not in ("txn_type", "billing_period_nbr")]

    def branch(df: DataFrame, grain: int, txn_type, period) -> DataFrame:
        return df.filter(F.col("approved_cnt") > 0).select(
            F.lit(grain).alias(GRAIN), txn_type.alias("txn_type"), period.cast("int").alias("billing_period_nbr"), *own, "approved_cnt")

    both = (branch(rejoin_charges, 0, F.col("txn_type"), F.col("billing_period_nbr"))
            .unionByName(branch(renewals, 1, kind, F.lit(RENEWAL_PERIOD))))
    return _at_grain(both, issuers, "approved_cnt")


def chargebacks_by_grain(chargebacks: DataFrame, issuers: Sequence[str]) -> DataFrame:
    """Chargebacks at the nine-key grain, once with their own period (grain
    0) and once with the forced one (grain 1), in one aggregation: the grain
    and its period are the two grouping sets.  They are dealt by ``explode``
    and not by ``GROUPING SETS``, because the second set needs a key of its
    own value, not a NULL, to join on; map tasks reduce both before the
    shuffle."""
    sets = F.array(F.struct(F.lit(0).alias(GRAIN), F.col("billing_period_nbr").cast("int").alias("period")),
                   F.struct(F.lit(1).alias(GRAIN), F.lit(RENEWAL_PERIOD).alias("period")))
    own = [k for k in JOIN_KEYS if k != "billing_period_nbr"]
    both = (chargebacks.select(*own, "chargeback_cnt", F.explode(sets).alias("set"))
            .select(F.col("set")[GRAIN].alias(GRAIN), F.col("set")["period"].alias("billing_period_nbr"), *own, "chargeback_cnt"))
    return _at_grain(both, issuers, "chargeback_cnt")


def chargeback_vs_approved(chargebacks: DataFrame, rejoin_charges: DataFrame, renewals: DataFrame,
                           issuers: Iterable[str] = FOCUS_ISSUERS, txn_type_map: Mapping[str, str] | None = None,
                           null_safe: bool = False) -> DataFrame:
    """Approved counts with matching chargeback counts (0 when none) at a
    nine-key grain, for rejoin charges and for renewals (period forced to
    2 on both sides), restricted to the focus issuers; the two branches are
    concatenated.

    ``chargebacks`` is :func:`chargeback_rows` or anything coarser that keeps
    the nine keys, such as :func:`chargeback_cube`.  Both branches are one
    stack with a ``grain`` key: the chargebacks are scanned, star-joined and
    aggregated once, the approved counts aggregated once, and one join on the
    grain and the nine keys, which both sides are already dealt by, serves
    both.

    As written, the renewal branch is typed ``'SALE'`` while chargebacks are
    typed ``'RENEWAL'`` / ``'REJOIN_CHARGE'``, so its chargeback count is
    always 0; ``txn_type_map={'SALE': 'RENEWAL'}`` aligns them.  Keys are
    compared with SQL ``=`` (NULL never matches) unless ``null_safe``.
    """
    issuers = list(issuers)
    approved = approved_by_grain(rejoin_charges, renewals, issuers, txn_type_map)
    joined = _key_join(approved, chargebacks_by_grain(chargebacks, issuers), [GRAIN, *JOIN_KEYS], null_safe)
    return joined.select(*JOIN_KEYS, "approved_cnt", F.coalesce(F.col("chargeback_cnt"), F.lit(0.0)).alias("chargeback_cnt"))


MONTH_KEYS = ["event_utc_month", "estaff_subregion_desc", "country_desc", "country_iso_code",
              "issuer_institution_desc_grp", "pmt_method", "pmt_type", "pmt_brand", "bin"]


def refund_count_monthly(payments: DataFrame, methods: DataFrame, institutions: DataFrame, groups: DataFrame,
                         countries: DataFrame, since: int, normalise: bool = False) -> DataFrame:
    """Distinct approved refunds per month and payment dimensions; every
    dimension is left-joined and defaults to ``'UNKNOWN'``.

    As written the issuer label is the raw grouped name; ``normalise``
    applies the same upper-case / quote rule as the approved side.
    """
    def value(key):
        return map_key(payments, "degenerate_values_map", key)

    f = (payments.filter((F.col("event_utc_date") >= since) & (F.col("pmt_event_type") == "payment_transaction")
                         & (value("txn_type") == "REFUND") & (value("txn_status") == "APPROVED"))
         .select("event_utc_date", "country_code", value("mop_type").alias("mop_type"),
                 map_key(payments, "natural_key_map", "req_proc_ref_id").alias("req_proc_ref_id"),
                 map_key(payments, "dimension_sk_map", "pmt_mop_metadata_sk").alias("pmt_mop_metadata_sk")))
    dims = _issuer_dims(methods, institutions, groups, "left")
    geo = countries.select(F.col("country_iso_code").alias("geo_country"), "estaff_subregion_desc", "country_desc")
    j = (f.join(dims, "pmt_mop_metadata_sk", "left")
         .join(geo, f["country_code"] == geo["geo_country"], "left"))
    issuer = (normalise_institution("grouped_pmt_institution_desc", F.lit(None).cast("string"))
              if normalise else F.col("grouped_pmt_institution_desc"))
    method = F.coalesce(F.col("dse_pmt_method"),
                        F.when(F.col("mop_type") == "CC", F.lit("Card")).otherwise(F.lit("UNKNOWN")))
    return (j.groupBy(
                int_date_month("event_utc_date").alias("event_utc_month"),
                "estaff_subregion_desc", "country_desc", F.col("geo_country").alias("country_iso_code"),
                F.coalesce(issuer, F.lit("UNKNOWN")).alias("issuer_desc_grouped"),
                method.alias("pmt_method"),
                F.coalesce(F.col("pmt_type_desc"), F.lit("UNKNOWN")).alias("pmt_type"),
                F.coalesce(F.col("affiliation"), F.lit("UNKNOWN")).alias("pmt_brand"),
                F.coalesce(F.col("clear_bin"), F.lit("UNKNOWN")).alias("bin"))
            .agg(F.count_distinct("req_proc_ref_id").alias("refund_cnt")))


def approved_monthly(renewals: DataFrame, since: int) -> DataFrame:
    """Approved renewals per month and payment dimensions."""
    return (renewals.filter(F.col("event_utc_date") >= since)
            .withColumn("event_utc_month", int_date_month("event_utc_date"))
            .groupBy(*MONTH_KEYS).agg(F.sum("approved_cnt").cast("bigint").alias("approved_cnt")))


def refund_vs_approved(approved: DataFrame, refunds: DataFrame, issuers: Iterable[str] = FOCUS_ISSUERS) -> DataFrame:
    """Monthly approved counts with refund counts (0 when none) for the
    focus issuers (nine-key left join)."""
    r = refunds.withColumnRenamed("issuer_desc_grouped", "issuer_institution_desc_grp")
    j = _key_join(approved.filter(F.col("issuer_institution_desc_grp").isin(list(issuers))), r, MONTH_KEYS, False)
    return j.select(*MONTH_KEYS, "approved_cnt", F.coalesce(F.col("refund_cnt"), F.lit(0)).cast("bigint")
                    .alias("refund_cnt"))
