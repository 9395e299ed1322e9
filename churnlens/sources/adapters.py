"""Domain views over the driver tables.

The analyses read subscription, billing, viewing, geography and payment
tables.  The driver supplies a TPC-H style star schema plus an ``events``
stream instead, so each domain table is *derived* here by a fixed,
deterministic rule (the same rules are written independently as SQL in
``oracle/views.py``).  Every view is a lazy DataFrame: columns an analysis
does not use are pruned by Catalyst before the scan.

Mapping in short
- subscription / signup facts: one per order (``o_orderkey``), account =
  ``o_custkey``, partner = ``c_mktsegment``, signup date = ``o_orderdate``.
- billing periods: one per ``lineitem`` row (period = ``l_linenumber``).
- viewing, connections, stream blocks, payment events: ``events`` rows,
  property ``k`` from the ``props`` JSON.
- geography, institutions: ``nation`` / ``region`` (fixed 25 / 5 rows, the
  only inputs broadcast explicitly); devices and payment methods: ``part``.
- linked (streaming) account of a subscription: ``o_custkey div 10``, which
  is the id space of ``events.user_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.dates import int_date
from churnlens.functions.values import flag, normalise_institution
from churnlens.sources.tables import Tables

MS_PER_DAY = 86400000


# --- shared derivations ------------------------------------------------------

def _div(c: Column, n: int) -> Column:
    """Integer division of a non-negative integer column."""
    return F.floor(c / F.lit(n)).cast("bigint")


def _prop_k(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("int")


def _events(t: Tables) -> DataFrame:
    """Events with the ``k`` property parsed once.  Later projections refer
    to the ``k`` column; Catalyst does not inline a non-trivial expression
    into several references, so the JSON text is parsed once per row."""
    return t.events.withColumn("k", _prop_k())


def _nation_dim(t: Tables) -> DataFrame:
    """Nation with its region name: 25 rows by definition, safe to broadcast."""
    return F.broadcast(
        t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "n_regionkey", "r_name")
    )


def _subscription_type() -> Column:
    return (F.when(F.col("o_orderstatus") == "P", "P")
            .when(F.col("o_orderstatus") == "F", "PS").otherwise("S"))


def _linked_account() -> Column:
    return F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", _div(F.col("o_custkey"), 10))


def _fraud_flag() -> Column:
    return (F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("int"))
            .when(F.col("c_acctbal") < 0, 1).otherwise(0))


def _cancel_reason() -> Column:
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    return (F.when((rf == "R") & (ls == "F"), "INVOL_UNPAID")
            .when(rf == "R", "INVOL_NO_MOP")
            .when((rf == "A") & (ls == "F"), "VOL_CUSTOMER")
            .when(rf == "A", "VOL_PARTNER"))


def _dealt(t: Tables, rows: DataFrame, order_key: str) -> DataFrame:
    """Rows dealt out by order as the subscription facts are stored.  Both
    sides of a join are dealt before it, so the joined rows already lie in
    their buckets and the wide result is not shuffled again."""
    return rows.repartition(t.buckets, order_key) if t.buckets else rows


CANCEL_REASONS = ("INVOL_NO_MOP", "INVOL_UNPAID", "VOL_CUSTOMER", "VOL_PARTNER")


def _largest_reason() -> Column:
    """``max(_cancel_reason())``, as the largest place in the sorted list: a
    number is aggregated in a hash table, a string by sorting all lines."""
    place = F.max(F.coalesce(*[F.when(_cancel_reason() == r, i) for i, r in reversed(list(enumerate(CANCEL_REASONS, 1)))]))
    return F.coalesce(*[F.when(place == i, r) for i, r in enumerate(CANCEL_REASONS, 1)])


def _orders_customers(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))


def _lines_orders_customers(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    c = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # orders meet their customers first: they are fewer than the lines
    oc = _dealt(t, o.join(c, F.col("o_custkey") == F.col("c_custkey")), "o_orderkey")
    return _dealt(t, t.lineitem, "l_orderkey").join(oc, F.col("l_orderkey") == F.col("o_orderkey"))


# --- subscriptions and signups -------------------------------------------------

def subscription(t: Tables) -> DataFrame:
    """One row per subscription (order)."""
    plan = F.substring("o_orderpriority", 1, 1).cast("int")
    latest = t.lineitem.groupBy(F.col("l_orderkey").alias("latest_orderkey")).agg(
        F.max(int_date("l_shipdate")).alias("latest_service_stop_date"),
        F.max("l_linenumber").alias("latest_subscrn_period_nbr"))
    first = (t.orders.groupBy(F.col("o_custkey").alias("first_custkey"))
             .agg(F.min("o_orderdate").alias("first_orderdate")))
    signups = _orders_customers(t).join(first, F.col("o_custkey") == F.col("first_custkey"), "left")
    base = (_dealt(t, signups, "o_orderkey")
            .join(_dealt(t, latest, "latest_orderkey"), F.col("o_orderkey") == F.col("latest_orderkey"), "left"))
    return base.select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderkey").alias("subscrn_id"),
        int_date("o_orderdate").alias("signup_date"),
        F.col("o_orderdate").alias("signup_ts"),
        F.col("c_mktsegment").alias("billing_partner_desc"),
        F.col("c_mktsegment").alias("signup_billing_partner_desc"),
        F.col("o_orderpriority").alias("package_offer_provider_desc"),
        _subscription_type().alias("signup_subscription_type"),
        _linked_account().alias("current_connected_to_account_id"),
        flag(F.col("o_totalprice") < 50000).alias("is_channel_giftcard"),
        flag(F.col("o_orderstatus") == "O").alias("is_free_trial_at_signup"),
        flag(F.col("c_acctbal") > 9000).alias("is_tester"),
        flag(F.col("o_orderstatus") == "F").alias("is_voluntary_cancel"),
        _fraud_flag().alias("fraud_flag"),
        F.col("c_nationkey").cast("string").alias("country_iso_code"),
        plan.alias("signup_plan_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(plan).alias("latest_plan_id"),
        (F.col("c_nationkey") * 4).cast("int").alias("signup_device_type_id"),
        F.expr("o_orderdate + INTERVAL 8 HOURS").alias("signup_utc_ts"),
        flag(F.col("c_mktsegment") == "MACHINERY").alias("is_dcb_signup"),
        flag(plan == 3).alias("is_mds"),
        flag(F.col("o_orderdate") > F.col("first_orderdate")).alias("is_rejoin"),
        "latest_service_stop_date",
        "latest_subscrn_period_nbr",
    )


def signup_retention(t: Tables) -> DataFrame:
    """Signup summary: one row per subscription with period-1 counters.

    ``is_rejoin`` = the account signed up on an earlier day.  Counters come
    from the period-1 billing rows (NULL-free: 0 when there is none).  Both
    enrichments are per-key aggregates joined back; when a query does not
    read them Catalyst drops the join.
    """
    p1 = (t.lineitem.filter(F.col("l_linenumber") == 1)
          .groupBy(F.col("l_orderkey").alias("p1_orderkey"))
          .agg(F.max(flag(F.col("l_linestatus") == "F")).alias("p1_c"),
               F.max(flag(F.col("l_returnflag") == "R")).alias("p1_i"),
               F.max(flag(F.col("l_returnflag") == "A")).alias("p1_v")))
    first = (t.orders.groupBy(F.col("o_custkey").alias("first_custkey"))
             .agg(F.min("o_orderdate").alias("first_orderdate")))
    signups = (_orders_customers(t)
               .join(_nation_dim(t), F.col("c_nationkey") == F.col("n_nationkey"))
               .join(first, F.col("o_custkey") == F.col("first_custkey"), "left"))
    base = (_dealt(t, signups, "o_orderkey")
            .join(_dealt(t, p1, "p1_orderkey"), F.col("o_orderkey") == F.col("p1_orderkey"), "left"))
    sd = int_date("o_orderdate")
    return base.select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderkey").alias("subscrn_id"),
        sd.alias("signup_date"),
        sd.alias("signup_dateint"),
        F.col("c_mktsegment").alias("partner_name"),
        F.col("c_mktsegment").alias("signup_mop_partner_name"),
        F.col("o_orderpriority").alias("acquisition_channel"),
        F.col("n_name").alias("country_desc"),
        (F.when(F.col("o_orderstatus") == "P", "STB")
         .when(F.col("o_orderstatus") == "F", "TV").otherwise("MOBILE")).alias("signup_hw_category"),
        F.col("c_name").alias("signup_device_type_extended_name"),
        F.when(F.col("c_acctbal") < 0, "PARTNER").otherwise("OWN").alias("mop_type"),
        flag(F.col("o_orderdate") > F.col("first_orderdate")).alias("is_rejoin"),
        F.coalesce(F.col("p1_c"), F.lit(0)).alias("p1_possible_complete_cnt"),
        F.coalesce(F.col("p1_i"), F.lit(0)).alias("p1_invol_cancel_cnt"),
        F.coalesce(F.col("p1_v"), F.lit(0)).alias("p1_vol_cancel_cnt"),
    )


def subscription_signup(t: Tables) -> DataFrame:
    return _dealt(t, t.orders, "o_orderkey").select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderkey").alias("subscrn_id"),
        F.lit(1).alias("signup_cnt"),
    )


def signup_funnel(t: Tables) -> DataFrame:
    """Regional funnel events of (future) accounts: one per order."""
    return (_dealt(t, _orders_customers(t), "o_orderkey")
            .join(_nation_dim(t), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_custkey").alias("account_id"),
                F.col("o_orderkey").alias("subscrn_id"),
                F.col("n_regionkey").cast("string").alias("de_country_desc"),
                F.col("c_nationkey").cast("string").alias("de_region_desc"),
                F.when(F.col("o_orderstatus") == "O", "visit").otherwise("signup").alias("funnel_event_desc"),
                int_date("o_orderdate").alias("event_region_date"),
            ))


def partner_cohort(t: Tables) -> DataFrame:
    """Partner enrollment report keyed by (linked account, enrollment date)."""
    return (_orders_customers(t)
            .join(_nation_dim(t), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                _linked_account().alias("current_connected_to_account_id"),
                int_date("o_orderdate").alias("enrollment_date"),
                int_date(F.date_add(F.col("o_orderdate").cast("date"), 1)).alias("signup_date"),
                F.when(F.col("c_acctbal") >= 5000, F.col("n_name")).alias("geo_desc"),
                F.col("c_mktsegment").alias("nio_partner_name"),
                _subscription_type().alias("signup_subscription_type"),
            ))


def subscription_hold(t: Tables) -> DataFrame:
    return _dealt(t, t.orders.filter(F.col("o_orderstatus") == "P"), "o_orderkey").select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderkey").alias("subscrn_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 100 + 10).alias("hold_type_id"),
        int_date("o_orderdate").alias("event_date"),
    )


# --- billing -------------------------------------------------------------------

def billing_period(t: Tables) -> DataFrame:
    """One row per subscription billing period (``lineitem`` row)."""
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    revenue = (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).cast("decimal(18,4)")
    return _lines_orders_customers(t).select(
        F.col("o_custkey").alias("account_id"),
        F.col("l_orderkey").alias("subscrn_id"),
        F.col("l_linenumber").alias("billing_period_nbr"),
        int_date("l_shipdate").alias("billing_period_end_date"),
        flag(ls == "F").alias("possible_complete_cnt"),
        flag(rf == "A").alias("vol_cancel_cnt"),
        flag(rf == "R").alias("invol_cancel_cnt"),
        flag(rf != "N").alias("invol_vol_cancel_cnt"),
        flag(F.col("l_tax") == 0).alias("onhold_cnt"),
        flag((F.col("l_tax") == 0) & (rf == "N")).alias("recovered_cnt"),
        F.when(rf == "R", F.lit(None).cast("decimal(18,4)")).otherwise(revenue).alias("adjusted_revenue_amt_usd"),
        flag(F.col("c_acctbal") > 9000).alias("is_tester_account"),
        _fraud_flag().alias("fraud_flag"),
        (F.when(F.col("l_discount") >= 0.05, "Credit")
         .when(F.col("l_discount") > 0, "Debit")).alias("first_try_pmt_type_desc"),
        F.when(F.col("l_tax") >= 0.04, "Credit").otherwise("Debit").alias("final_try_pmt_type_desc"),
        F.when(ls == "F", "CC").otherwise("DD").alias("final_try_pmt_method_desc"),
        _cancel_reason().alias("cancellation_reason_desc"),
        F.col("c_mktsegment").alias("billing_partner_desc"),
        F.col("c_nationkey").cast("string").alias("country_iso_code"),
    )


def billing_subscription(t: Tables) -> DataFrame:
    """One row per subscription: status, reason, last period, start / end.

    The billing rows are reduced per order before the join, so the join
    sees one row per order on each side.
    """
    per_order = t.lineitem.groupBy(F.col("l_orderkey")).agg(
        _largest_reason().alias("cancellation_reason_desc"),
        F.max("l_linenumber").alias("latest_billing_period_nbr"),
        F.max(int_date("l_shipdate")).alias("billing_end_date"),
    )
    per_order = _dealt(t, per_order, "l_orderkey")
    return _dealt(t, t.orders, "o_orderkey").join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderkey").alias("subscrn_id"),
        "cancellation_reason_desc",
        F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("subscrn_status"),
        "latest_billing_period_nbr",
        int_date("o_orderdate").alias("billing_start_date"),
        "billing_end_date",
    )


def device_activity(t: Tables) -> DataFrame:
    """Viewing seconds per subscription, device and billing period."""
    secs = F.when(F.col("l_discount") == 0, F.lit(0).cast("bigint")).otherwise(
        (F.col("l_quantity") * 60).cast("bigint"))
    return (_lines_orders_customers(t)
            .join(_nation_dim(t), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_custkey").alias("account_id"),
                F.col("l_orderkey").alias("subscrn_id"),
                _fraud_flag().alias("fraud_flag"),
                secs.alias("device_billing_period_view_secs"),
                F.col("n_name").alias("country_desc"),
                F.col("c_mktsegment").alias("signup_mop_partner_name"),
                F.col("o_orderpriority").alias("signup_acquisition_channel"),
                F.col("l_linenumber").alias("billing_period_nbr"),
                int_date("l_shipdate").alias("billing_period_end_date"),
            ))


# --- viewing and devices ----------------------------------------------------------

def title_views(t: Tables) -> DataFrame:
    """Viewing rows (``view`` events)."""
    k = F.col("k")
    return _events(t).filter(F.col("event_type") == "view").select(
        _div(k, 4).cast("string").alias("country_iso_code"),
        int_date("ts").alias("region_date"),
        F.col("user_id").alias("account_id"),
        _div(F.hour("ts"), 6).alias("profile_id"),
        k.alias("play_device_type_id"),
        F.concat(F.lit("model-"), _div(k, 10).cast("string")).alias("play_device_model"),
        F.when(F.minute("ts") < 20, "Darwin-2.1").otherwise("android-9.0").alias("play_ui_version"),
        _div(F.second("ts"), 15).alias("show_title_id"),
        flag(F.col("value") < 1).alias("is_test_play"),
        F.round(F.col("value") * 60).cast("bigint").alias("standard_sanitized_duration_sec"),
        F.lit(1).cast("bigint").alias("session_cnt"),
    )


def device_type(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("device_type_id"),
        F.col("p_name").alias("device_type_name"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_size") >= 40, F.col("p_brand")).alias("mso_partner"),
        F.col("p_type").alias("hw_category"),
    )


def connection_event(t: Tables) -> DataFrame:
    """Device connection events with IP geography."""
    k = F.col("k")
    return _events(t).select(
        F.col("user_id").alias("input_account_id"),
        int_date("ts").alias("utc_date"),
        F.when(F.col("event_type") != "error", F.col("event_id").cast("string")).alias("execution_id"),
        F.col("event_type").alias("device_category"),
        F.when(F.col("value") >= 5, "signup").otherwise("browse").alias("input_flow"),
        F.when(k < 50, "US").otherwise("CA").alias("geo_country"),
        F.concat(F.lit("R"), _div(k, 10).cast("string")).alias("geo_region"),
        F.concat(F.lit("City "), _div(k, 2).cast("string")).alias("geo_city"),
        F.lpad(k.cast("string"), 5, "0").alias("geo_zip"),
        F.when(k % 10 == 9, F.lit("null")).otherwise(_div(k, 4).cast("string")).alias("geo_dma"),
    )


def stream_block(t: Tables) -> DataFrame:
    """Concurrent-stream blocks (``error`` events)."""
    return _events(t).filter(F.col("event_type") == "error").select(
        F.col("user_id").alias("customer_id"),
        _div(F.col("k"), 4).cast("string").alias("country_iso_code"),
        int_date("ts").alias("event_utc_date"),
    )


def partner_signup_service(t: Tables) -> DataFrame:
    return _events(t).select(
        F.col("user_id").alias("account_id"),
        F.concat(F.lit("PAI-"), _div(F.col("k"), 10).cast("string")).alias("billing_partner_handle"),
        int_date("ts").alias("processing_utc_date"),
    )


# --- geography ---------------------------------------------------------------------

def geo_market(t: Tables) -> DataFrame:
    return _nation_dim(t).select(
        F.col("n_nationkey").cast("string").alias("dma_id"),
        F.col("n_name").alias("dma_desc"),
        (F.col("n_nationkey").cast("double") * 1.5).alias("longitude"),
        (F.col("n_regionkey").cast("double") * 10.0).alias("latitude"),
    )


def geo_postal(t: Tables) -> DataFrame:
    return _nation_dim(t).select(
        F.lpad((F.col("n_nationkey") * 4).cast("string"), 5, "0").alias("zip_postal_desc"),
        F.col("r_name").alias("state_desc"),
        F.col("n_name").alias("county_desc"),
        F.when(F.col("n_nationkey") < 10, F.concat(F.lit("Metro "), F.col("n_nationkey").cast("string")))
        .alias("cbsa_desc"),
    )


def geo_subdivision(t: Tables) -> DataFrame:
    return _nation_dim(t).select(
        F.col("n_regionkey").cast("string").alias("country_iso_code"),
        F.col("n_nationkey").cast("string").alias("subdivision_iso_code"),
        F.col("n_name").alias("subdivision_desc"),
    )


def geo_country(t: Tables) -> DataFrame:
    return _nation_dim(t).select(
        F.col("n_nationkey").cast("string").alias("country_iso_code"),
        F.col("n_name").alias("country_desc"),
        F.col("r_name").alias("estaff_subregion_desc"),
    )


def account_geo(t: Tables) -> DataFrame:
    return (t.customer.join(_nation_dim(t), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("account_id"),
                F.col("n_regionkey").cast("string").alias("prim_country_iso_code"),
                F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string"))
                .alias("prim_subdivision_iso_code"),
            ))


# --- payments ------------------------------------------------------------------------

def _institution_desc() -> Column:
    return (F.when(F.col("n_nationkey") % 4 == 0,
                   F.concat(F.lit(' Bank "'), F.col("n_name"), F.lit('" ')))
            .otherwise(F.concat(F.lit("Bank "), F.col("n_name"))))


def institution(t: Tables) -> DataFrame:
    return _nation_dim(t).select(
        F.col("n_nationkey").cast("bigint").alias("pmt_institution_sk"),
        _institution_desc().alias("pmt_institution_desc"),
    )


def institution_group(t: Tables) -> DataFrame:
    return _nation_dim(t).filter(F.col("n_regionkey").isin(0, 1)).select(
        _institution_desc().alias("pmt_institution_desc"),
        F.when(F.col("n_regionkey") == 0, "BANK OF AMERICA").otherwise("WELLS FARGO")
        .alias("grouped_pmt_institution_desc"),
    )


def payment_method(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("pmt_mop_metadata_sk"),
        (F.col("p_size") % 25).cast("bigint").alias("pmt_institution_sk"),
        F.col("p_brand").alias("affiliation"),
        F.col("p_type").alias("pmt_type_desc"),
        F.concat(F.lit("BIN"), F.col("p_size").cast("string")).alias("clear_bin"),
        F.when(F.col("p_type") != "PROMO", F.lit("Card")).alias("dse_pmt_method"),
    )


def payment_event(t: Tables) -> DataFrame:
    """Payment and chargeback events with four property maps.

    Keys whose value would be NULL are left out of the map, so a lookup of
    them gives NULL the way a missing key does.  A charge on rejoining
    (``VALIDATE``) is of period 1 and uses no token; an account pays with
    the payment method of its number.
    """
    k = F.col("k")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    degenerate = F.map_filter(F.create_map(
        F.lit("mop_postal_code"),
        F.when(k % 10 == 0, F.lit("--")).when(k % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lpad(k.cast("string"), 5, "0"),
                            F.when(k % 3 == 0, F.lit("-4321")).otherwise(F.lit("")))),
        F.lit("bin_metadata_type"), F.when(k % 2 == 0, "DEBIT").otherwise("CREDIT"),
        F.lit("original_txn_pmt_processor"),
        F.when(k % 7 == 0, F.lit("--")).otherwise(F.concat(F.lit("PROC_"), (k % 3).cast("string"))),
        F.lit("original_txn_type"), F.when(k % 4 == 0, "VALIDATE").otherwise("SALE"),
        F.lit("billing_period"),
        F.when(k % 11 == 0, F.lit("null")).when(k % 4 == 0, F.lit("1")).otherwise((k % 3 + 1).cast("string")),
        F.lit("retry_mode"), F.when(k % 5 == 0, "RETRY").otherwise("FIRST"),
        F.lit("original_txn_date"), (ms - k.cast("bigint") * MS_PER_DAY).cast("string"),
        F.lit("token_used"), F.when((k % 4 != 0) & (F.col("event_id") % 2 == 0), "true").otherwise("false"),
        F.lit("is_chained_txn"),
        F.when(k % 4 == 3, F.lit(None).cast("string")).when(k % 4 == 1, F.lit("true")).otherwise(F.lit("false")),
        F.lit("is_duplicate"), F.when(k % 13 == 0, F.lit("true")),
        F.lit("txn_type"), F.when(k % 3 == 0, "REFUND").otherwise("CHARGE"),
        F.lit("txn_status"), F.when(F.col("value") >= 5, "APPROVED").otherwise("DECLINED"),
        F.lit("mop_type"), F.when(k % 2 == 0, "CC").otherwise("DD"),
    ), lambda key, value: value.isNotNull())
    natural = F.create_map(
        F.lit("original_txn_id"), F.col("event_id").cast("string"),
        F.lit("req_proc_ref_id"), F.concat(F.lit("Q"), _div(F.col("event_id"), 2).cast("string")),
    )
    dims = F.create_map(F.lit("pmt_mop_metadata_sk"), F.col("user_id").cast("bigint"))
    facts = F.create_map(F.lit("chargeback_amount"), F.col("value") * 100.0,
                         F.lit("record_count"), F.lit(1.0))
    return _events(t).select(
        F.col("user_id").alias("account_id"),
        int_date("ts").alias("event_utc_date"),
        ms.alias("event_utc_ms_ts"),
        _div(k, 4).cast("string").alias("country_code"),
        (F.when(kind == "error", "chargeback_transaction")
         .when(kind == "purchase", "payment_transaction").otherwise("other")).alias("pmt_event_type"),
        degenerate.alias("degenerate_values_map"),
        natural.alias("natural_key_map"),
        dims.alias("dimension_sk_map"),
        facts.alias("facts_map"),
    )


def payment_txn_event(t: Tables) -> DataFrame:
    """Payment transactions (``purchase`` events) with a property map."""
    k = F.col("k")
    props = F.create_map(
        F.lit("customerId"), F.when(k % 10 == 0, F.lit("null")).otherwise(F.col("user_id").cast("string")),
        F.lit("isoCountryCode"), _div(k, 4).cast("string"),
        F.lit("referenceId"), F.concat(F.lit("R"), F.col("event_id").cast("string")),
    )
    return _events(t).filter(F.col("event_type") == "purchase").select(
        int_date("ts").alias("dateint"), props.alias("other_properties"))


def chargeback_summary(t: Tables) -> DataFrame:
    return _events(t).filter(F.col("event_type") == "error").select(
        F.col("user_id").alias("account_id"), int_date("ts").alias("cb_event_utc_date"))


def fraud_file(t: Tables) -> DataFrame:
    """Rows of the issuer fraud report: large purchases, referenced by id."""
    k = F.col("k")
    return _events(t).filter((F.col("event_type") == "purchase") & (F.col("value") >= 8)).select(
        F.concat(F.lit("R"), F.col("event_id").cast("string")).alias("referenceID"),
        int_date("ts").alias("experiation_date"),
        F.col("value").alias("sale_amt"),
        F.when(k % 10 == 8, F.lit("randomenotestokeep")).otherwise((k % 10).cast("string")).alias("fraud_reason"),
    )


def _approved_date() -> Column:
    """Ship dates folded onto October 2023 to January 2024, so that their
    months are those of the events; days after the 28th count as the 28th."""
    quarter = F.month("l_shipdate") % 4
    month = F.when(quarter == 3, F.lit(202401)).otherwise(F.lit(202310) + quarter)
    return (month * 100 + F.least(F.dayofmonth("l_shipdate"), F.lit(28))).cast("int")


def _approved_lines(t: Tables, linestatus: str) -> DataFrame:
    """Approved charges: billing rows joined to payment-method (part),
    issuing country (supplier nation) and issuer (nation by ``p_size``)."""
    nat = _nation_dim(t)
    issuer = nat.select(F.col("n_nationkey").alias("i_key"), _institution_desc().alias("i_desc"))
    group = institution_group(t).select(F.col("pmt_institution_desc").alias("g_desc"),
                                        F.col("grouped_pmt_institution_desc").alias("g_name"))
    part = t.part.select("p_partkey", "p_brand", "p_type", "p_size")
    supp = t.supplier.select("s_suppkey", "s_nationkey")
    return (t.lineitem.filter(F.col("l_linestatus") == linestatus)
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(issuer, (F.col("p_size") % 25) == F.col("i_key"))
            .join(group, F.col("i_desc") == F.col("g_desc"), "left")
            .select(
                _approved_date().alias("event_utc_date"),
                F.concat(F.lit("PROC_"), (F.col("l_linenumber") % 3).cast("string")).alias("processor"),
                F.when(F.col("l_returnflag") == "R", "RETRY").otherwise("FIRST").alias("retry_mode"),
                F.when(F.col("l_tax") >= 0.04, "true").otherwise("false").alias("token_used"),
                F.col("r_name").alias("estaff_subregion_desc"),
                F.col("n_name").alias("country_desc"),
                F.col("n_nationkey").cast("string").alias("country_iso_code"),
                normalise_institution("g_name", "i_desc").alias("issuer_institution_desc_grp"),
                F.when(F.col("p_type") == "PROMO", "UNKNOWN").otherwise("Card").alias("pmt_method"),
                F.col("p_brand").alias("pmt_brand"),
                F.col("p_type").alias("pmt_type"),
                F.concat(F.lit("BIN"), F.col("p_size").cast("string")).alias("bin"),
                F.col("l_linenumber").alias("billing_period_nbr"),
                F.col("l_quantity").cast("bigint").alias("approved_cnt"),
            ))


def renewal_agg(t: Tables) -> DataFrame:
    """Approved renewals (billing rows with line status ``F``)."""
    return _approved_lines(t, "F")


def validation_agg(t: Tables) -> DataFrame:
    """Approved rejoin charges (billing rows with line status ``O``)."""
    return _approved_lines(t, "O").select(
        "event_utc_date", "processor", "estaff_subregion_desc", "country_desc",
        "issuer_institution_desc_grp", "pmt_brand", "pmt_type", "bin",
        F.col("approved_cnt").alias("charge_approved_cnt"))


def event_signups(t: Tables) -> DataFrame:
    """Signups recorded as ``signup`` events (one per event), for analyses
    that match signups to payment events by day: the order dates never
    overlap the event window.  The subscription is the account's first order,
    or the event where the account has none."""
    k = F.col("k")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    first = t.orders.groupBy(F.col("o_custkey").alias("first_custkey")).agg(F.min("o_orderkey").alias("first_orderkey"))
    return (_events(t).filter(F.col("event_type") == "signup")
            .join(c, F.col("user_id") == F.col("c_custkey"))
            .join(first, F.col("user_id") == F.col("first_custkey"), "left")
            .join(_nation_dim(t), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("user_id").alias("account_id"),
                F.coalesce(F.col("first_orderkey"), F.col("event_id")).alias("subscrn_id"),
                int_date("ts").alias("signup_date"),
                F.col("c_mktsegment").alias("partner_name"),
                F.col("n_name").alias("country_desc"),
                F.when(F.col("value") >= 5, "STB").otherwise("TV").alias("signup_hw_category"),
                flag(k % 2 == 0).alias("p1_possible_complete_cnt"),
                flag(k % 5 == 0).alias("p1_invol_cancel_cnt"),
                flag(k % 7 == 0).alias("p1_vol_cancel_cnt"),
            ))
