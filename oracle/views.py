"""Domain views in DuckDB SQL (independent re-statement of the rules in
``churnlens/sources/adapters.py``), composed into WITH clauses."""

from __future__ import annotations


def idate(x: str) -> str:
    return f"CAST(year({x}) * 10000 + month({x}) * 100 + day({x}) AS INTEGER)"


K = "CAST(json_extract(props, '$.k') AS INTEGER)"

REASON = ("CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'INVOL_UNPAID' "
          "WHEN l_returnflag = 'R' THEN 'INVOL_NO_MOP' "
          "WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'VOL_CUSTOMER' "
          "WHEN l_returnflag = 'A' THEN 'VOL_PARTNER' END")

FRAUD = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN c_acctbal < 0 THEN 1 ELSE 0 END"
SUBTYPE = "CASE o_orderstatus WHEN 'P' THEN 'P' WHEN 'F' THEN 'PS' ELSE 'S' END"
LINK = "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_custkey // 10 END"
INST_DESC = ("CASE WHEN n_nationkey % 4 = 0 THEN ' Bank \"' || n_name || '\" ' "
             "ELSE 'Bank ' || n_name END")
ISSUER = "upper(coalesce(grouped_pmt_institution_desc, trim(regexp_replace(pmt_institution_desc, '\"', '\"\"', 'g'))))"

VIEWS: dict[str, tuple[str, list[str]]] = {}


def view(name: str, sql: str, deps: list[str] | None = None) -> None:
    VIEWS[name] = (sql, deps or [])


view("nation_dim", """
SELECT n_nationkey, n_name, n_regionkey, r_name
FROM nation JOIN region ON n_regionkey = r_regionkey""")

view("oc", """
SELECT * FROM orders JOIN customer ON o_custkey = c_custkey""")

view("loc", """
SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")

view("v_subscription", f"""
SELECT o_custkey AS account_id, o_orderkey AS subscrn_id, {idate('o_orderdate')} AS signup_date,
       o_orderdate AS signup_ts, c_mktsegment AS billing_partner_desc,
       c_mktsegment AS signup_billing_partner_desc, o_orderpriority AS package_offer_provider_desc,
       {SUBTYPE} AS signup_subscription_type, {LINK} AS current_connected_to_account_id,
       CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END AS is_channel_giftcard,
       CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_free_trial_at_signup,
       CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS is_tester,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_voluntary_cancel,
       {FRAUD} AS fraud_flag, CAST(c_nationkey AS VARCHAR) AS country_iso_code,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS signup_plan_id,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS latest_plan_id,
       CAST(c_nationkey * 4 AS INTEGER) AS signup_device_type_id,
       o_orderdate + INTERVAL 8 HOUR AS signup_utc_ts,
       CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS is_dcb_signup,
       CAST(o_orderpriority LIKE '3%' AS INTEGER) AS is_mds,
       CAST(o_orderdate > min(o_orderdate) OVER (PARTITION BY o_custkey) AS INTEGER) AS is_rejoin,
       (SELECT max({idate('l_shipdate')}) FROM lineitem WHERE l_orderkey = o_orderkey) AS latest_service_stop_date,
       (SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS latest_subscrn_period_nbr
FROM oc""", ["oc"])

view("sr_p1", """
SELECT l_orderkey AS p1_orderkey,
       max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS p1_c,
       max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS p1_i,
       max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS p1_v
FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey""")

view("sr_first", """
SELECT o_custkey AS first_custkey, min(o_orderdate) AS first_orderdate FROM orders GROUP BY o_custkey""")

view("v_signup_retention", f"""
SELECT o_custkey AS account_id, o_orderkey AS subscrn_id,
       {idate('o_orderdate')} AS signup_date, {idate('o_orderdate')} AS signup_dateint,
       c_mktsegment AS partner_name, c_mktsegment AS signup_mop_partner_name,
       o_orderpriority AS acquisition_channel, n_name AS country_desc,
       CASE o_orderstatus WHEN 'P' THEN 'STB' WHEN 'F' THEN 'TV' ELSE 'MOBILE' END AS signup_hw_category,
       c_name AS signup_device_type_extended_name,
       CASE WHEN c_acctbal < 0 THEN 'PARTNER' ELSE 'OWN' END AS mop_type,
       CASE WHEN o_orderdate > first_orderdate THEN 1 ELSE 0 END AS is_rejoin,
       coalesce(p1_c, 0) AS p1_possible_complete_cnt, coalesce(p1_i, 0) AS p1_invol_cancel_cnt,
       coalesce(p1_v, 0) AS p1_vol_cancel_cnt
FROM oc JOIN nation_dim ON c_nationkey = n_nationkey
LEFT JOIN sr_p1 ON o_orderkey = p1_orderkey
LEFT JOIN sr_first ON o_custkey = first_custkey""", ["oc", "nation_dim", "sr_p1", "sr_first"])

view("v_subscription_signup", """
SELECT o_custkey AS account_id, o_orderkey AS subscrn_id, 1 AS signup_cnt FROM orders""")

view("v_signup_funnel", f"""
SELECT o_custkey AS account_id, o_orderkey AS subscrn_id, CAST(n_regionkey AS VARCHAR) AS de_country_desc,
       CAST(c_nationkey AS VARCHAR) AS de_region_desc,
       CASE WHEN o_orderstatus = 'O' THEN 'visit' ELSE 'signup' END AS funnel_event_desc,
       {idate('o_orderdate')} AS event_region_date
FROM oc JOIN nation_dim ON c_nationkey = n_nationkey""", ["oc", "nation_dim"])

view("v_partner_cohort", f"""
SELECT {LINK} AS current_connected_to_account_id, {idate('o_orderdate')} AS enrollment_date,
       {idate("(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY)")} AS signup_date,
       CASE WHEN c_acctbal >= 5000 THEN n_name END AS geo_desc, c_mktsegment AS nio_partner_name,
       {SUBTYPE} AS signup_subscription_type
FROM oc JOIN nation_dim ON c_nationkey = n_nationkey""", ["oc", "nation_dim"])

view("v_subscription_hold", f"""
SELECT o_custkey AS account_id, o_orderkey AS subscrn_id,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 100 + 10 AS hold_type_id,
       {idate('o_orderdate')} AS event_date
FROM orders WHERE o_orderstatus = 'P'""")

view("v_billing_period", f"""
SELECT o_custkey AS account_id, l_orderkey AS subscrn_id, l_linenumber AS billing_period_nbr,
       {idate('l_shipdate')} AS billing_period_end_date,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS possible_complete_cnt,
       CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS vol_cancel_cnt,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS invol_cancel_cnt,
       CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS invol_vol_cancel_cnt,
       CASE WHEN l_tax = 0 THEN 1 ELSE 0 END AS onhold_cnt,
       CASE WHEN l_tax = 0 AND l_returnflag = 'N' THEN 1 ELSE 0 END AS recovered_cnt,
       CASE WHEN l_returnflag = 'R' THEN NULL
            ELSE CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4)) END AS adjusted_revenue_amt_usd,
       CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS is_tester_account,
       {FRAUD} AS fraud_flag,
       CASE WHEN l_discount >= 0.05 THEN 'Credit' WHEN l_discount > 0 THEN 'Debit' END AS first_try_pmt_type_desc,
       CASE WHEN l_tax >= 0.04 THEN 'Credit' ELSE 'Debit' END AS final_try_pmt_type_desc,
       CASE WHEN l_linestatus = 'F' THEN 'CC' ELSE 'DD' END AS final_try_pmt_method_desc,
       {REASON} AS cancellation_reason_desc, c_mktsegment AS billing_partner_desc,
       CAST(c_nationkey AS VARCHAR) AS country_iso_code
FROM loc""", ["loc"])

view("v_billing_subscription", f"""
SELECT o_custkey AS account_id, o_orderkey AS subscrn_id, b.cancellation_reason_desc,
       CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS subscrn_status,
       b.latest_billing_period_nbr, {idate('o_orderdate')} AS billing_start_date, b.billing_end_date
FROM orders JOIN (
    SELECT l_orderkey, max({REASON}) AS cancellation_reason_desc, max(l_linenumber) AS latest_billing_period_nbr,
           max({idate('l_shipdate')}) AS billing_end_date
    FROM lineitem GROUP BY l_orderkey) b ON o_orderkey = b.l_orderkey""")

view("v_device_activity", f"""
SELECT o_custkey AS account_id, l_orderkey AS subscrn_id, {FRAUD} AS fraud_flag,
       CASE WHEN l_discount = 0 THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity * 60 AS BIGINT) END
           AS device_billing_period_view_secs,
       n_name AS country_desc, c_mktsegment AS signup_mop_partner_name,
       o_orderpriority AS signup_acquisition_channel, l_linenumber AS billing_period_nbr,
       {idate('l_shipdate')} AS billing_period_end_date
FROM loc JOIN nation_dim ON c_nationkey = n_nationkey""", ["loc", "nation_dim"])

view("v_title_views", f"""
SELECT CAST({K} // 4 AS VARCHAR) AS country_iso_code, {idate('ts')} AS region_date, user_id AS account_id,
       CAST(hour(ts) // 6 AS BIGINT) AS profile_id, {K} AS play_device_type_id,
       'model-' || CAST({K} // 10 AS VARCHAR) AS play_device_model,
       CASE WHEN minute(ts) < 20 THEN 'Darwin-2.1' ELSE 'android-9.0' END AS play_ui_version,
       CAST(second(ts) // 15 AS BIGINT) AS show_title_id,
       CASE WHEN value < 1 THEN 1 ELSE 0 END AS is_test_play,
       CAST(round(value * 60) AS BIGINT) AS standard_sanitized_duration_sec,
       CAST(1 AS BIGINT) AS session_cnt
FROM events WHERE event_type = 'view'""")

view("v_device_type", """
SELECT p_partkey AS device_type_id, p_name AS device_type_name, p_brand AS brand,
       CASE WHEN p_size >= 40 THEN p_brand END AS mso_partner, p_type AS hw_category
FROM part""")

view("v_connection_event", f"""
SELECT user_id AS input_account_id, {idate('ts')} AS utc_date,
       CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS execution_id,
       event_type AS device_category,
       CASE WHEN value >= 5 THEN 'signup' ELSE 'browse' END AS input_flow,
       CASE WHEN {K} < 50 THEN 'US' ELSE 'CA' END AS geo_country,
       'R' || CAST({K} // 10 AS VARCHAR) AS geo_region,
       'City ' || CAST({K} // 2 AS VARCHAR) AS geo_city,
       lpad(CAST({K} AS VARCHAR), 5, '0') AS geo_zip,
       CASE WHEN {K} % 10 = 9 THEN 'null' ELSE CAST({K} // 4 AS VARCHAR) END AS geo_dma
FROM events""")

view("v_stream_block", f"""
SELECT user_id AS customer_id, CAST({K} // 4 AS VARCHAR) AS country_iso_code, {idate('ts')} AS event_utc_date
FROM events WHERE event_type = 'error'""")

view("v_partner_signup_service", f"""
SELECT user_id AS account_id, 'PAI-' || CAST({K} // 10 AS VARCHAR) AS billing_partner_handle,
       {idate('ts')} AS processing_utc_date
FROM events""")

view("v_geo_market", """
SELECT CAST(n_nationkey AS VARCHAR) AS dma_id, n_name AS dma_desc,
       CAST(n_nationkey AS DOUBLE) * 1.5 AS longitude, CAST(n_regionkey AS DOUBLE) * 10.0 AS latitude
FROM nation_dim""", ["nation_dim"])

view("v_geo_postal", """
SELECT lpad(CAST(n_nationkey * 4 AS VARCHAR), 5, '0') AS zip_postal_desc, r_name AS state_desc,
       n_name AS county_desc, CASE WHEN n_nationkey < 10 THEN 'Metro ' || CAST(n_nationkey AS VARCHAR) END AS cbsa_desc
FROM nation_dim""", ["nation_dim"])

view("v_geo_subdivision", """
SELECT CAST(n_regionkey AS VARCHAR) AS country_iso_code, CAST(n_nationkey AS VARCHAR) AS subdivision_iso_code,
       n_name AS subdivision_desc
FROM nation_dim""", ["nation_dim"])

view("v_geo_country", """
SELECT CAST(n_nationkey AS VARCHAR) AS country_iso_code, n_name AS country_desc, r_name AS estaff_subregion_desc
FROM nation_dim""", ["nation_dim"])

view("v_account_geo", """
SELECT c_custkey AS account_id, CAST(n_regionkey AS VARCHAR) AS prim_country_iso_code,
       CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey AS VARCHAR) END AS prim_subdivision_iso_code
FROM customer JOIN nation_dim ON c_nationkey = n_nationkey""", ["nation_dim"])

view("v_institution", f"""
SELECT CAST(n_nationkey AS BIGINT) AS pmt_institution_sk, {INST_DESC} AS pmt_institution_desc
FROM nation_dim""", ["nation_dim"])

view("v_institution_group", f"""
SELECT {INST_DESC} AS pmt_institution_desc,
       CASE WHEN n_regionkey = 0 THEN 'BANK OF AMERICA' ELSE 'WELLS FARGO' END AS grouped_pmt_institution_desc
FROM nation_dim WHERE n_regionkey IN (0, 1)""", ["nation_dim"])

view("v_payment_method", """
SELECT p_partkey AS pmt_mop_metadata_sk, CAST(p_size % 25 AS BIGINT) AS pmt_institution_sk,
       p_brand AS affiliation, p_type AS pmt_type_desc, 'BIN' || CAST(p_size AS VARCHAR) AS clear_bin,
       CASE WHEN p_type <> 'PROMO' THEN 'Card' END AS dse_pmt_method
FROM part""")

# Payment events: the map columns are spelled out as plain columns here
# (an oracle only has to compute the same values).
view("v_payment_event", f"""
SELECT user_id AS account_id, {idate('ts')} AS event_utc_date, epoch_us(ts) // 1000 AS event_utc_ms_ts,
       event_id, CAST({K} // 4 AS VARCHAR) AS country_code,
       CASE event_type WHEN 'error' THEN 'chargeback_transaction' WHEN 'purchase' THEN 'payment_transaction'
            ELSE 'other' END AS pmt_event_type,
       CASE WHEN {K} % 10 = 0 THEN '--' WHEN {K} % 10 = 1 THEN NULL
            ELSE lpad(CAST({K} AS VARCHAR), 5, '0') || CASE WHEN {K} % 3 = 0 THEN '-4321' ELSE '' END
       END AS mop_postal_code,
       CASE WHEN {K} % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS bin_metadata_type,
       CASE WHEN {K} % 7 = 0 THEN '--' ELSE 'PROC_' || CAST({K} % 3 AS VARCHAR) END AS original_txn_pmt_processor,
       CASE WHEN {K} % 4 = 0 THEN 'VALIDATE' ELSE 'SALE' END AS original_txn_type,
       CASE WHEN {K} % 11 = 0 THEN 'null' WHEN {K} % 4 = 0 THEN '1'
            ELSE CAST({K} % 3 + 1 AS VARCHAR) END AS billing_period,
       CASE WHEN {K} % 5 = 0 THEN 'RETRY' ELSE 'FIRST' END AS retry_mode,
       CAST(epoch_us(ts) // 1000 - CAST({K} AS BIGINT) * 86400000 AS VARCHAR) AS original_txn_date,
       CASE WHEN {K} % 4 = 0 OR event_id % 2 = 1 THEN 'false' ELSE 'true' END AS token_used,
       CASE WHEN {K} % 4 = 3 THEN NULL WHEN {K} % 4 = 1 THEN 'true' ELSE 'false' END AS is_chained_txn,
       CASE WHEN {K} % 13 = 0 THEN 'true' END AS is_duplicate,
       CASE WHEN {K} % 3 = 0 THEN 'REFUND' ELSE 'CHARGE' END AS txn_type,
       CASE WHEN value >= 5 THEN 'APPROVED' ELSE 'DECLINED' END AS txn_status,
       CASE WHEN {K} % 2 = 0 THEN 'CC' ELSE 'DD' END AS mop_type,
       CAST(event_id AS VARCHAR) AS original_txn_id,
       'Q' || CAST(event_id // 2 AS VARCHAR) AS req_proc_ref_id,
       CAST(user_id AS BIGINT) AS pmt_mop_metadata_sk,
       value * 100.0 AS chargeback_amount, CAST(1.0 AS DOUBLE) AS record_count
FROM events""")

view("v_payment_txn_event", f"""
SELECT {idate('ts')} AS dateint,
       CASE WHEN {K} % 10 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR) END AS customerId,
       CAST({K} // 4 AS VARCHAR) AS isoCountryCode, 'R' || CAST(event_id AS VARCHAR) AS referenceId
FROM events WHERE event_type = 'purchase'""")

view("v_chargeback_summary", f"""
SELECT user_id AS account_id, {idate('ts')} AS cb_event_utc_date FROM events WHERE event_type = 'error'""")

view("v_fraud_file", f"""
SELECT 'R' || CAST(event_id AS VARCHAR) AS referenceID, {idate('ts')} AS experiation_date, value AS sale_amt,
       CASE WHEN {K} % 10 = 8 THEN 'randomenotestokeep' ELSE CAST({K} % 10 AS VARCHAR) END AS fraud_reason
FROM events WHERE event_type = 'purchase' AND value >= 8""")

APPROVED_LINES = f"""
SELECT CAST([202310, 202311, 202312, 202401][month(l_shipdate) % 4 + 1] * 100
            + least(day(l_shipdate), 28) AS INTEGER) AS event_utc_date,
       'PROC_' || CAST(l_linenumber % 3 AS VARCHAR) AS processor,
       CASE WHEN l_returnflag = 'R' THEN 'RETRY' ELSE 'FIRST' END AS retry_mode,
       CASE WHEN l_tax >= 0.04 THEN 'true' ELSE 'false' END AS token_used,
       sn.r_name AS estaff_subregion_desc, sn.n_name AS country_desc,
       CAST(sn.n_nationkey AS VARCHAR) AS country_iso_code,
       upper(coalesce(g.grouped_pmt_institution_desc,
                      trim(regexp_replace(i.pmt_institution_desc, '"', '""', 'g')))) AS issuer_institution_desc_grp,
       CASE WHEN p_type = 'PROMO' THEN 'UNKNOWN' ELSE 'Card' END AS pmt_method,
       p_brand AS pmt_brand, p_type AS pmt_type, 'BIN' || CAST(p_size AS VARCHAR) AS bin,
       l_linenumber AS billing_period_nbr, CAST(l_quantity AS BIGINT) AS approved_cnt
FROM lineitem
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation_dim sn ON s_nationkey = sn.n_nationkey
JOIN v_institution i ON CAST(p_size % 25 AS BIGINT) = i.pmt_institution_sk
LEFT JOIN v_institution_group g ON i.pmt_institution_desc = g.pmt_institution_desc
WHERE l_linestatus = '{{status}}'"""

view("v_renewal_agg", APPROVED_LINES.replace("{status}", "F"), ["nation_dim", "v_institution", "v_institution_group"])
view("v_validation_agg", f"""
SELECT event_utc_date, processor, estaff_subregion_desc, country_desc, issuer_institution_desc_grp,
       pmt_brand, pmt_type, bin, approved_cnt AS charge_approved_cnt
FROM ({APPROVED_LINES.replace("{status}", "O")}) x""", ["nation_dim", "v_institution", "v_institution_group"])

view("v_event_signups", f"""
SELECT user_id AS account_id,
       coalesce((SELECT min(o_orderkey) FROM orders WHERE o_custkey = user_id), event_id) AS subscrn_id,
       {idate('ts')} AS signup_date, c_mktsegment AS partner_name,
       n_name AS country_desc, CASE WHEN value >= 5 THEN 'STB' ELSE 'TV' END AS signup_hw_category,
       CASE WHEN {K} % 2 = 0 THEN 1 ELSE 0 END AS p1_possible_complete_cnt,
       CASE WHEN {K} % 5 = 0 THEN 1 ELSE 0 END AS p1_invol_cancel_cnt,
       CASE WHEN {K} % 7 = 0 THEN 1 ELSE 0 END AS p1_vol_cancel_cnt
FROM events JOIN customer ON user_id = c_custkey JOIN nation_dim ON c_nationkey = n_nationkey
WHERE event_type = 'signup'""", ["nation_dim"])


def with_views(body: str, *ctes: tuple[str, str], uses: list[str] | None = None) -> str:
    """``WITH`` clause holding the views the query uses (plus their
    dependencies, in order), extra query-specific CTEs, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][1]:
            visit(dep)
        order.append(name)

    for name in uses or []:
        visit(name)
    parts = [f"{n} AS ({VIEWS[n][0]}\n)" for n in order] + [f"{n} AS ({sql}\n)" for n, sql in ctes]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
