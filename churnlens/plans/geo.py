"""Geography attribution: IP geo, postal codes near signup, bundle regions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.dates import int_date, int_date_timestamp, int_date_to_date
from churnlens.functions.values import bucket, map_key, not_sentinel, null_default, safe_cast, zip5
from churnlens.operators.aggregates import conditional_distinct_counts, missingness_crosstab, safe_ratio
from churnlens.operators.joins import band_join

SUB_KEYS = ["account_id", "subscrn_id"]

def _p1_counts() -> dict:
    return {
        "num_p1_complete": F.col("p1_possible_complete_cnt") == 1,
        "num_p1_invol": F.col("p1_invol_cancel_cnt") == 1,
        "num_p1_vol": F.col("p1_vol_cancel_cnt") == 1,
    }


# --- IP geography ----------------------------------------------------------------

def ip_geo_attribution(signups: DataFrame, connections: DataFrame, markets: DataFrame, partner: str,
                       lo: int, hi: int, conn_lo: int, conn_hi: int, country: str) -> DataFrame:
    """Distinct accounts of one partner with the geography of their device
    connections and the market (DMA) of that geography.

    The market join tests a *left-side* column in its ON clause
    (``geo_country = country``): rows that fail keep NULL market attributes
    instead of being dropped, so the test stays inside the join condition.
    Market keys are cast with ``try_cast`` (dirty ``'null'`` text gives NULL).
    """
    ncf = (signups.filter((F.col("partner_name") == partner) & F.col("signup_date").between(lo, hi))
           .groupBy("account_id")
           .agg(F.max("p1_possible_complete_cnt").alias("p1_possible_complete_cnt"),
                F.max("p1_invol_cancel_cnt").alias("p1_invol_cancel_cnt"),
                F.max("p1_vol_cancel_cnt").alias("p1_vol_cancel_cnt"),
                F.min("signup_date").alias("signup_date")))
    d = connections.filter(F.col("utc_date").between(conn_lo, conn_hi) & F.col("execution_id").isNotNull())
    j = ncf.join(d, ncf["account_id"] == d["input_account_id"], "inner")
    m = markets.select(safe_cast("dma_id", "bigint").alias("dma_key"), "dma_desc", "longitude", "latitude")
    j = j.join(m, (safe_cast(j["geo_dma"], "bigint") == m["dma_key"]) & (j["geo_country"] == country), "left")
    return j.filter(F.col("signup_date").between(lo, hi)).select(
        "account_id", "p1_possible_complete_cnt", "p1_invol_cancel_cnt", "p1_vol_cancel_cnt",
        F.col("device_category").alias("connect_device_category"),
        F.col("input_flow").alias("connect_input_flow"),
        F.col("geo_country").alias("connect_geo_country"),
        F.col("geo_region").alias("connect_geo_region"),
        F.col("geo_city").alias("connect_geo_city"),
        F.col("geo_zip").alias("connect_geo_zip"),
        F.col("geo_dma").alias("connect_geo_dma_id"),
        F.col("dma_desc").alias("connect_geo_dma_desc"),
        F.col("longitude").alias("connect_geo_longitude"),
        F.col("latitude").alias("connect_geo_latitude"),
        "signup_date",
    ).distinct()


def involuntary_by_region(attributed: DataFrame) -> DataFrame:
    """Distinct accounts completing / cancelling period 1 by region."""
    return conditional_distinct_counts(attributed, ["connect_geo_region"], "account_id", {
        "p1_possible_complete": F.col("p1_possible_complete_cnt") == 1,
        "p1_invol_cancel_cnt": F.col("p1_invol_cancel_cnt") == 1,
        "p1_vol_cancel_cnt": F.col("p1_vol_cancel_cnt") == 1,
    })


# --- postal codes from payment events near signup ---------------------------------

def payment_postal_events(payments: DataFrame, country: str | None) -> DataFrame:
    """Payment events that carry a postal code (read from the stored key
    columns where the table has them, else from the map)."""
    out = payments.select(
        "account_id", "event_utc_date", "event_utc_ms_ts", "country_code",
        map_key(payments, "degenerate_values_map", "mop_postal_code").alias("mop_postal_code"),
        map_key(payments, "degenerate_values_map", "bin_metadata_type").alias("bin_metadata_type"))
    cond = F.col("mop_postal_code").isNotNull()
    if country is not None:
        cond = cond & (F.col("country_code") == country)
    return out.filter(cond).drop("country_code")


def postal_attribution(signups: DataFrame, periods: DataFrame, payments: DataFrame, hw_category: str,
                       country: str | None, partners: Iterable[str], p1_since: int, pay_country: str | None = None,
                       before: int = 1, after: int = 2,
                       slices: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Signups with the postal code of payment events on the signup day or
    up to ``before`` days after it: the original's band ``event - before <=
    signup <= event + after`` together with its ``signup <= event``, which
    leaves ``after`` without effect.

    The original unions the same query over six overlapping event-date
    slices, repeating an event up to three times.  Here the event fact is
    scanned once; ``slices`` reproduces the repetition by joining the events
    to a small table of slice bounds (one copy per slice that holds the
    event date).  Without ``slices`` every event is used once.
    """
    cond = (F.col("signup_hw_category") == hw_category) & F.col("partner_name").isin(list(partners))
    if country is not None:
        cond = cond & (F.col("country_desc") == country)
    alloc = signups.filter(cond)
    bp1 = (periods.filter((F.col("billing_period_nbr") == 1) & (F.col("billing_period_end_date") >= p1_since))
           .select(*SUB_KEYS, "first_try_pmt_type_desc"))
    alloc = alloc.join(bp1, SUB_KEYS, "left").select(
        "account_id", "subscrn_id", "signup_date", "partner_name", _pmt_type(),
        "p1_possible_complete_cnt", "p1_invol_cancel_cnt", "p1_vol_cancel_cnt")
    peh = payment_postal_events(payments, pay_country).withColumnRenamed("account_id", "pay_account_id")
    if slices:
        # one row per (slice, day): a day covered by two slices appears twice,
        # reproducing the original's repetition through a plain equi join
        spark = payments.sparkSession
        bounds = spark.createDataFrame(list(slices), "slice_lo int, slice_hi int")
        days = bounds.select(F.explode(F.sequence(int_date_to_date("slice_lo"), int_date_to_date("slice_hi")))
                             .alias("d")).select(int_date("d").alias("slice_day"))
        peh = peh.join(F.broadcast(days), F.col("event_utc_date") == F.col("slice_day")).drop("slice_day")
    j = band_join(alloc, peh, "account_id", "pay_account_id", "signup_date", "event_utc_date", before, min(after, 0))
    return (j.select("account_id", "subscrn_id", "signup_date", "partner_name", "signup_pmt_type_desc",
                    "p1_possible_complete_cnt", "p1_invol_cancel_cnt", "p1_vol_cancel_cnt",
                    "mop_postal_code", "bin_metadata_type", "event_utc_date", "event_utc_ms_ts"))


def _pmt_type() -> F.Column:
    return null_default("first_try_pmt_type_desc", "Unknown").alias("signup_pmt_type_desc")


def postal_daily_rates(attributed: DataFrame) -> DataFrame:
    """Distinct completed / cancelled subscriptions and cancel rates by
    signup day, partner, payment type and postal code."""
    counts = conditional_distinct_counts(
        attributed, ["signup_date", "partner_name", "signup_pmt_type_desc", "mop_postal_code"],
        "subscrn_id", _p1_counts())
    return (counts.withColumn("p1_invol_rate", safe_ratio("num_p1_invol", "num_p1_complete"))
            .withColumn("p1_vol_rate", safe_ratio("num_p1_vol", "num_p1_complete")))


def _with_zip(attributed: DataFrame) -> DataFrame:
    return (attributed.filter(not_sentinel("mop_postal_code", ("--",)))
            .withColumn("zip5", zip5("mop_postal_code")))


def postal_enrich(attributed: DataFrame, postal: DataFrame) -> DataFrame:
    """Counts by signup day, partner, payment type and 5-digit postal code
    with state, county and metro (inner join on the postal key)."""
    p = postal.select("zip_postal_desc", "state_desc", "county_desc", "cbsa_desc")
    j = _with_zip(attributed).join(p, F.col("zip5") == F.col("zip_postal_desc"), "inner")
    j = (j.withColumn("signup_ts", int_date_timestamp("signup_date"))
         .drop("mop_postal_code").withColumnRenamed("zip5", "mop_postal_code"))
    out = conditional_distinct_counts(
        j, ["signup_ts", "partner_name", "signup_pmt_type_desc", "mop_postal_code", "state_desc",
            "county_desc", "cbsa_desc"], "subscrn_id", _p1_counts())
    return out.withColumnRenamed("signup_ts", "signup_date")


def partner_state_summary(attributed: DataFrame, postal: DataFrame) -> DataFrame:
    """Counts by partner and state (left join: unknown codes give a NULL
    state)."""
    p = postal.select("zip_postal_desc", "state_desc")
    j = _with_zip(attributed).join(p, F.col("zip5") == F.col("zip_postal_desc"), "left")
    return conditional_distinct_counts(j, ["partner_name", "state_desc"], "subscrn_id", _p1_counts())


# --- bundle activations and regions ---------------------------------------------------

def region_daily_signups(funnel: DataFrame, subdivisions: DataFrame, signups: DataFrame, subs: DataFrame,
                         region_map: Mapping[str, Iterable[str]], partner: str, since: int, country: str,
                         funnel_since: int, activated_since: int | None = None,
                         default_region: str = "Other") -> DataFrame:
    """Signups per day and region of one billing partner from regional
    funnel signups.  Summed per (day, country, subdivision, partner, type)
    first, then per (day, region); ordered by day and region.

    ``activated_since`` selects the stricter variant that keeps only clean,
    activated bundle subscriptions signed up since that day.
    """
    nm = funnel.filter((F.col("funnel_event_desc") == "signup") & (F.col("de_country_desc") == country)
                       & (F.col("event_region_date") >= funnel_since))
    gs = subdivisions.select(F.col("country_iso_code").alias("gs_country"), "subdivision_iso_code",
                             "subdivision_desc")
    s = subs.select(*SUB_KEYS, "signup_date", "billing_partner_desc", "signup_subscription_type",
                    "country_iso_code", "fraud_flag", "is_tester", "signup_billing_partner_desc",
                    "current_connected_to_account_id")
    if activated_since is not None:
        s = s.filter((F.col("signup_date") >= activated_since) & (F.col("country_iso_code") == country)
                     & (F.coalesce(F.col("fraud_flag"), F.lit(0)) == 0) & (F.col("is_tester") == 0)
                     & (F.col("signup_subscription_type") == "P")
                     & (F.col("signup_billing_partner_desc") == partner)
                     & F.col("current_connected_to_account_id").isNotNull())
    j = (nm.join(gs, (nm["de_country_desc"] == gs["gs_country"])
                 & (nm["de_region_desc"] == gs["subdivision_iso_code"]), "inner")
         .join(signups.select(*SUB_KEYS, "signup_cnt"), SUB_KEYS, "inner")
         .join(s, SUB_KEYS, "inner")
         .filter((F.col("signup_date") >= since) & (F.col("billing_partner_desc") == partner)))
    t1 = (j.groupBy("signup_date", "de_country_desc", "subdivision_desc", "billing_partner_desc",
                    "signup_subscription_type")
          .agg(F.sum("signup_cnt").alias("signup_count")))
    return (t1.groupBy("signup_date", bucket("subdivision_desc", region_map, default_region).alias("region"))
            .agg(F.sum("signup_count").cast("bigint").alias("signup_count"))
            .orderBy("signup_date", "region"))


def activation_geo(funnel: DataFrame, subdivisions: DataFrame, activations: DataFrame,
                   region_map: Mapping[str, Iterable[str]], since: int, country: str,
                   default_region: str = "Other", multiplicity: bool = True) -> DataFrame:
    """Funnel geography of the linked (streaming) accounts of activations.

    As written (``multiplicity=True``) a funnel row appears once per
    activation sharing its link.  The activations are first counted per
    link, so the join is many-to-one (a hot link's funnel rows can be split
    across tasks), and each funnel row is then repeated by its count.
    ``multiplicity=False`` keeps each funnel row once (a semi join on the
    links), which is all that consumers taking a per-link minimum or set of
    values need.
    """
    nm = funnel.filter((F.col("event_region_date") >= since) & (F.col("funnel_event_desc") == "signup")
                       & (F.col("de_country_desc") == country))
    gs = subdivisions.select(F.col("country_iso_code").alias("gs_country"), "subdivision_iso_code",
                             "subdivision_desc")
    links = activations.select(F.col("current_connected_to_account_id").alias("link"))
    j = nm.join(gs, (nm["de_country_desc"] == gs["gs_country"])
                & (nm["de_region_desc"] == gs["subdivision_iso_code"]), "inner")
    if multiplicity:
        per_link = links.groupBy("link").agg(F.count(F.lit(1)).cast("int").alias("__m"))
        j = (j.join(per_link, j["account_id"] == per_link["link"], "inner")
             .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__m")))))
    else:
        j = j.join(links, j["account_id"] == links["link"], "left_semi")
    return j.select(
        "account_id", "subscrn_id", F.col("de_country_desc").alias("country_iso_code"), "de_region_desc",
        "subdivision_desc", bucket("subdivision_desc", region_map, default_region).alias("region"))


NM_ORDER = ["nm_subscrn_id", "country_iso_code", "de_region_desc", "subdivision_desc", "region"]


def attach_primary_geo(activations: DataFrame, geo: DataFrame, account_geo: DataFrame,
                       country: str) -> DataFrame:
    """One row per activation with the funnel geography and the primary
    subdivision of its linked account.

    The original joins every funnel row of the link and keeps an arbitrary
    row per subscription.  Here the choice is made deterministic (the funnel
    row with the smallest funnel subscription id, then the other funnel
    columns) and taken *before* the join: the funnel side is reduced to one
    row per link, so no activation x funnel pairs are ever built.
    """
    nm = geo.select(F.col("account_id").alias("nm_link"), F.col("subscrn_id").alias("nm_subscrn_id"),
                    "country_iso_code", "de_region_desc", "subdivision_desc", "region")
    best = (nm.groupBy("nm_link").agg(F.min(F.struct(*NM_ORDER)).alias("__b"))
            .select("nm_link", *[F.col("__b")[c].alias(c) for c in NM_ORDER]))
    ag = (account_geo.filter(F.col("prim_country_iso_code") == country)
          .select(F.col("account_id").alias("geo_account_id"), "prim_subdivision_iso_code"))
    s = activations.select(*SUB_KEYS, "signup_date", "current_connected_to_account_id")
    link = s["current_connected_to_account_id"]
    return (s.join(best, link == best["nm_link"], "left")
            .join(ag, link == ag["geo_account_id"], "left")
            .select(*SUB_KEYS, "signup_date", "current_connected_to_account_id", "country_iso_code",
                    "subdivision_desc", "de_region_desc", "region", "prim_subdivision_iso_code"))


def attach_cohort_geo(attached: DataFrame, cohort: DataFrame) -> DataFrame:
    """Add the partner report's geography for the same linked account and
    enrollment day.  Of several report rows the smallest known geography is
    taken (reduced per key before the join, so each activation keeps exactly
    one row)."""
    rpt = (cohort.groupBy(F.col("current_connected_to_account_id").alias("rpt_link"),
                          F.col("enrollment_date").alias("rpt_date"))
           .agg(F.min("geo_desc").alias("geo_desc")))
    cond = ((attached["current_connected_to_account_id"] == rpt["rpt_link"])
            & (attached["signup_date"] == rpt["rpt_date"]))
    return attached.join(rpt, cond, "left").drop("rpt_link", "rpt_date")


def activation_geo_weighted(funnel: DataFrame, subdivisions: DataFrame, activations: DataFrame,
                            region_map: Mapping[str, Iterable[str]], since: int, country: str) -> DataFrame:
    """:func:`activation_geo` without the copies: each funnel row once, with
    the number of activations that share its link (``n_activations``)."""
    rows = activation_geo(funnel, subdivisions, activations, region_map, since, country, multiplicity=False)
    per_link = (activations.groupBy(F.col("current_connected_to_account_id").alias("link"))
                .agg(F.count(F.lit(1)).alias("n_activations")))
    return rows.join(per_link, rows["account_id"] == per_link["link"], "inner").drop("link")


#: Columns that each source gives the wide geography.
WIDE_SOURCES = {"funnel": ["current_connected_to_subscrn_id", "country_iso_code", "subdivision_desc", "region"],
                "primary": ["prim_subdivision_iso_code"], "report": ["geo_desc"]}


def wide_geo_factors(activations: DataFrame, geo_rows: DataFrame, account_geo: DataFrame, cohort: DataFrame, country: str) -> DataFrame:
    """:func:`wide_geo` as factors: one row per link, source and distinct
    value, with the number of the source's rows that hold it.  A source
    without rows has one row without values for the link, as the left joins
    give.  The links are those of the activations; ``n_activations`` counts
    them on the rows of source ``activation``.

    The wide rows of a link number the product over the four sources of their
    sums of ``n``; :func:`expand_wide_geo` writes them out.
    """
    values = [c for cs in WIDE_SOURCES.values() for c in cs]
    known = activations.select(F.col("current_connected_to_account_id").alias("link"))
    links = known.groupBy("link").agg(F.count(F.lit(1)).alias("n"))

    def source(name: str, rows: DataFrame, key: str) -> DataFrame:
        own = rows.groupBy(F.col(key).alias("f_link"), *WIDE_SOURCES[name]).agg(F.count(F.lit(1)).alias("f_n"))
        joined = links.select("link").join(own, F.col("link") == F.col("f_link"), "left")
        empty = [F.lit(None).cast("string").alias(c) for c in values if c not in WIDE_SOURCES[name] and c != "current_connected_to_subscrn_id"]
        if name != "funnel":
            empty.append(F.lit(None).cast("bigint").alias("current_connected_to_subscrn_id"))
        return joined.select("link", F.lit(name).alias("source"), *WIDE_SOURCES[name], *empty, F.coalesce("f_n", F.lit(1)).alias("n"))

    nm = geo_rows.withColumnRenamed("subscrn_id", "current_connected_to_subscrn_id")
    out = (source("funnel", nm, "account_id")
           .unionByName(source("primary", account_geo.filter(F.col("prim_country_iso_code") == country), "account_id"))
           .unionByName(source("report", cohort, "current_connected_to_account_id"))
           .unionByName(links.select("link", F.lit("activation").alias("source"), "n"), allowMissingColumns=True))
    return out.select("link", "source", *values, "n")


def expand_wide_geo(activations: DataFrame, factors: DataFrame) -> DataFrame:
    """The rows of :func:`wide_geo` from its factors."""
    out = activations.select(*SUB_KEYS, "signup_date", "current_connected_to_account_id")
    for name, columns in WIDE_SOURCES.items():
        own = (factors.filter(F.col("source") == name)
               .select(F.col("link").alias("f_link"), *columns, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")))
        out = out.join(own, out["current_connected_to_account_id"].eqNullSafe(own["f_link"]), "inner").drop("f_link", "copy")
    return out


def _state() -> F.Column:
    return F.coalesce(F.col("subdivision_desc"), F.col("prim_subdivision_iso_code"), F.col("geo_desc"))


def state_counts_priority(attached: DataFrame, before: int) -> DataFrame:
    """Distinct signing accounts per day and best-known state (funnel
    subdivision, else primary subdivision, else report geography)."""
    return (attached.filter(F.col("signup_date") < before)
            .groupBy("signup_date", _state().alias("state"))
            .agg(F.count_distinct("account_id").alias("num_signup")))


def wide_geo(activations: DataFrame, geo: DataFrame, account_geo: DataFrame, cohort: DataFrame,
             country: str) -> DataFrame:
    """All three geography sources side by side, without dedupe.

    ``geo`` holds each funnel row once (``activation_geo`` with
    ``multiplicity=False``): the original's sub-select does not join the
    activations.  Output rows per activation = funnel rows x report rows of
    its link (the original's fan-out, kept because the row counts are what
    the missing-source and roll-up reports measure).  Those reports are also available
    from a per-link summary (:func:`missingness_by_source`,
    :func:`market_region_rollup_by_source`) without building the pairs.
    """
    nm = geo.select(F.col("account_id").alias("nm_link"),
                    F.col("subscrn_id").alias("current_connected_to_subscrn_id"),
                    "country_iso_code", "subdivision_desc", "region")
    ag = (account_geo.filter(F.col("prim_country_iso_code") == country)
          .select(F.col("account_id").alias("geo_account_id"), "prim_subdivision_iso_code"))
    rpt = cohort.select(F.col("current_connected_to_account_id").alias("rpt_link"), "geo_desc")
    s = activations.select(*SUB_KEYS, "signup_date", "current_connected_to_account_id")
    link = s["current_connected_to_account_id"]
    return (s.join(nm, link == nm["nm_link"], "left")
            .join(ag, link == ag["geo_account_id"], "left")
            .join(rpt, link == rpt["rpt_link"], "left")
            .select(*SUB_KEYS, "signup_date", "current_connected_to_account_id",
                    "current_connected_to_subscrn_id", "country_iso_code", "subdivision_desc", "region",
                    "prim_subdivision_iso_code", "geo_desc"))


MISSING_FLAGS = {"geo_acct_missing_t_f": "prim_subdivision_iso_code",
                 "nm_geo_missing_t_f": "region",
                 "rpt_missing_t_f": "geo_desc"}


def missingness_crosstab_rows(wide: DataFrame) -> DataFrame:
    """Row counts of the wide table by which geography source is missing."""
    return missingness_crosstab(wide, MISSING_FLAGS)


def link_summary(geo_rows: DataFrame, account_geo: DataFrame, cohort: DataFrame, country: str) -> DataFrame:
    """What the rows of :func:`wide_geo` of one linked account look like, one
    row per link: ``states`` (first known of funnel subdivision, primary
    subdivision, report geography) and ``missing`` (which sources are NULL),
    each with the number of wide rows.  Both depend on the link alone, so one
    table serves every activation and every report over the wide rows.

    The three sources are stacked as (link, source, value) and counted, then
    gathered per link: as many entries as a link has distinct values, which
    the geography dimension bounds, whatever the number of rows.  A source
    without rows counts as one row without a value, as in a left join.

    ``geo_rows`` is the funnel geography with each funnel row once
    (``activation_geo(..., multiplicity=False)``).
    """
    def source(df: DataFrame, kind: str, link, value, known) -> DataFrame:
        return df.select(link.alias("link"), F.lit(kind).alias("kind"), value.alias("value"), known.isNotNull().alias("known"))

    col = F.col
    rows = (source(geo_rows, "funnel", col("account_id"), col("subdivision_desc"), col("region"))
            .unionByName(source(account_geo.filter(col("prim_country_iso_code") == country), "primary", col("account_id"),
                                col("prim_subdivision_iso_code"), col("prim_subdivision_iso_code")))
            .unionByName(source(cohort, "report", col("current_connected_to_account_id"), col("geo_desc"), col("geo_desc")))
            .filter(col("link").isNotNull()))
    counts = rows.groupBy("link", "kind", "value", "known").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("value", "known", "n")
    per_link = counts.groupBy("link").agg(*[F.collect_list(F.when(col("kind") == k, entry)).alias(k) for k in ("funnel", "primary", "report")])
    none = F.array(F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("known"), F.lit(1).cast("bigint").alias("n")))
    filled = per_link.select("link", *[F.when(F.size(k) > 0, col(k)).otherwise(none).alias(k) for k in ("funnel", "primary", "report")])

    def total(source_col: str, keep=lambda x: F.lit(True)):
        return F.aggregate(F.filter(source_col, keep), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])

    def unknown(x):
        return x["value"].isNull()

    def states(source_col: str, weight, keep=lambda x: x["value"].isNotNull()):
        return F.transform(F.filter(source_col, keep), lambda x: F.struct(x["value"].alias("state"), (x["n"] * weight).alias("n")))

    def known_or_not(source_col: str, yes: bool):
        return total(source_col, lambda x: x["known"] if yes else ~x["known"])

    free_funnel, free_primary = total("funnel", unknown), total("primary", unknown)
    all_states = F.concat(
        states("funnel", total("primary") * total("report")),
        states("primary", free_funnel * total("report")),
        states("report", free_funnel * free_primary, lambda x: F.lit(True)))
    both = (False, True)
    missing = F.array(*[
        F.struct(F.lit(not p).alias("primary"), F.lit(not f).alias("funnel"), F.lit(not r).alias("report"),
                 (known_or_not("primary", p) * known_or_not("funnel", f) * known_or_not("report", r)).alias("n"))
        for p in both for f in both for r in both])
    return filled.select("link", F.filter(all_states, lambda s: s["n"] > 0).alias("states"),
                         F.filter(missing, lambda m: m["n"] > 0).alias("missing"))


def _with_link(activations: DataFrame, summary: DataFrame, entries: str, absent) -> DataFrame:
    """Activations with one row per entry of their link's summary; those
    without a link there have the entry ``absent``."""
    s = summary.select(F.col("link").alias("s_link"), entries)
    j = activations.join(s, activations["current_connected_to_account_id"] == s["s_link"], "left")
    return j.withColumn("e", F.explode(F.coalesce(F.col(entries), F.array(absent)))).drop("s_link", entries)


def missingness_by_source(activations: DataFrame, geo_rows: DataFrame, account_geo: DataFrame,
                          cohort: DataFrame, country: str) -> DataFrame:
    """Same counts as ``missingness_crosstab_rows(wide_geo(...))`` without
    building the fan-out (see :func:`link_summary`)."""
    return missingness_from_summary(activations, link_summary(geo_rows, account_geo, cohort, country))


def missingness_from_summary(activations: DataFrame, summary: DataFrame) -> DataFrame:
    """The missing-source counts, read from a per-link summary: at most eight
    entries per activation."""
    yes = F.lit(True)
    absent = F.struct(yes.alias("primary"), yes.alias("funnel"), yes.alias("report"), F.lit(1).cast("bigint").alias("n"))
    j = _with_link(activations.select("current_connected_to_account_id"), summary, "missing", absent)
    flags = {"geo_acct_missing_t_f": "primary", "nm_geo_missing_t_f": "funnel", "rpt_missing_t_f": "report"}
    return (j.groupBy(*[F.col("e")[source].cast("int").alias(name) for name, source in flags.items()])
            .agg(F.sum(F.col("e")["n"]).alias("cnt")))


def market_region_rollup_by_source(activations: DataFrame, geo_rows: DataFrame, account_geo: DataFrame,
                                   cohort: DataFrame, country: str, market_map: Mapping[str, Iterable[str]],
                                   before: int, default_region: str = "missing") -> DataFrame:
    """Same result as ``market_region_rollup(wide_geo(...))`` without building
    the fan-out (see :func:`link_summary`)."""
    summary = link_summary(geo_rows, account_geo, cohort, country)
    return market_rollup_from_summary(activations, summary, market_map, before, default_region)


def market_rollup_from_summary(activations: DataFrame, summary: DataFrame, market_map: Mapping[str, Iterable[str]],
                               before: int, default_region: str = "missing") -> DataFrame:
    """The market roll-up, read from a per-link summary: each activation
    yields one row per distinct state of its link, and both measures come from
    these rows."""
    absent = F.struct(F.lit(None).cast("string").alias("state"), F.lit(1).cast("bigint").alias("n"))
    s = activations.filter(F.col("signup_date") < before).select("account_id", "signup_date", "current_connected_to_account_id")
    j = _with_link(s, summary, "states", absent).select("account_id", "signup_date", F.col("e")["state"].alias("state"), F.col("e")["n"].alias("n"))
    # one row per (day, state, account) first, so that both measures are sums
    per_account = j.groupBy("signup_date", "state", "account_id").agg(F.sum("n").alias("n"))
    return (per_account.groupBy("signup_date", bucket("state", market_map, default_region).alias("region"))
            .agg(F.sum("n").alias("signup_cnt"), F.count("account_id").alias("signup_accounts")))


def market_region_rollup(wide: DataFrame, market_map: Mapping[str, Iterable[str]], before: int,
                         default_region: str = "missing") -> DataFrame:
    """Per signup day and market region: wide-table rows (``signup_cnt``)
    and distinct accounts summed over states (``signup_accounts``); the two
    measures differ when the wide table fans out."""
    per_state = (wide.filter(F.col("signup_date") < before)
                 .groupBy("signup_date", _state().alias("state"))
                 .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("account_id").alias("n_accounts")))
    return (per_state.groupBy("signup_date", bucket("state", market_map, default_region).alias("region"))
            .agg(F.sum(F.coalesce(F.col("n_rows"), F.lit(0))).cast("bigint").alias("signup_cnt"),
                 F.sum("n_accounts").cast("bigint").alias("signup_accounts")))


def cohort_size(cohort: DataFrame, partner: str, sub_type: str, enrollment_date: int) -> DataFrame:
    """Report rows per signup day for one partner, type and enrollment day."""
    return (cohort.filter((F.col("signup_subscription_type") == sub_type) & (F.col("nio_partner_name") == partner)
                          & (F.col("enrollment_date") == enrollment_date))
            .groupBy("signup_date").agg(F.count(F.lit(1)).alias("cnt")))
