"""Property tests: the skew-safe operators against brute force in Python."""

from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnlens.operators import aggregates as A
from churnlens.operators import windows as W

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

small = st.one_of(st.none(), st.integers(0, 4))
rows3 = st.lists(st.tuples(st.integers(0, 2), small, small), min_size=0, max_size=30)


@SETTINGS
@given(rows3)
def test_conditional_distinct_counts_brute_force(spark, data):
    df = spark.createDataFrame(data, "g int, id int, p int")
    got = {tuple(r) for r in A.conditional_distinct_counts(
        df, ["g"], "id", {"n": None, "np": F.col("p") >= 2}).collect()}
    ids, hits = defaultdict(set), defaultdict(set)
    for g, i, p in data:
        ids[g]
        hits[g]
        if i is not None:
            ids[g].add(i)
            if p is not None and p >= 2:
                hits[g].add(i)
    assert got == {(g, len(ids[g]), len(hits[g])) for g in ids}


@SETTINGS
@given(rows3)
def test_dedupe_first_brute_force(spark, data):
    df = spark.createDataFrame(data, "g int, a int, b int")
    got = {tuple(r) for r in W.dedupe_first(df, ["g"], ["a", "b"]).collect()}

    def sort_key(r):  # ascending, NULLs first
        return tuple((x is not None, x if x is not None else 0) for x in r[1:])

    best = {}
    for r in data:
        if r[0] not in best or sort_key(r) < sort_key(best[r[0]]):
            best[r[0]] = r
    assert got == set(best.values())


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50)), min_size=1, max_size=40, unique=True))
def test_event_sequence_brute_force(spark, data):
    df = spark.createDataFrame([(k, t, i, t // 7) for i, (k, t) in enumerate(data)],
                               "key int, ts int, id int, bucket int")
    got = {(r.id, r.rn) for r in W.event_sequence(df, "key", "ts", "id", "bucket", "rn").collect()}
    want = set()
    per_key = defaultdict(list)
    for i, (k, t) in enumerate(data):
        per_key[k].append((t, i))
    for k, evs in per_key.items():
        for n, (t, i) in enumerate(sorted(evs), start=1):
            want.add((i, n))
    assert got == want


from churnlens.operators import joins as J  # noqa: E402
from churnlens.plans import geo  # noqa: E402

vals = st.one_of(st.none(), st.sampled_from(["a", "b", "c"]))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(20180101, 20180103)), min_size=1, max_size=8),
       st.lists(st.tuples(st.integers(0, 3), vals), max_size=10),
       st.lists(st.tuples(st.integers(0, 3), vals), max_size=10),
       st.lists(st.tuples(st.integers(0, 3), vals), max_size=4, unique_by=lambda r: r[0]))
def test_factorised_geo_reports_equal_row_level(spark, acts, funnel, cohort, prim):
    activations = spark.createDataFrame(
        [(100 + i, 1000 + i, d, link) for i, (link, d) in enumerate(acts)],
        "account_id long, subscrn_id long, signup_date int, current_connected_to_account_id long")
    geo_rows = spark.createDataFrame(
        [(link, 5000 + i, "US", "R", v, v) for i, (link, v) in enumerate(funnel)],
        "account_id long, subscrn_id long, country_iso_code string, de_region_desc string, "
        "subdivision_desc string, region string")
    rpt = spark.createDataFrame(cohort, "current_connected_to_account_id long, geo_desc string")
    ag = spark.createDataFrame([(link, "US", v) for link, v in prim],
                               "account_id long, prim_country_iso_code string, prim_subdivision_iso_code string")
    wide = geo.wide_geo(activations, geo_rows, ag, rpt, "US")
    # the funnel rows of a link are not multiplied by the activations that share it
    per_link, reports = Counter(l for l, _ in funnel), Counter(l for l, _ in cohort)
    assert wide.count() == sum(max(1, per_link[l]) * max(1, reports[l]) * max(1, sum(p == l for p, _ in prim)) for l, _ in acts)
    want_m = {tuple(r) for r in geo.missingness_crosstab_rows(wide).collect()}
    got_m = {tuple(r) for r in geo.missingness_by_source(activations, geo_rows, ag, rpt, "US").collect()}
    assert got_m == want_m
    mm = {"X": ["a"], "Y": ["b"]}
    want_r = {tuple(r) for r in geo.market_region_rollup(wide, mm, 20180103).collect()}
    got_r = {tuple(r) for r in geo.market_region_rollup_by_source(activations, geo_rows, ag, rpt, "US", mm,
                                                                  20180103).collect()}
    assert got_r == want_r


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 28)), max_size=15),
       st.lists(st.tuples(st.integers(0, 2), st.integers(1, 28)), max_size=15),
       st.integers(0, 2), st.integers(0, 3))
def test_band_join_brute_force(spark, left, right, before, after):
    lf = spark.createDataFrame([(k, 20180200 + d, i) for i, (k, d) in enumerate(left)], "a int, d int, li int")
    rf = spark.createDataFrame([(k, 20180200 + d, i) for i, (k, d) in enumerate(right)], "b int, e int, ri int")
    got = sorted(tuple(r) for r in J.band_join(lf, rf, "a", "b", "d", "e", before, after).select("li", "ri").collect())
    want = sorted((i, j) for i, (k, d) in enumerate(left) for j, (k2, e) in enumerate(right)
                  if k == k2 and e - before <= d <= e + after)
    assert got == want


from pyspark.sql import Window  # noqa: E402

from churnlens.plans import partners  # noqa: E402


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(20180101, 20180105)), min_size=1, max_size=8),
       st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9), vals), max_size=12),
       st.lists(st.tuples(st.integers(0, 3), vals), max_size=4, unique_by=lambda r: r[0]))
def test_attach_primary_geo_equals_join_then_row_number(spark, acts, funnel, prim):
    activations = spark.createDataFrame(
        [(100 + i, 1000 + i, d, link) for i, (link, d) in enumerate(acts)],
        "account_id long, subscrn_id long, signup_date int, current_connected_to_account_id long")
    nm = spark.createDataFrame([(link, sub, "US", "R", v, v) for link, sub, v in funnel],
                               "account_id long, subscrn_id long, country_iso_code string, de_region_desc string, "
                               "subdivision_desc string, region string")
    ag = spark.createDataFrame([(link, "US", v) for link, v in prim],
                               "account_id long, prim_country_iso_code string, prim_subdivision_iso_code string")
    got = {tuple(r) for r in geo.attach_primary_geo(activations, nm, ag, "US").collect()}
    # row level: join every funnel row, keep the first by (funnel subscription, other funnel columns)
    j = (activations.alias("s")
         .join(nm.alias("n"), F.col("n.account_id") == F.col("s.current_connected_to_account_id"), "left")
         .join(ag.alias("g"), F.col("g.account_id") == F.col("s.current_connected_to_account_id"), "left"))
    order = [F.col("n." + c).asc_nulls_first() for c in
             ["subscrn_id", "country_iso_code", "de_region_desc", "subdivision_desc", "region"]]
    w = Window.partitionBy("s.account_id", "s.subscrn_id").orderBy(*order)
    want = {tuple(r) for r in j.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(
        "s.account_id", "s.subscrn_id", "s.signup_date", "s.current_connected_to_account_id", "n.country_iso_code",
        "n.subdivision_desc", "n.de_region_desc", "n.region", "g.prim_subdivision_iso_code").collect()}
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1)), min_size=1, max_size=15),
       st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["h1", "h2", "h3"])), max_size=10))
def test_top_accounts_equals_counting_over_handle_rows(spark, subs, handles):
    s = spark.createDataFrame([(acct, 100 + i, rj) for i, (acct, rj) in enumerate(subs)],
                              "account_id long, subscrn_id long, is_rejoin int")
    h = spark.createDataFrame(handles, "account_id long, pai string").distinct()
    got = [tuple(r) for r in partners.top_accounts_by_subs(s, h, 3).collect()]
    rows_ = s.filter("is_rejoin = 1").join(h, "account_id", "left")
    want = [tuple(r) for r in rows_.groupBy("pai", "account_id").agg(F.count_distinct("subscrn_id").alias("num_subs"))
            .orderBy(F.col("num_subs").desc(), F.col("pai").asc_nulls_first(), F.col("account_id")).limit(3).collect()]
    assert got == want


from churnlens.plans import payments  # noqa: E402


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["1", "2", "3", "null"]), st.sampled_from(["A", "B"])), max_size=8),
       st.lists(st.tuples(st.integers(1, 3), st.integers(20181030, 20181102), st.one_of(st.none(), st.integers(0, 1))),
                max_size=8),
       st.lists(st.tuples(st.integers(1, 3), st.integers(20181230, 20190102)), max_size=8))
def test_fraud_status_equals_distinct_of_row_level(spark, reports, subs, cbs):
    matched = spark.createDataFrame([(a, "US", f"R{i}", reason) for i, (a, reason) in enumerate(reports)],
                                    "acct_id string, country_code string, referenceId string, fraud_reason_text string")
    s = spark.createDataFrame(subs, "account_id long, signup_date int, fraud_flag int")
    c = spark.createDataFrame(cbs, "account_id long, cb_event_utc_date int")
    got = sorted(tuple(r) for r in payments.fraud_chargeback_status(matched, s, c, 20181101, 20190101)
                 .select("acct_id", "referenceId", "fraud_reason_text", "fraud_flag", "cb_t_f").collect())
    # as written: join every subscription and chargeback, require both, then keep distinct rows
    key = F.col("acct_id").try_cast("bigint")
    rows_ = (matched.filter(F.col("acct_id") != "null")
             .join(s.filter("signup_date >= 20181101").alias("a"), key == F.col("a.account_id"), "inner")
             .join(c.filter("cb_event_utc_date >= 20190101").alias("cb"), key == F.col("cb.account_id"), "inner")
             .select("acct_id", "referenceId", "fraud_reason_text", "a.fraud_flag", F.lit(1).alias("cb_t_f"))
             .distinct())
    assert got == sorted(tuple(r) for r in rows_.collect())
