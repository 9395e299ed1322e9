from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators import aggregates as A
from churnlens.operators import joins as J
from churnlens.operators import windows as W
from conftest import rows


def test_conditional_distinct_counts_match_count_distinct(spark):
    data = [("g1", 1, 1), ("g1", 1, 0), ("g1", 2, 0), ("g1", None, 1), ("g2", None, 1), ("g3", 5, None)]
    df = spark.createDataFrame(data, "g string, id int, p int")
    got = A.conditional_distinct_counts(df, ["g"], "id", {"n": None, "np": F.col("p") == 1})
    want = df.groupBy("g").agg(F.count_distinct("id").alias("n"),
                               F.count_distinct(F.when(F.col("p") == 1, F.col("id"))).alias("np"))
    assert rows(got) == rows(want)
    # a group whose ids are all NULL still appears with zeros
    assert ("g2", 0, 0) in rows(got)


def test_safe_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 2)], "a int, b int")
    assert [r.r for r in df.select(A.safe_ratio("a", "b").alias("r")).collect()] == [None, 0.25, None]


def test_missingness_crosstab(spark):
    df = spark.createDataFrame([(None, "x"), (None, None), ("a", "b"), (None, "y")], "a string, b string")
    got = rows(A.missingness_crosstab(df, {"a_missing": "a", "b_missing": "b"}))
    assert got == [(0, 0, 1), (1, 0, 2), (1, 1, 1)]


def test_existence_flag_never_multiplies(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    keys = spark.createDataFrame([(1,), (1,), (1,), (3,)], "k int")
    got = rows(J.existence_flag(left, keys, ["k"], "f"))
    assert got == [(1, 1), (2, 0), (3, 1)]


def test_attach_left_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "US"), (2, "CA")], "k int, c string")
    got = rows(J.attach_left(left, right, ["k"], F.col("c") == "US"))
    assert got == [(1, "US"), (2, None)]


def test_band_join_bounds(spark):
    signups = spark.createDataFrame([(1, 20180801), (1, 20180805), (2, 20180801)], "a int, d int")
    events = spark.createDataFrame([(1, 20180802, "e1"), (1, 20180731, "e2"), (2, 20180810, "e3")],
                                   "pa int, ed int, id string")
    got = J.band_join(signups, events, "a", "pa", "d", "ed", 1, 2).select("a", "d", "id")
    # 20180801 is within [20180801, 20180804] of e1 and [20180730, 20180802] of e2
    assert rows(got) == [(1, 20180801, "e1"), (1, 20180801, "e2")]


def test_semi_by_aggregate(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "p string, v int")
    q = spark.createDataFrame([("a",), ("a",)], "p string")
    assert rows(J.semi_by_aggregate(df, q, ["p"])) == [("a", 1), ("a", 3)]


def test_dedupe_first_matches_row_number(spark):
    data = [(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (2, None, "q"), (2, 0, "r"), (3, 5, None)]
    df = spark.createDataFrame(data, "k int, o int, v string")
    got = W.dedupe_first(df, ["k"], ["o", "v"])
    w = Window.partitionBy("k").orderBy(F.col("o").asc_nulls_first(), F.col("v").asc_nulls_first())
    want = df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    assert rows(got) == rows(want)
    assert got.columns == df.columns


def test_event_sequence_equals_row_number_with_hot_key(spark):
    # key 0 holds most rows and spans many buckets
    data = [(0, t, t, t // 5) for t in range(60)] + [(1, 3, 100, 0), (1, 1, 101, 0), (2, 7, 102, 1),
                                                    (None, 4, 103, 0), (None, 9, 104, 1), (3, 2, 105, None)]
    df = spark.createDataFrame(data, "key int, ts int, id int, bucket int")
    got = W.event_sequence(df, "key", "ts", "id", "bucket", "rn").select("id", "rn")
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = df.withColumn("rn", F.row_number().over(w)).select("id", "rn")
    assert rows(got) == rows(want)


def test_rank_within(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (1, 7.0, "b"), (2, 1.0, "c")], "k int, m double, c string")
    got = W.rank_within(df, ["k"], [F.col("m").desc(), F.col("c")], "r")
    assert rows(got.select("c", "r")) == [("a", 2), ("b", 1), ("c", 1)]
