import datetime as dt

from pyspark.sql import functions as F

from churnlens.functions import dates as D
from churnlens.functions import values as V
from churnlens.functions.lookups import FRAUD_REASONS, SUBDIVISION_DEFAULT, SUBDIVISION_REGIONS


def one(spark, expr, schema="x int", data=((1,),)):
    return spark.createDataFrame(list(data), schema).select(expr.alias("y")).collect()


def test_int_date_roundtrip_and_diff(spark):
    df = spark.createDataFrame([(20180604, 20180705), (20200228, 20200301), (20181231, 20190101)], "a int, b int")
    out = df.select(D.int_date_diff("a", "b").alias("d"), D.int_date_add("a", 2).alias("p"),
                    D.int_date_add("a", -1).alias("m"), D.int_date_month("a").alias("mo")).collect()
    assert [r.d for r in out] == [31, 2, 1]
    assert [r.p for r in out] == [20180606, 20200301, 20190102]
    assert [r.m for r in out] == [20180603, 20200227, 20181230]
    assert [r.mo for r in out] == [20180601, 20200201, 20181201]


def test_int_date_timestamp_is_midnight(spark):
    out = one(spark, D.int_date_timestamp(F.lit(20190304)))
    assert out[0].y == dt.datetime(2019, 3, 4, 0, 0)


def test_epoch_ms_text_to_int_date(spark):
    df = spark.createDataFrame([("1538352000000",), ("1538351999999",), ("null",), (None,)], "v string")
    got = [r.y for r in df.select(D.epoch_ms_to_int_date("v").alias("y")).collect()]
    assert got == [20181001, 20180930, None, None]


def test_flag_null_predicate_is_zero(spark):
    df = spark.createDataFrame([(1,), (None,), (0,)], "x int")
    assert [r.y for r in df.select(V.flag(F.col("x") == 1).alias("y")).collect()] == [1, 0, 0]


def test_decode_passes_unknown_codes_through(spark):
    df = spark.createDataFrame([("6",), ("randomenotestokeep",), ("1",), ("8",), (None,)], "c string")
    got = [r.y for r in df.select(V.decode("c", FRAUD_REASONS).alias("y")).collect()]
    assert got == ["TC40_Fraudulent_Use", "TC40_Fraudulent_Use", "TC40_Card_Stolen", "8", None]


def test_bucket_uses_correct_spelling_and_default(spark):
    df = spark.createDataFrame([("Oregon",), ("OregCenon",), ("Ohio",), (None,)], "s string")
    got = [r.y for r in df.select(V.bucket("s", SUBDIVISION_REGIONS, SUBDIVISION_DEFAULT).alias("y")).collect()]
    assert got == ["West", "Other", "Northeast", "Other"]


def test_capped_overflow_includes_null(spark):
    df = spark.createDataFrame([(0,), (31,), (32,), (None,)], "d int")
    assert [r.y for r in df.select(V.capped("d", 31, 999).alias("y")).collect()] == [0, 31, 999, 999]


def test_not_sentinel_rejects_null_and_dash(spark):
    df = spark.createDataFrame([("--",), (None,), ("12345",)], "z string")
    assert [r.z for r in df.filter(V.not_sentinel("z")).collect()] == ["12345"]


def test_map_get_missing_key_is_null(spark):
    df = spark.createDataFrame([({"k": "1"},)], "m map<string,string>")
    r = df.select(V.map_get("m", "k").alias("a"), V.map_get("m", "q").alias("b")).collect()[0]
    assert (r.a, r.b) == ("1", None)


def test_safe_cast_dirty_text(spark):
    df = spark.createDataFrame([("42",), ("null",), ("",)], "s string")
    assert [r.y for r in df.select(V.safe_cast("s", "bigint").alias("y")).collect()] == [42, None, None]


def test_zip5_and_institution(spark):
    df = spark.createDataFrame([("02139-1234", None, ' Bank "X" '), ("123", "Wells Fargo", "ignored")],
                               "p string, g string, d string")
    out = df.select(V.zip5("p").alias("z"), V.normalise_institution("g", "d").alias("i")).collect()
    assert [r.z for r in out] == ["02139", "123"]
    assert [r.i for r in out] == ['BANK ""X""', "WELLS FARGO"]


def test_impossible_int_dates_are_null(spark):
    df = spark.createDataFrame([(20180230, 20180301), (0, 20180301), (None, 20180301)], "a int, b int")
    out = df.select(D.int_date_diff("a", "b").alias("d"), D.int_date_add("a", 1).alias("p")).collect()
    assert [(r.d, r.p) for r in out] == [(None, None)] * 3
