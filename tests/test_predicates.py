"""Single rows at the edges of each condition."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pillflow.functions import predicates as P
from pillflow.functions import scalars as S

TODAY = dt.date(2000, 1, 1)


def judge(spark, values, schema, column):
    indexed = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(indexed, f"i int, x {schema}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_barcode(spark):
    values = ["1234567", "12345678", "1234567890123", "12345678901234", "12345678\n", "1234567a", "١٢٣٤٥٦٧٨", "", None, " 12345678"]
    assert judge(spark, values, "string", P.valid_barcode) == [False, True, True] + [False] * 7


def test_expiry(spark):
    values = ["2000-01-01", "1999-12-31", "2000-01-02", "2000-1-5", "2000-02-30", "05.01.2001", "", None, "2001-01-01 10:00",
              "+2001-1-1", "12001-1-1", "2001-001-05"]
    good = [False, False, True, True] + [False] * 8
    assert judge(spark, values, "string", lambda x: P.acceptable_expiry(x, TODAY)) == good


def test_expired_today_is_good(spark):
    days = [dt.date(1999, 12, 31), TODAY, None]
    assert judge(spark, days, "date", lambda x: P.expired(x, TODAY)) == [True, False, None]


def test_text_filters(spark):
    assert judge(spark, ["Äpfel", "ÄPFEL", "a%b", None], "string", lambda x: P.name_contains(x, "äpfel")) == [True, True, False, None]
    assert judge(spark, ["a%b", "axb"], "string", lambda x: P.name_contains(x, "%")) == [True, False]
    assert judge(spark, ["TIMEOUT", "http 500", "ok", None], "string", P.critical) == [True, True, False, False]
    assert judge(spark, ["Ärger", "x", None], "string", lambda x: P.action_matches(x, "ärger|y")) == [True, False, False]
    assert judge(spark, ["a", None], "string", lambda x: P.action_matches(x, "Alle")) == [True, True]
    assert judge(spark, ["900000001", "190000000"], "string", lambda x: P.barcode_starts(x, "900000")) == [True, False]


def test_barcode_filter_must_be_a_barcode():
    with pytest.raises(ValueError):
        P.barcode_contains(F.lit("x"), "12a")


def test_no_filter(spark):
    for condition in (lambda x: P.at_location(x, "Keller"), lambda x: P.in_channel(x, "Alle"), lambda x: P.article_is(x, None),
                      lambda x: P.digits_contain(x, ""), lambda x: P.barcode_contains(x, None)):
        assert judge(spark, ["a"], "string", condition) == [True]


def test_clock_bounds_are_included(spark):
    times = [dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 17, 30), dt.datetime(2024, 1, 1, 17, 30, 1)]
    assert judge(spark, times, "timestamp_ntz", lambda x: P.within_clock(x, "08:00:00", "17:30:00")) == [True, True, False]


def test_faulty(spark):
    df = spark.createDataFrame([("1", 1, TODAY), ("", 1, TODAY), ("1", 0, TODAY), ("1", 1, None), (None, None, TODAY)],
                               "b string, m int, v date")
    assert [r[0] for r in df.select(P.faulty_stock(F.col("b"), F.col("m"), F.col("v"))).collect()] == [False, True, True, True, False]


def test_channel_numbers(spark):
    values = ["Kanal 1", "Kanal 12", "Kanal 01", "Kanal x", "kanal 1", None, "Kanal 1\n"]
    assert judge(spark, values, "string", S.channel_number) == [1, 12, None, None, None, None, None]


def test_a_year_later_and_hours(spark):
    assert judge(spark, [1], "int", lambda _: S.one_year_after("2024-02-29")) == [dt.date(2025, 2, 28)]
    start, end = S.moment("2024-03-31 01:00:00"), S.moment("2024-03-31 04:30:00")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert judge(spark, [1], "int", lambda _: S.hours_between(start, end)) == [3.5]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
