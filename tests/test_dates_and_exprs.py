"""Boundary differences, strict greatest, guarded ratios, conditional sums, text fields."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillscope.functions import dates as D
from tillscope.functions import exprs as E
from tillscope.functions import text as X


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def day(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize("a, b, months", [
    ("2021-01-31", "2021-02-01", 1), ("2020-02-29", "2021-02-28", 12),
    ("2021-12-31", "2022-01-01", 1), ("2021-03-01", "2021-03-31", 0), ("2021-02-01", "2021-01-31", -1),
])
def test_month_boundaries(spark, a, b, months):
    assert one(spark, D.months_between(day(a), day(b)))[0] == months


@pytest.mark.parametrize("a, b, minutes", [
    ("2021-01-01 00:00:59", "2021-01-01 00:01:00", 1), ("2021-01-01 00:01:00", "2021-01-01 00:01:59", 0),
    ("2021-01-01 23:59:59", "2021-01-02 00:00:00", 1), ("2021-01-01 00:01:00", "2021-01-01 00:00:59", -1),
])
def test_minute_boundaries(spark, a, b, minutes):
    assert one(spark, D.minutes_between(ts(a), ts(b)))[0] == minutes


def test_day_and_week_boundaries(spark):
    assert one(spark, D.days_between(ts("2021-01-01 23:59:00"), ts("2021-01-02 00:01:00")))[0] == 1
    # Sunday to Monday crosses a week border
    assert one(spark, D.weeks_between(day("2021-01-03"), day("2021-01-04")))[0] == 1


def test_minutes_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # the hour skipped by daylight saving time counts like any other
        got = one(spark, D.minutes_between(ts("2021-03-14 01:30:00"), ts("2021-03-14 03:30:00")))
        assert got[0] == 120
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sentinels(spark):
    row = one(spark, D.never_to_null(day("9999-09-09")), D.null_to_never(F.lit(None).cast("date")),
              D.never_to_null(day("9999-12-31"), D.OPEN_END))
    assert row == (None, D.NEVER, None)


def test_unpadded_date_text():
    assert D.parse_iso("2021-1-1") == dt.date(2021, 1, 1)


def test_greatest_is_null_when_any_side_is(spark):
    null = F.lit(None).cast("int")
    row = one(spark, E.greatest_strict(F.lit(1), null), E.greatest_strict(null, F.lit(1)),
              E.greatest_strict(F.lit(1), F.lit(2)))
    assert row == (None, None, 2)


def test_ratio_guards_zero_and_null(spark):
    row = one(spark, E.safe_ratio(F.lit(1), F.lit(0)), E.safe_ratio(F.lit(1), F.lit(None).cast("int")),
              E.safe_ratio(F.lit(1), F.lit(4)))
    assert row == (None, None, 0.25)


def test_conditional_sums_differ_when_nothing_matches(spark):
    df = spark.range(3)
    row = df.agg(E.sum_if(F.col("id") > 9, F.col("id")), E.sum_if_null(F.col("id") > 9, F.col("id"))).first()
    assert row[0] == 0 and row[1] is None


def test_rule_order_decides(spark):
    rules = [(F.col("id") > 0, "first"), (F.col("id") > 1, "second")]
    got = [r[0] for r in spark.range(3).orderBy("id").select(E.ordered_rules(rules)).collect()]
    assert got == [None, "first", "first"]


def test_text_boolean(spark):
    row = one(spark, *[E.text_flag(F.lit(v)) for v in ("TRUE", "FALSE", "true", "")])
    assert row == (1, 0, None, None)


def test_fields_of_dirty_text_are_null(spark):
    t = F.lit("Cart: {custom: 1, items: 22, total: 300}")
    row = one(spark, X.field_int(t, "custom"), X.field_int(t, "items"), X.field_int(t, "total"),
              X.field_int(F.lit("{custom: 1, items: 2}"), "total"),
              X.field_int(F.lit("{ custom : 7 }"), "custom"),
              X.int_after(F.lit("Add: (null)"), r"^[^:]*:.(-?\d+)\s*$"),
              X.int_after(F.lit("Add: 99999999999999"), r"^[^:]*:.(-?\d+)\s*$"))
    assert row == (1, 22, 300, None, 7, None, None)


def test_find_and_json(spark):
    row = one(spark, X.find_text(F.lit("a:b"), ":"), X.find_text(F.lit("ab"), ":"),
              X.json_field(F.lit('{"k": 5}'), "k"), X.contains_ci(F.lit("A Mail"), "mail"),
              X.contains_ci(F.lit("A Mail"), "a%l"))
    assert row == (2, 0, "5", True, False)
