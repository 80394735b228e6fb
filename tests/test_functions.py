import datetime as dt

import pytest
from pyspark.sql import functions as F

from precinct.functions import calendar, predicates, scalars
from conftest import rows_of


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_matching_dates_are_all_saturdays_of_the_month(spark):
    got = one(spark, calendar.matching_dates(F.lit(2026), F.lit(7), calendar.weekday_number(F.lit("Saturday")), F.lit(23)))[0]
    assert got == [dt.datetime(2026, 7, d, 23) for d in (4, 11, 18, 25)]


def test_month_with_five_saturdays_and_leap_february(spark):
    dates = one(spark, calendar.matching_dates(F.lit(2026), F.lit(8), F.lit(5), F.lit(0)),
                calendar.matching_dates(F.lit(2024), F.lit(2), F.lit(3), F.lit(0)))
    assert [d.day for d in dates[0]] == [1, 8, 15, 22, 29]
    assert [d.day for d in dates[1]] == [1, 8, 15, 22, 29]


def test_first_matching_date_is_the_first_of_all(spark):
    got = one(spark, calendar.first_matching_date(F.lit(2026), F.lit(7), F.lit(5), F.lit(23)))[0]
    assert got == dt.datetime(2026, 7, 4, 23)


def test_unknown_weekday_name_has_no_number(spark):
    assert one(spark, calendar.weekday_number(F.lit("Funday")), calendar.weekday_number(F.lit("Monday"))) == (None, 0)


def test_grid_cell_opens_on_exact_multiples(spark):
    rows = spark.createDataFrame([(41.600, -87.600), (41.605, -87.606), (None, -87.6)], "a double, b double")
    got = [r[0] for r in rows.select(scalars.grid_cell(F.col("a"), F.col("b"))).collect()]
    assert got == ["8320_-14600", "8321_-14601", "Unknown"]


@pytest.mark.parametrize("text, value", [("true", True), ("TRUE ", True), ("1.0", True), ("0", False), (None, False)])
def test_parse_bool(spark, text, value):
    assert one(spark, predicates.parse_bool(F.lit(text).cast("string")))[0] is value


def test_finite_and_range_checks(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    x = F.col("x")
    assert rows_of(df.select(predicates.is_finite(x))) == [(True,), (False,), (False,), (None,)]
    assert rows_of(df.select(predicates.out_of_range(x, 2, 3))) == [(True,), (True,), (True,), (False,)]


def test_code_text_normalises_numbers_and_marks_the_rest(spark):
    df = spark.createDataFrame([("7",), ("7.0",), ("x",), (None,)], "c string")
    assert rows_of(df.select(scalars.code_text(F.col("c")))) == [("7",), ("7",), ("Unknown",), ("Unknown",)]


def test_row_hash_separates_shifted_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert df.select(scalars.row_hash(F.col("x"), F.col("y"))).distinct().count() == 2


def test_argmax_takes_the_first_among_equals(spark):
    assert one(spark, scalars.argmax(F.array(F.lit(0.1), F.lit(0.4), F.lit(0.4))))[0] == 1


def test_formats(spark):
    got = one(spark, scalars.fmt_count(F.lit(662472)), scalars.fmt_pct(F.lit(0.1234)), scalars.zero_pad(F.lit(7)),
              scalars.title(F.lit("MOTOR VEHICLE THEFT")), scalars.prefix(F.lit("CRIMINAL DAMAGE"), 12))
    assert tuple(got) == ("662,472", "12.3%", "07", "Motor Vehicle Theft", "CRIMINAL DAM")


def test_dirty_codes_flags_and_white_space(spark):
    from precinct.functions import predicates
    nan = F.lit("nan")
    assert one(spark, scalars.code_text(nan), scalars.code_text(F.lit("1e30")), scalars.code_text(F.lit(" 12.0 ")))[:2] == ("Unknown", "Unknown")
    assert one(spark, scalars.norm_text(F.lit("\tshop \xa0\n")), predicates.blank_or_null(F.lit("\t\x0b")), scalars.not_nan(F.lit(float("nan")))) == ("SHOP", True, None)
