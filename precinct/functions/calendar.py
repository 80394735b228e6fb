"""Calendar axes and date matching."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.schema import WEEKDAYS


def calendar_axis(days: DataFrame, day: str = "day", unit: str = "day") -> DataFrame:
    """Every day or month start from the first to the last counted day, under the same name.

    ``days`` holds ``day`` and its ``count``.  The count stays in the plan, so the axis
    reuses the shuffle of the daily counts and the records are scanned once.
    """
    span = days.agg(F.min(day).alias("a"), F.max(day).alias("b"), F.sum("count").alias("n")).filter("n > 0")
    ends = [F.trunc(c, "MM") if unit == "month" else F.col(c) for c in ("a", "b")]
    step = F.expr("INTERVAL 1 MONTH" if unit == "month" else "INTERVAL 1 DAY")
    return span.select(F.explode(F.sequence(*ends, step)).alias(day))


def number_axis(spark: SparkSession, low: int, high: int, name: str) -> DataFrame:
    """Whole numbers ``low``..``high`` inclusive as an int column."""
    return spark.range(low, high + 1, 1, 1).select(F.col("id").cast("int").alias(name))


def year_month_axis(spark: SparkSession, years) -> DataFrame:
    """All twelve months of the given years."""
    listed = F.array(*[F.lit(int(y)) for y in years])
    months = F.sequence(F.lit(1), F.lit(12))
    return (spark.range(1).select(F.explode(listed).alias("year"))
            .select("year", F.explode(months).alias("month_number")))


def weekday_number(name: Column) -> Column:
    """Position of a weekday name, Monday = 0; NULL when it is not a weekday name."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return F.nullif(F.array_position(names, name), F.lit(0)).cast("int") - F.lit(1)


def first_matching_date(year: Column, month: Column, weekday: Column, hour: Column) -> Column:
    """First date of the month that falls on the weekday (Monday = 0), at the hour."""
    return F.element_at(matching_dates(year, month, weekday, hour), 1)


def matching_dates(year: Column, month: Column, weekday: Column, hour: Column) -> Column:
    """All dates of the month that fall on the weekday, at the hour (array of timestamps)."""
    first = F.make_date(year, month, F.lit(1))
    start = F.date_add(first, F.pmod(weekday - F.weekday(first), F.lit(7)))
    days = F.sequence(start, F.last_day(first), F.expr("INTERVAL 7 DAY"))
    shift = F.make_dt_interval(F.lit(0), hour)
    return F.transform(days, lambda d: d.cast("timestamp_ntz") + shift)
