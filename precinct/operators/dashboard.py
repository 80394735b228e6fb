"""Dashboard tables: overview, hotspots, trends, recent incidents, area profile."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precinct.functions.calendar import year_month_axis
from precinct.functions.scalars import fmt_count, fmt_pct
from precinct.operators.relational import (
    median_of_counts, recent, trend_counts, value_counts, with_area)
from precinct.schema import HIGH_SEVERITY, INCIDENTS, MISSING, MODERATE_SEVERITY, Roles, severity
from precinct.session import settle

HIGH_FACTOR = 3
TREND_CLASSES = {"theft": "THEFT", "battery": "BATTERY", "robbery": "ROBBERY"}
TREND_YEARS = (2023, 2024, 2025, 2026)


def area_counts(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Rows and outcome rows per area (records without a time are left out), NULL area included."""
    hit = F.count(F.when(F.col(roles.outcome), 1)).alias("outcomes")
    return df.filter(F.col(roles.ts).isNotNull()).groupBy(roles.area).agg(F.count("*").alias("count"), hit)


def with_risk(counts: DataFrame) -> DataFrame:
    """High from three times the median count over all areas, else Moderate."""
    threshold = median_of_counts(counts).scalar() * HIGH_FACTOR
    return counts.withColumn("risk_level", F.when(F.col("count") >= threshold, "High").otherwise("Moderate"))


def top_areas(counts: DataFrame, area: str, k: int) -> DataFrame:
    known = with_risk(counts.filter(F.col(area).isNotNull()))
    return known.orderBy(F.desc("count"), F.asc(area)).limit(k)


def hotspots(df: DataFrame, areas: DataFrame, roles: Roles = INCIDENTS, k: int = 10) -> DataFrame:
    """The areas with most incidents, labelled against all areas."""
    return with_area(top_areas(area_counts(df, roles), roles.area, k), areas, roles.area).select(
        F.col(roles.area).alias("area_id"), "area_name", "risk_level", F.col("count").alias("incident_count"),
        F.col("area_lat").alias("latitude"), F.col("area_lon").alias("longitude"))


def overview(df: DataFrame, roles: Roles = INCIDENTS, k: int = 10) -> DataFrame:
    """One row: incidents, share with the outcome flag, number of High hotspots, and their text forms.

    Everything is read off the counts per area, which are computed once.
    """
    counts = settle(area_counts(df, roles))
    high = top_areas(counts, roles.area, k).agg(F.count(F.when(F.col("risk_level") == "High", 1))).scalar()
    facts = counts.agg(F.sum("count").alias("total_incidents"), (F.sum("outcomes") / F.sum("count")).alias("arrest_rate"))
    return facts.select("total_incidents", "arrest_rate", high.alias("high_risk_zones"),
                        fmt_count(F.col("total_incidents")).alias("total_text"),
                        fmt_pct(F.round("arrest_rate", 6)).alias("rate_text"))


def trend_grid(df: DataFrame, roles: Roles = INCIDENTS, years=TREND_YEARS, classes=None) -> DataFrame:
    """Every month of the given years: availability, last date of the year, class counts.

    The months of a year are folded into one row (a map of at most twelve entries), so
    the year's last date and its months come from the same scan.
    """
    classes = classes or TREND_CLASSES
    names = (*classes, "other")
    months = trend_counts(df.filter(F.col(roles.ts).isNotNull()), roles.ts, roles.target, classes)
    entry = F.struct("month_number", F.struct(*names))
    by_year = months.groupBy("year").agg(
        F.date_format(F.max("last_record"), "yyyy-MM-dd").alias("coverage_end"),
        F.map_from_entries(F.collect_list(entry)).alias("months"))
    grid = (year_month_axis(df.sparkSession, years).join(by_year, "year", "left")
            .withColumn("m", F.element_at("months", F.col("month_number"))))
    label = F.date_format(F.make_date("year", "month_number", F.lit(1)), "MMM yyyy")
    return grid.select(label.alias("month"), "year", "month_number", F.col("m").isNotNull().alias("available"),
                       "coverage_end", *[F.coalesce(F.col("m")[c], F.lit(0).cast("long")).alias(c) for c in names])


def _trend_value(category: str, classes):
    if category == "total":
        return reduce(lambda a, b: a + b, [F.col(c) for c in (*classes, "other")])
    return F.col(category)


def trend_year_totals(grid: DataFrame, years, months: tuple[int, int] = (1, 12), category: str = "total",
                      classes=None) -> DataFrame:
    """Total per selected year over the available months of the range."""
    value = _trend_value(category, classes or TREND_CLASSES)
    chosen = grid.filter(F.col("year").isin(*years) & F.col("month_number").between(*months))
    return chosen.groupBy("year").agg(
        F.max("available").alias("available"), F.sum(F.when(F.col("available"), value).otherwise(0)).alias("total"),
        F.max(F.when(F.col("available"), F.col("coverage_end"))).alias("coverage_end"))


def trend_view(grid: DataFrame, years, months: tuple[int, int] = (1, 12), category: str = "total",
               classes=None) -> DataFrame:
    """Month by year matrix of one category; an unavailable month is NULL."""
    value = F.when(F.col("available"), _trend_value(category, classes or TREND_CLASSES))
    chosen = grid.filter(F.col("year").isin(*years) & F.col("month_number").between(*months))
    return (chosen.withColumn("value", value).groupBy("month_number").pivot("year", list(years))
            .agg(F.first("value")))


def recent_incidents(df: DataFrame, areas: DataFrame, roles: Roles = INCIDENTS, n: int = 8,
                     high=HIGH_SEVERITY, moderate=MODERATE_SEVERITY) -> DataFrame:
    """The latest incidents with area name, place, time text, severity and outcome."""
    latest = recent(df.filter(F.col(roles.ts).isNotNull()), roles.ts, roles.id, n)
    named = with_area(latest, areas, roles.area, unknown="Unknown area")
    return named.select(
        F.col(roles.case).alias("id"), F.col(roles.target).alias("type"), F.col("area_name").alias("area"),
        F.coalesce(roles.context, F.lit(MISSING)).alias("location"),
        F.date_format(roles.ts, "yyyy-MM-dd HH:mm").alias("time"),
        severity(F.col(roles.target), high, moderate).alias("severity"),
        F.coalesce(F.col(roles.outcome), F.lit(False)).alias("arrest"))


def area_profile(df: DataFrame, areas: DataFrame, roles: Roles = INCIDENTS, k: int = 3) -> DataFrame:
    """Every area of the dimension with its count, risk label and commonest classes (nested).

    Counts per area and class come from one scan; area totals are sums of them.
    """
    dated = df.filter(F.col(roles.ts).isNotNull() & F.col(roles.area).isNotNull())
    cells = value_counts(dated, roles.area, roles.target)
    order = Window.partitionBy(roles.area).orderBy(F.desc("count"), F.asc(roles.target))
    entry = F.struct("rank", F.col(roles.target).alias("type"), "count")
    grouped = (cells.withColumn("rank", F.row_number().over(order)).groupBy(roles.area)
               .agg(F.sum("count").alias("total"), F.collect_list(F.when(F.col("rank") <= k, entry)).alias("t")))
    listed = with_risk(grouped.select(roles.area, F.col("total").alias("count"), F.transform(
        F.sort_array("t"), lambda x: F.struct(x["type"].alias("type"), x["count"].alias("count"))).alias("top_crimes")))
    dim = areas.withColumnRenamed("area_id", roles.area)
    return (dim.join(listed, roles.area, "left")
            .select(F.col(roles.area).alias("area_id"), "name", F.coalesce("risk_level", F.lit("Moderate")).alias("risk_level"),
                    F.coalesce("count", F.lit(0).cast("long")).alias("incident_count"),
                    F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "district", "top_crimes"))


def map_symbols(spots: DataFrame) -> DataFrame:
    """Drawing position and radius of each hotspot (one row per area, so one window partition).

    Fixed values: frame 300 x 360, west edge -87.94, north edge 42.03, spans 0.42 and 0.39, radius 6 to 22.
    """
    largest = F.max("incident_count").over(Window.partitionBy())
    return spots.select(
        "area_id", ((F.col("longitude") + 87.94) / 0.42 * 300).alias("x"),
        ((F.lit(42.03) - F.col("latitude")) / 0.39 * 360).alias("y"),
        (F.sqrt(F.col("incident_count") / largest) * 16 + 6).alias("radius"))
