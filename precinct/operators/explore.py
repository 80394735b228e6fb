"""Exploratory tables: class balance, calendar, geography, category mix, unusual days."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.functions.calendar import calendar_axis, number_axis
from precinct.functions.predicates import between, case, coordinate_missing, missing_label
from precinct.functions.scalars import bin_centre, bin_floor, to_day, weekday0
from precinct.operators.quantiles import quantiles_and
from precinct.operators.relational import (
    argmax_row, attach_zone, coverage, cumulative_share, on_axis, pivot_matrix, share_within, union_all,
    value_counts)
from precinct.schema import INCIDENTS, WEEKDAYS, Roles
from precinct.session import settle

# Broad coordinate screen in degrees, grid width in degrees.
SCREEN_LAT, SCREEN_LON = (41, 43), (-89, -87)
GRID_DEGREES = 0.01
RARE_BELOW = 100

# The two states of a year.
FULL_YEAR, PARTIAL_YEAR = "Jan 1–Dec 31 endpoints", "Partial calendar year"

# ---------------------------------------------------------------- class balance

def class_distribution(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    return cumulative_share(value_counts(df, roles.target), roles.target)


def class_imbalance(df: DataFrame, roles: Roles = INCIDENTS, rare_below: int = RARE_BELOW) -> DataFrame:
    """One row: number of classes, extremes, their ratio, majority share, rare classes, top-five share."""
    return imbalance_of(value_counts(df, roles.target), roles.target, rare_below)


def imbalance_of(counts: DataFrame, target: str, rare_below: int = RARE_BELOW) -> DataFrame:
    """The same summary over class counts."""
    total = counts.agg(F.sum("count")).scalar()
    by_rank = F.struct((-F.col("count")).alias("c"), F.col(target).alias("t"))  # most rows first, then by name
    top5 = counts.orderBy(F.desc("count"), target).limit(5).agg(F.sum("count")).scalar()
    summary = counts.agg(F.count("*").alias("classes"), F.min(by_rank).alias("first"), F.max(by_rank).alias("last"),
                         F.min("count").alias("low"), F.max("count").alias("high"),
                         F.count(F.when(F.col("count") < rare_below, 1)).alias("classes_below_100"))
    return summary.select(
        "classes", F.col("first.t").alias("largest_class"), F.col("last.t").alias("smallest_class"),
        (F.col("high") / F.col("low")).alias("largest_smallest_ratio"),
        (F.col("high") / total * 100).alias("majority_share_pct"), "classes_below_100",
        (top5 / total * 100).alias("top_5_share_pct"))

# --------------------------------------------------------------------- calendar

def year_counts(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Rows, first and last record per year, and whether the endpoints span the year."""
    spans = coverage(df.withColumn("eda_year", F.year(roles.ts)), roles.ts, "eda_year")
    full = ((F.date_format("first_record", "MM-dd") == "01-01") & (F.date_format("last_record", "MM-dd") == "12-31"))
    return spans.withColumn("calendar_boundary_coverage", F.when(full, FULL_YEAR).otherwise(PARTIAL_YEAR))


def day_totals(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Rows per day that has any: the one scan behind all calendar tables.

    The filter states what the calendar joins would infer for one of their sides only;
    with it all sides share one shuffle.
    """
    return value_counts(df, to_day(F.col(roles.ts)).alias("day")).filter(F.col("day").isNotNull())


def matched_calendar_window(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Rows per year inside the month/day window that every year covers (upper day excluded)."""
    days = day_totals(df, roles)
    lower, upper = (matched_bounds(days).select(c).scalar() for c in ("lower", "upper"))
    month_day = F.date_format("day", "MM-dd")
    inside = F.when((month_day >= lower) & (month_day < upper), F.col("count"))
    # A conditional sum, not a filter: a filter would move below the daily counts and split the shared scan.
    return days.groupBy(F.year("day").alias("eda_year")).agg(F.sum(inside).alias("count")).filter(F.col("count") > 0)


def matched_bounds(days: DataFrame) -> DataFrame:
    """One row: latest first and earliest last month/day over the years."""
    ends = days.filter("count > 0").groupBy(F.year("day")).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return ends.agg(F.max(F.date_format("a", "MM-dd")).alias("lower"), F.min(F.date_format("b", "MM-dd")).alias("upper"))


def month_counts(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Rows per month on the complete month axis; the first and last month are flagged."""
    return months_of(day_totals(df, roles))


def months_of(days: DataFrame) -> DataFrame:
    counts = days.groupBy(F.trunc("day", "MM").alias("m")).agg(F.sum("count").alias("count")).filter(F.col("m").isNotNull())
    ends = counts.filter("count > 0").agg(F.array(F.min("m"), F.max("m"))).scalar()
    return on_axis(calendar_axis(counts, "m", "month"), counts, "m").select(
        F.date_format("m", "yyyy-MM").alias("month"), "count", F.array_contains(ends, F.col("m")).alias("boundary_month"))


def peak_month(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    return argmax_row(month_counts(df, roles), "count", "month")


def hour_counts(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    counts = value_counts(df, F.hour(roles.ts).alias("eda_hour"))
    return on_axis(number_axis(df.sparkSession, 0, 23, "eda_hour"), counts, "eda_hour")


def weekday_exposure(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Rows per weekday, calendar days observed, and rows per calendar day."""
    return weekdays_of(day_totals(df, roles))


def weekdays_of(days: DataFrame) -> DataFrame:
    weekday = weekday0(F.col("day")).alias("eda_weekday")
    exposed = (on_axis(calendar_axis(days, "day"), days, "day").groupBy(weekday)
               .agg(F.sum("count").alias("count"), F.count("*").alias("observed_calendar_days")))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    axis = number_axis(days.sparkSession, 0, 6, "eda_weekday")
    return on_axis(axis, exposed, "eda_weekday").withColumns({
        "records_per_calendar_day": F.col("count") / F.col("observed_calendar_days"),
        "weekday": names[F.col("eda_weekday")]})


def daily_counts(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    days = day_totals(df, roles)
    return on_axis(calendar_axis(days, "day"), days, "day")


def daily_iqr_flags(df: DataFrame, roles: Roles = INCIDENTS, factor: float = 1.5) -> DataFrame:
    """Daily totals with zero days, the IQR flag and the boundary flag."""
    return flags_of(day_totals(df, roles), factor)


def flags_of(days: DataFrame, factor: float = 1.5) -> DataFrame:
    """IQR flags over daily totals.  The quartiles are taken over one number per calendar day."""
    daily = on_axis(calendar_axis(days, "day"), days, "day")
    facts = daily.agg(F.percentile("count", F.array(F.lit(0.25), F.lit(0.75))).alias("q"),
                      F.min("day").alias("a"), F.max("day").alias("b"))
    bounds = facts.select(F.struct(
        (F.col("q")[0] - (F.col("q")[1] - F.col("q")[0]) * factor).alias("low"),
        (F.col("q")[1] + (F.col("q")[1] - F.col("q")[0]) * factor).alias("high"), "a", "b").alias("x")).scalar()
    n = F.col("count")
    return daily.withColumn("__x", bounds).select(
        "day", "count", ((n < F.col("__x.low")) | (n > F.col("__x.high"))).alias("flag_iqr"),
        ((F.col("day") == F.col("__x.a")) | (F.col("day") == F.col("__x.b"))).alias("boundary_day"))


def unusual_days(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    return daily_iqr_flags(df, roles).filter(F.col("flag_iqr") | (F.col("count") == 0))

# -------------------------------------------------------------------- geography

def geo_counts(df: DataFrame, code: str) -> DataFrame:
    """Rows per geographic code, NULL as its own group."""
    return value_counts(df, missing_label(F.col(code)).alias(code))


def location_counts(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    return geo_counts(df, roles.context)


def sparse_groups(df: DataFrame, roles: Roles = INCIDENTS, below: int = RARE_BELOW) -> DataFrame:
    """Per code: groups with few rows and all groups.

    All codes are counted in one scan: each row yields one (feature, group) pair per
    code, and the pairs collapse map-side.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), missing_label(F.col(c)).alias("group"))
                      for c in roles.codes])
    counts = value_counts(df.select(F.explode(pairs).alias("p")).select("p.*"), "feature", "group")
    return counts.groupBy("feature").agg(F.count(F.when(F.col("count") < below, 1)).alias("groups_below_100"),
                                         F.count("*").alias("total_groups"))


# The names of the four states.
def coordinate_state(lat: Column, lon: Column) -> Column:
    absent = coordinate_missing(lat, lon)
    on_globe = between(lat, -90, 90) & between(lon, -180, 180)
    on_screen = between(lat, *SCREEN_LAT) & between(lon, *SCREEN_LON)
    return case([(absent, "missing_or_nan"), (~on_globe, "invalid_global_range"),
                 (~on_screen, "outside_broad_screen")], "within_broad_screen")


def _with_state(df: DataFrame, roles: Roles) -> DataFrame:
    return df.withColumn("coordinate_status", coordinate_state(F.col(roles.lat), F.col(roles.lon)))


def coordinate_status(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    return value_counts(_with_state(df, roles), "coordinate_status")


def coordinate_status_by_class(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    counts = value_counts(_with_state(df, roles), roles.target, "coordinate_status")
    return share_within(counts, roles.target, "within_class_pct")


def density_grid(df: DataFrame, roles: Roles = INCIDENTS, width: float = GRID_DEGREES) -> DataFrame:
    """Rows per grid cell (screened coordinates) with the cell centre and log(1 + count)."""
    kept = _with_state(df, roles).filter(F.col("coordinate_status") == "within_broad_screen")
    cells = value_counts(kept, bin_floor(F.col(roles.lat), width).alias("lat_bin"),
                         bin_floor(F.col(roles.lon), width).alias("lon_bin"))
    return cells.withColumns({"lat_centre": bin_centre(F.col("lat_bin"), width),
                              "lon_centre": bin_centre(F.col("lon_bin"), width),
                              "log_count": F.log1p("count")})


def mapped_totals(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Rows inside and outside the density grid."""
    kept = coordinate_state(F.col(roles.lat), F.col(roles.lon)) == "within_broad_screen"
    return df.agg(F.count("*").alias("rows"), F.count(F.when(kept, 1)).alias("mapped"),
                  F.count(F.when(~kept, 1)).alias("excluded"))


def coordinate_summary(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """One row: rows, missing counts, and min / quartiles / max of both coordinates (exact), from the scans of the quantiles."""
    points = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    gaps = {f"missing_{name}": F.count_if(F.col(c).isNull()) for name, c in (("latitude", roles.lat), ("longitude", roles.lon))}
    found, counts = quantiles_and(df, [roles.lat, roles.lon], points.values(), {"rows": F.count("*"), **gaps})
    numbers = {f"{short}_{name}": F.lit(found[c][q]).cast("double") for short, c in (("lat", roles.lat), ("lon", roles.lon)) for name, q in points.items()}
    return df.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in counts.items()], *[v.alias(c) for c, v in numbers.items()])

# ----------------------------------------------------------------- category mix

def mix_field(df: DataFrame, field: str, roles: Roles = INCIDENTS) -> Column:
    """Grouping column of a mix table: ``hour``, ``weekday``, ``month`` or a column name."""
    ts = F.col(roles.ts)
    derived = {"hour": F.hour(ts), "weekday": weekday0(ts), "month": F.month(ts)}
    return missing_label(derived.get(field, F.col(field) if field in df.columns else F.lit(None)))


def category_mix(df: DataFrame, field: str, roles: Roles = INCIDENTS) -> DataFrame:
    """Class counts and class share within each group; all classes are in the denominator."""
    counts = value_counts(df, mix_field(df, field, roles).alias("group_value"), roles.target)
    return share_within(counts, "group_value", "within_group_pct")


def category_mix_all(df: DataFrame, fields, roles: Roles = INCIDENTS) -> DataFrame:
    """The mix tables of several fields in one scan (long form with a ``field`` column)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), mix_field(df, f, roles).alias("group_value"))
                      for f in fields])
    long = df.select(roles.target, F.explode(pairs).alias("p")).select(roles.target, "p.*")
    counts = value_counts(long, "field", "group_value", roles.target)
    within = Window.partitionBy("field", "group_value")
    return counts.withColumn("within_group_pct", F.col("count") / F.sum("count").over(within) * 100)


def mix_maximum(df: DataFrame, field: str, roles: Roles = INCIDENTS, classes: int = 5, groups: int = 15) -> DataFrame:
    """Highest share among the most frequent classes and groups (both read off the mix counts)."""
    mix = category_mix(df, field, roles)

    def leaders(col: str, k: int) -> DataFrame:
        totals = mix.groupBy(col).agg(F.sum("count").alias("count"))
        return totals.orderBy(F.desc("count"), col).limit(k).select(col)

    view = mix.join(leaders(roles.target, classes), roles.target, "left_semi").join(
        leaders("group_value", groups), "group_value", "left_semi")
    return view.orderBy(F.desc("within_group_pct"), "group_value", roles.target).limit(1)


def category_mix_matrix(df: DataFrame, field: str, classes, roles: Roles = INCIDENTS) -> DataFrame:
    return pivot_matrix(category_mix(df, field, roles), "group_value", roles.target, "within_group_pct", classes)


# What can be wrong with an id on two sides of which each should have it once; the first that holds counts.
ZONE_FAULTS = {"null id": "id IS NULL", "no zone": "zones = 0", "no record": "records = 0", "repeated record": "records > 1", "repeated zone": "zones > 1"}


def zone_cells(df: DataFrame, zones: DataFrame, zone_col: str = "area_group", roles: Roles = INCIDENTS) -> DataFrame:
    """(fault, class, zone, ids): both tables counted together by id, then by what they say of it.

    One scan of each table and one shuffle of (id, class, zone) serve the checks and the mix; an id that repeats, or is
    absent, collapses to one row per task before it.
    """
    target = df.schema[roles.target].dataType
    zone = zones.schema[zone_col].dataType
    both = df.select(F.col(roles.id).alias("id"), F.col(roles.target).alias("class"), F.lit(None).cast(zone).alias("zone"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        zones.select(F.col(roles.id), F.lit(None).cast(target), F.col(zone_col), F.lit(0), F.lit(1)))
    ids = both.groupBy("id").agg(F.max("class").alias("class"), F.max("zone").alias("zone"), F.sum("l").alias("records"), F.sum("r").alias("zones"))
    fault = None
    for name, condition in ZONE_FAULTS.items():
        fault = F.when(F.expr(condition), name) if fault is None else fault.when(F.expr(condition), name)
    ids = ids.withColumn("fault", fault)
    kept = lambda c: F.when(F.col("fault").isNull(), F.col(c)).alias(c)
    return ids.select("fault", kept("class"), kept("zone")).groupBy("fault", "class", "zone").agg(F.count("*").alias("ids"))


def zone_mix(df: DataFrame, zones: DataFrame | None, zone_col: str = "area_group",
             roles: Roles = INCIDENTS, check: bool = True) -> tuple[DataFrame | None, DataFrame | None, str]:
    """(class mix per zone, zone totals, status text); zones join by id, one to one and complete.

    Without ``check`` the tables are joined as they are.
    """
    if zones is None:
        return None, None, NO_ZONES
    label = missing_label(F.col("zone")).alias("zone")
    if check:
        cells = settle(zone_cells(df, zones, zone_col, roles))
        faults = {r["fault"]: r["ids"] for r in cells.filter("fault IS NOT NULL").select("fault", "ids").collect()}  # five rows at most
        if faults:
            raise ValueError(f"{roles.id} must match one to one: {faults}")
        counts = cells.groupBy(label, F.col("class").alias(roles.target)).agg(F.sum("ids").alias("count"))
    else:
        counts = value_counts(attach_zone(df.select(roles.id, roles.target), zones, zone_col, roles.id), label, roles.target)
    totals = counts.groupBy("zone").agg(F.sum("count").alias("count"))
    return share_within(counts, "zone", "within_zone_pct"), totals, f"Analysed {zone_col}."

# ------------------------------------------------------------- text and manifest

def dimension_counts(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Row counts of every exploratory dimension in one scan: (dimension, group_value, count, first, last).

    Each row yields one pair per dimension; the pairs collapse map-side, so the shuffle
    carries one row per group and map task.
    """
    ts = F.col(roles.ts)
    groups = {"class": F.col(roles.target), "day": to_day(ts).cast("string"), "hour": F.hour(ts).cast("string"),
              **{c: missing_label(F.col(c)) for c in (*roles.codes, roles.context)},
              "coordinates": coordinate_state(F.col(roles.lat), F.col(roles.lon))}
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), g.alias("group_value")) for d, g in groups.items()])
    return (df.select(ts.alias("ts"), F.explode(pairs).alias("p")).groupBy("p.dimension", "p.group_value")
            .agg(F.count("*").alias("count"), F.min("ts").alias("first_record"), F.max("ts").alias("last_record")))


NO_ZONES = "Pending: no zone table supplied."


def findings(df: DataFrame, roles: Roles = INCIDENTS, zone_status: str = NO_ZONES) -> DataFrame:
    """Ten numbered sentences filled from the aggregates of one scan (and the status that ``zone_mix`` returned)."""
    facts = settle(dimension_counts(df, roles))

    def part(dimension: str, name: str = "group_value") -> DataFrame:
        chosen = facts.filter(F.col("dimension") == dimension)
        return chosen.select(F.col("group_value").alias(name), "count", "first_record", "last_record")

    def row(n: int, text: Column, source: DataFrame) -> DataFrame:
        return source.select(F.lit(n).alias("n"), text.alias("text"))

    one = df.sparkSession.range(1)
    days = part("day").select(F.to_date("group_value").alias("day"), "count")
    balance = imbalance_of(part("class", roles.target), roles.target)
    fewest = part("class").agg(F.min("count")).scalar()
    cover = part("class").agg(F.sum("count").alias("rows"), F.min("first_record").alias("a"), F.max("last_record").alias("b"))
    hours = part("hour").select(F.col("group_value").cast("int").alias("hour"), "count")
    hour = argmax_row(hours, "count", "hour").select("hour").scalar()
    month = argmax_row(months_of(days), "count", "month").select("month").scalar()
    week = argmax_row(weekdays_of(days), "count", "eda_weekday")
    leads = [F.format_string(f"{c} %s", argmax_row(part(c), "count", "group_value").select("group_value").scalar())
             for c in roles.codes]
    flags = flags_of(days).agg(F.count(F.when(F.col("flag_iqr"), 1)).alias("flags"),
                               F.count(F.when(F.col("count") == 0, 1)).alias("zeros"))
    inside = F.coalesce(F.sum(F.when(F.col("group_value") == "within_broad_screen", F.col("count"))), F.lit(0).cast("long"))
    mapped = part("coordinates").agg(F.sum("count").alias("rows"), inside.alias("mapped"))
    return union_all(
        row(1, F.format_string(f"Coverage: %d records in {len(df.columns)} columns from %s to %s.", "rows",
                               F.date_format("a", "yyyy-MM-dd HH:mm"), F.date_format("b", "yyyy-MM-dd HH:mm")), cover),
        row(2, F.format_string("Class balance: %s holds %.2f%% of the records; %s is the smallest class with %d.",
                               "largest_class", F.round("majority_share_pct", 2), F.col("smallest_class"), fewest), balance),
        row(3, F.format_string("Rare classes: %d of %d classes have fewer than 100 records; the top five hold %.2f%%.",
                               "classes_below_100", F.col("classes"), F.round("top_5_share_pct", 2)), balance),
        row(4, F.format_string("Comparable window: %s inclusive to %s exclusive in every year.", "lower", F.col("upper")),
            matched_bounds(days)),
        row(5, F.concat(F.lit("Peaks: month "), month, F.format_string(", hour %02d:00.", hour)), one),
        row(6, F.format_string("Weekdays: %s has the largest total (%d records).", "weekday", F.col("count")), week),
        row(7, F.concat(F.lit("Largest geographic groups: "), F.concat_ws("; ", *leads), F.lit(".")), one),
        row(8, F.format_string("Coordinates: %d of %d records (%.2f%%) enter the density grid, %d do not.", "mapped", F.col("rows"),
                               F.round(F.col("mapped") / F.col("rows") * 100, 2), F.col("rows") - F.col("mapped")), mapped),
        row(9, F.format_string("Context: %s is the most frequent location (%d records).", "group_value", F.col("count")),
            argmax_row(part(roles.context), "count", "group_value")),
        row(10, F.format_string("Review: %d flagged days and %d days without records. Zones: %s", "flags", F.col("zeros"), F.lit(zone_status)), flags))


def run_manifest(df: DataFrame, run_id: str, source: str, version: int, outputs, roles: Roles = INCIDENTS,
                 zone_status: str = NO_ZONES) -> DataFrame:
    """One row describing the run: source, version, settings, what was seen, class imbalance, zone status, outputs.

    One scan: rows are counted per class with their first and last time, all else follows from these few rows.
    """
    spark = df.sparkSession
    classes = settle(coverage(df, roles.ts, roles.target))
    seen = classes.agg(F.sum("count").alias("rows"), F.min("first_record").alias("first_record"), F.max("last_record").alias("last_record"))
    balance = imbalance_of(classes, roles.target)
    imbalance = balance.select(F.struct(*balance.columns)).scalar().alias("class_imbalance")
    return seen.select(
        F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), F.lit(version).alias("source_version"),
        F.lit(spark.version).alias("spark_version"), F.lit(spark.conf.get("spark.sql.session.timeZone")).alias("time_zone"),
        "rows", F.lit(len(df.columns)).alias("columns"), "first_record", "last_record", imbalance, F.lit(zone_status).alias("zone_status"),
        F.array(*[F.lit(o) for o in outputs]).alias("outputs"), F.lit(GRID_DEGREES).alias("grid_degrees"),
        F.array(*[F.lit(v) for v in SCREEN_LAT]).alias("latitude_screen"), F.array(*[F.lit(v) for v in SCREEN_LON]).alias("longitude_screen"))
