"""Exploratory and dashboard tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from precinct.operators import dashboard, explore
from precinct.operators.features import add_area_group, fit_medians
from precinct.operators.relational import top_k_per_group
from precinct.operators.splits import time_split
from precinct.plans.common import AREAS_SQL, CLASSES, over, query, r6, union_sql
from precinct.plans.quality_queries import AREA_GROUP, MEDIANS
from precinct.schema import area_dimension
from precinct.sources.testviews import (
    EVENT_ROLES, TRAIN_END, VALIDATION_END, VIEW_HIGH, VIEW_MODERATE, VIEW_TREND, incidents, load)

YEARS = (1994, 1995, 1996, 1997, 1998, 1999, 2000, 2001)

CNT = 'SELECT primary_type, count(*) AS n FROM inc GROUP BY 1'


@query("class_distribution", over(
    f'SELECT primary_type, n AS "count", {r6("n / (sum(n) OVER ()) * 100")} AS share_pct, '
    f'{r6("sum(n) OVER (ORDER BY n DESC, primary_type) / (sum(n) OVER ()) * 100")} AS cumulative_pct FROM c', c=CNT))
def class_distribution(spark, folder):
    return explore.class_distribution(incidents(spark, folder))


IMBALANCE_SQL = f"""SELECT count(*) AS classes,
  (SELECT primary_type FROM c ORDER BY n DESC, primary_type LIMIT 1) AS largest_class,
  (SELECT primary_type FROM c ORDER BY n, primary_type DESC LIMIT 1) AS smallest_class,
  {r6('max(n) / min(n)')} AS largest_smallest_ratio, {r6('max(n) / sum(n) * 100')} AS majority_share_pct,
  count(CASE WHEN n < 100 THEN 1 END) AS classes_below_100,
  {r6('(SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC LIMIT 5)) / sum(n) * 100')} AS top_5_share_pct FROM c"""


@query("class_imbalance", over(IMBALANCE_SQL, c=CNT))
def class_imbalance(spark, folder):
    return explore.class_imbalance(incidents(spark, folder))


@query("coverage_by_year", over(
    'SELECT CAST(year(date) AS INT) AS eda_year, min(date) AS first_record, max(date) AS last_record, count(*) AS "count", '
    "CASE WHEN strftime(min(date), '%m-%d') = '01-01' AND strftime(max(date), '%m-%d') = '12-31' "
    f"THEN '{explore.FULL_YEAR}' ELSE '{explore.PARTIAL_YEAR}' END AS calendar_boundary_coverage FROM inc GROUP BY 1"))
def coverage_by_year(spark, folder):
    return explore.year_counts(incidents(spark, folder))


WINDOW = ("SELECT max(a) AS lo, min(b) AS hi FROM (SELECT year(date) AS y, strftime(min(date), '%m-%d') AS a, "
          "strftime(max(date), '%m-%d') AS b FROM inc GROUP BY 1)")


@query("matched_calendar_window", over(
    'SELECT CAST(year(date) AS INT) AS eda_year, count(*) AS "count" FROM inc, w '
    "WHERE strftime(date, '%m-%d') >= lo AND strftime(date, '%m-%d') < hi GROUP BY 1", w=WINDOW))
def matched_calendar_window(spark, folder):
    return explore.matched_calendar_window(incidents(spark, folder))


def month_sql(table: str, ts: str) -> str:
    return f"""WITH {table_cte(table)}span AS (SELECT min({ts}) AS a, max({ts}) AS b FROM {table}),
axis AS (SELECT strftime(m, '%Y-%m') AS month FROM span, generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH) g(m)),
c AS (SELECT strftime({ts}, '%Y-%m') AS month, count(*) AS n FROM {table} GROUP BY 1)
SELECT axis.month, coalesce(n, 0) AS "count", axis.month = strftime(a, '%Y-%m') OR axis.month = strftime(b, '%Y-%m') AS boundary_month
FROM span, axis LEFT JOIN c ON axis.month = c.month"""


def table_cte(table: str) -> str:
    from precinct.plans.common import INC
    return f"inc AS ({INC}), " if table == "inc" else ""


@query("month_counts", month_sql("inc", "date"))
def month_counts(spark, folder):
    return explore.month_counts(incidents(spark, folder))


@query("month_counts_events", month_sql("events", "ts"))
def month_counts_events(spark, folder):
    return explore.month_counts(load(spark, folder, "events"), EVENT_ROLES)


@query("peak_month", over(
    "SELECT strftime(date, '%Y-%m') AS month, count(*) AS \"count\", strftime(date, '%Y-%m') IN "
    "((SELECT strftime(min(date), '%Y-%m') FROM inc), (SELECT strftime(max(date), '%Y-%m') FROM inc)) AS boundary_month "
    "FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"))
def peak_month(spark, folder):
    return explore.peak_month(incidents(spark, folder))


HOURS = """SELECT CAST(h AS INT) AS eda_hour, coalesce(n, 0) AS "count" FROM generate_series(0, 23) g(h)
LEFT JOIN (SELECT hour({ts}) AS k, count(*) AS n FROM {t} GROUP BY 1) c ON h = k"""


@query("hour_counts", over(HOURS.format(ts="date", t="inc")))
def hour_counts(spark, folder):
    return explore.hour_counts(incidents(spark, folder))


@query("hour_counts_events", HOURS.format(ts="ts", t="events"))
def hour_counts_events(spark, folder):
    return explore.hour_counts(load(spark, folder, "events"), EVENT_ROLES)


def weekday_sql(table: str, ts: str) -> str:
    return f"""WITH {table_cte(table)}span AS (SELECT CAST(min({ts}) AS DATE) AS a, CAST(max({ts}) AS DATE) AS b FROM {table}),
d AS (SELECT isodow(x) - 1 AS k, count(*) AS n FROM span, generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY) g(x) GROUP BY 1),
c AS (SELECT isodow({ts}) - 1 AS k, count(*) AS n FROM {table} GROUP BY 1)
SELECT CAST(w AS INT) AS eda_weekday, coalesce(c.n, 0) AS "count", d.n AS observed_calendar_days,
  {r6('coalesce(c.n, 0) / d.n')} AS records_per_calendar_day,
  ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][w + 1] AS weekday
FROM generate_series(0, 6) g(w) LEFT JOIN c ON w = c.k LEFT JOIN d ON w = d.k"""


@query("weekday_exposure", weekday_sql("inc", "date"))
def weekday_exposure(spark, folder):
    return explore.weekday_exposure(incidents(spark, folder))


@query("weekday_exposure_events", weekday_sql("events", "ts"))
def weekday_exposure_events(spark, folder):
    return explore.weekday_exposure(load(spark, folder, "events"), EVENT_ROLES)


def daily_sql(table: str, ts: str, only_unusual: bool = False) -> str:
    where = "WHERE n < q1 - 1.5 * (q3 - q1) OR n > q3 + 1.5 * (q3 - q1) OR n = 0" if only_unusual else ""
    return f"""WITH {table_cte(table)}span AS (SELECT CAST(min({ts}) AS DATE) AS a, CAST(max({ts}) AS DATE) AS b FROM {table}),
c AS (SELECT CAST({ts} AS DATE) AS day, count(*) AS n FROM {table} GROUP BY 1),
daily AS (SELECT CAST(x AS DATE) AS day, coalesce(n, 0) AS n, CAST(x AS DATE) = a OR CAST(x AS DATE) = b AS boundary_day
  FROM span, generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY) g(x) LEFT JOIN c ON CAST(x AS DATE) = c.day),
q AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM daily)
SELECT day, n AS "count", n < q1 - 1.5 * (q3 - q1) OR n > q3 + 1.5 * (q3 - q1) AS flag_iqr, boundary_day FROM daily, q {where}"""


@query("daily_iqr_flags", daily_sql("inc", "date"))
def daily_iqr_flags(spark, folder):
    return explore.daily_iqr_flags(incidents(spark, folder))


@query("daily_iqr_flags_events", daily_sql("events", "ts"))
def daily_iqr_flags_events(spark, folder):
    return explore.daily_iqr_flags(load(spark, folder, "events"), EVENT_ROLES)


@query("unusual_days", daily_sql("inc", "date", only_unusual=True))
def unusual_days(spark, folder):
    return explore.unusual_days(incidents(spark, folder))


def _geo(code: str):
    @query(f"geo_counts_{code}", over(
        f"SELECT coalesce(CAST({code} AS VARCHAR), '[MISSING]') AS {code}, count(*) AS \"count\" FROM inc GROUP BY 1"))
    def counts(spark, folder):
        return explore.geo_counts(incidents(spark, folder), code)


for _code in ("district", "ward", "community_area", "beat"):
    _geo(_code)


@query("location_counts", over(
    "SELECT coalesce(location_description, '[MISSING]') AS location_description, count(*) AS \"count\" FROM inc GROUP BY 1"))
def location_counts(spark, folder):
    return explore.location_counts(incidents(spark, folder))


@query("sparse_groups", over(union_sql(
    f"SELECT '{c}' AS feature, count(CASE WHEN n < 100 THEN 1 END) AS groups_below_100, count(*) AS total_groups "
    f"FROM (SELECT {c}, count(*) AS n FROM inc GROUP BY 1)" for c in ("beat", "district", "ward", "community_area"))))
def sparse_groups(spark, folder):
    return explore.sparse_groups(incidents(spark, folder))


STATE = """CASE WHEN latitude IS NULL OR longitude IS NULL OR isnan(latitude) OR isnan(longitude) THEN 'missing_or_nan'
  WHEN NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) THEN 'invalid_global_range'
  WHEN NOT (latitude BETWEEN 41 AND 43 AND longitude BETWEEN -89 AND -87) THEN 'outside_broad_screen'
  ELSE 'within_broad_screen' END"""


@query("coordinate_status", over(f'SELECT {STATE} AS coordinate_status, count(*) AS "count" FROM inc GROUP BY 1'))
def coordinate_status(spark, folder):
    return explore.coordinate_status(incidents(spark, folder))


@query("coordinate_status_by_class", over(
    f'SELECT primary_type, coordinate_status, n AS "count", {r6("n / (sum(n) OVER (PARTITION BY primary_type)) * 100")} AS within_class_pct '
    "FROM c", c=f"SELECT primary_type, {STATE} AS coordinate_status, count(*) AS n FROM inc GROUP BY 1, 2"))
def coordinate_status_by_class(spark, folder):
    return explore.coordinate_status_by_class(incidents(spark, folder))


@query("density_grid", over(f"""SELECT lat_bin, lon_bin, n AS "count", {r6('(lat_bin + 0.5) * 0.01')} AS lat_centre,
  {r6('(lon_bin + 0.5) * 0.01')} AS lon_centre, {r6('ln(1 + n)')} AS log_count FROM
  (SELECT CAST(floor(latitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS lat_bin,
   CAST(floor(longitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS lon_bin, count(*) AS n
   FROM inc WHERE {STATE} = 'within_broad_screen' GROUP BY 1, 2)"""))
def density_grid(spark, folder):
    return explore.density_grid(incidents(spark, folder))


@query("mapped_totals", over(
    f'SELECT count(*) AS "rows", count(CASE WHEN {STATE} = \'within_broad_screen\' THEN 1 END) AS mapped, '
    f"count(CASE WHEN {STATE} <> 'within_broad_screen' THEN 1 END) AS excluded FROM inc"))
def mapped_totals(spark, folder):
    return explore.mapped_totals(incidents(spark, folder))


@query("coordinate_summary", over(
    'SELECT count(*) AS "rows", count(*) - count(latitude) AS missing_latitude, count(*) - count(longitude) AS missing_longitude, '
    + ", ".join(f"{r6(f'quantile_cont({c}, {q})')} AS {s}_{n}" for s, c in (("lat", "latitude"), ("lon", "longitude"))
                for n, q in (("min", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1))) + " FROM inc"))
def coordinate_summary(spark, folder):
    return explore.coordinate_summary(incidents(spark, folder))


MIX_FIELDS = {"hour": "hour(date)", "weekday": "isodow(date) - 1", "month": "month(date)", "district": "district",
              "community_area": "community_area", "location_description": "location_description", "domestic": "domestic"}
MIX_NAMES = {"community_area": "area", "location_description": "location"}


def _mix_counts(expression: str) -> str:
    return (f"SELECT coalesce(CAST({expression} AS VARCHAR), '[MISSING]') AS group_value, primary_type, count(*) AS n "
            "FROM inc GROUP BY 1, 2")


WITHIN = f'n AS "count", {r6("n / (sum(n) OVER (PARTITION BY group_value)) * 100")} AS within_group_pct'


def _mix(field: str, expression: str):
    @query(f"category_mix_{MIX_NAMES.get(field, field)}", over(
        f"SELECT group_value, primary_type, {WITHIN} FROM c", c=_mix_counts(expression)))
    def mix(spark, folder):
        return explore.category_mix(incidents(spark, folder), field)


for _field, _expression in MIX_FIELDS.items():
    _mix(_field, _expression)


@query("category_mix_all", over(union_sql(
    f"SELECT '{f}' AS field, group_value, primary_type, {WITHIN} FROM ({_mix_counts(e)})" for f, e in MIX_FIELDS.items())))
def category_mix_all(spark, folder):
    return explore.category_mix_all(incidents(spark, folder), list(MIX_FIELDS))


@query("category_mix_hour_events", f"""SELECT group_value, event_type, {WITHIN} FROM
  (SELECT CAST(hour(ts) AS VARCHAR) AS group_value, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def category_mix_hour_events(spark, folder):
    return explore.category_mix(load(spark, folder, "events"), "hour", EVENT_ROLES)


@query("mix_maximum_area", over(
    f"""SELECT * FROM (SELECT group_value, primary_type, {WITHIN} FROM c)
WHERE primary_type IN (SELECT primary_type FROM inc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
  AND group_value IN (SELECT group_value FROM c GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 15)
ORDER BY within_group_pct DESC, group_value, primary_type LIMIT 1""", c=_mix_counts("community_area")))
def mix_maximum_area(spark, folder):
    return explore.mix_maximum(incidents(spark, folder), "community_area")


@query("category_mix_matrix", over(
    "SELECT group_value, " + ", ".join(
        f"coalesce(max(CASE WHEN primary_type = '{c}' THEN p END), 0) AS \"{c}\"" for c in CLASSES)
    + f" FROM (SELECT group_value, primary_type, {r6('n / (sum(n) OVER (PARTITION BY group_value)) * 100')} AS p FROM c) GROUP BY 1",
    c=_mix_counts("location_description")))
def category_mix_matrix(spark, folder):
    return explore.category_mix_matrix(incidents(spark, folder), "location_description", CLASSES)


ZONES = f"SELECT unique_key, primary_type, {AREA_GROUP} AS zone FROM inc, m"


def _zones(spark, folder):
    inc = incidents(spark, folder)
    train, _, _ = time_split(inc, TRAIN_END, VALIDATION_END)
    zones = add_area_group(inc, *fit_medians(train)).select("unique_key", "area_group")
    return explore.zone_mix(inc, zones)


@query("zone_mix", over(
    f'SELECT zone, primary_type, n AS "count", {r6("n / (sum(n) OVER (PARTITION BY zone)) * 100")} AS within_zone_pct FROM c',
    m=MEDIANS, z=ZONES, c="SELECT zone, primary_type, count(*) AS n FROM z GROUP BY 1, 2"))
def zone_mix(spark, folder):
    return _zones(spark, folder)[0]


@query("zone_totals", over('SELECT zone, count(*) AS "count" FROM z GROUP BY 1', m=MEDIANS, z=ZONES))
def zone_totals(spark, folder):
    return _zones(spark, folder)[1]


def _lead(code: str) -> str:
    return (f"'{code} ' || (SELECT k FROM (SELECT coalesce(CAST({code} AS VARCHAR), '[MISSING]') AS k, count(*) AS n "
            "FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1))")


FINDINGS_SQL = over(
    union_sql([
        "SELECT 1 AS n, format('Coverage: {} records in 14 columns from {} to {}.', count(*), "
        "strftime(min(date), '%Y-%m-%d %H:%M'), strftime(max(date), '%Y-%m-%d %H:%M')) AS text FROM inc",
        "SELECT 2, printf('Class balance: %s holds %.2f%% of the records; %s is the smallest class with %d.', largest_class, "
        "round(majority_share_pct, 2), smallest_class, (SELECT min(n) FROM c)) FROM b",
        "SELECT 3, printf('Rare classes: %d of %d classes have fewer than 100 records; the top five hold %.2f%%.', "
        "classes_below_100, classes, round(top_5_share_pct, 2)) FROM b",
        "SELECT 4, printf('Comparable window: %s inclusive to %s exclusive in every year.', lo, hi) FROM w",
        "SELECT 5, printf('Peaks: month %s, hour %02d:00.', "
        "(SELECT strftime(date, '%Y-%m') AS m FROM inc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
        "(SELECT hour(date) AS h FROM inc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))",
        "SELECT 6, printf('Weekdays: %s has the largest total (%d records).', dayname(min(date)), count(*)) FROM inc "
        "WHERE isodow(date) = (SELECT isodow(date) AS k FROM inc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
        "SELECT 7, 'Largest geographic groups: ' || concat_ws('; ', "
        + ", ".join(_lead(c) for c in ("beat", "district", "ward", "community_area")) + ") || '.'",
        f"SELECT 8, printf('Coordinates: %d of %d records (%.2f%%) enter the density grid, %d do not.', "
        f"count(CASE WHEN {STATE} = 'within_broad_screen' THEN 1 END), count(*), "
        f"round(count(CASE WHEN {STATE} = 'within_broad_screen' THEN 1 END) / count(*) * 100, 2), "
        f"count(CASE WHEN {STATE} <> 'within_broad_screen' THEN 1 END)) FROM inc",
        "SELECT 9, printf('Context: %s is the most frequent location (%d records).', k, n) FROM (SELECT "
        "coalesce(location_description, '[MISSING]') AS k, count(*) AS n FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)",
        "SELECT 10, printf('Review: %d flagged days and %d days without records. Zones: Analysed area_group.', count(CASE WHEN flag_iqr THEN 1 END), "
        "count(CASE WHEN \"count\" = 0 THEN 1 END)) FROM dd",
    ]), c=CNT, b=IMBALANCE_SQL, w=WINDOW, dd=daily_sql("inc", "date"))


@query("findings", FINDINGS_SQL)
def findings(spark, folder):
    return explore.findings(incidents(spark, folder), zone_status="Analysed area_group.")


DIMENSIONS = {"class": "primary_type", "day": "CAST(CAST(date AS DATE) AS VARCHAR)", "hour": "CAST(hour(date) AS VARCHAR)",
              **{c: f"coalesce(CAST({c} AS VARCHAR), '[MISSING]')" for c in
                 ("beat", "district", "ward", "community_area", "location_description")}, "coordinates": STATE}


@query("dimension_counts", over(union_sql(
    f"SELECT '{d}' AS dimension, {e} AS group_value, count(*) AS \"count\", min(date) AS first_record, max(date) AS last_record "
    "FROM inc GROUP BY 2" for d, e in DIMENSIONS.items())))
def dimension_counts(spark, folder):
    return explore.dimension_counts(incidents(spark, folder))


@query("top_classes_per_area", over(
    'SELECT community_area, primary_type, n AS "count", CAST(rn AS INT) AS rank FROM (SELECT community_area, primary_type, '
    "count(*) AS n, row_number() OVER (PARTITION BY community_area ORDER BY count(*) DESC, primary_type) AS rn FROM inc "
    "GROUP BY 1, 2) WHERE rn <= 3"))
def top_classes_per_area(spark, folder):
    return top_k_per_group(incidents(spark, folder), "community_area", "primary_type", 3)


@query("run_manifest", over(
    "SELECT 'run-1' AS run_id, 'incident view' AS source, CAST(1 AS INT) AS source_version, (SELECT count(*) FROM inc) AS \"rows\", CAST(14 AS INT) AS columns, "
    "(SELECT min(date) FROM inc) AS first_record, (SELECT max(date) FROM inc) AS last_record, b.*, 'Analysed area_group.' AS zone_status, "
    "'class_distribution,zone_mix' AS outputs, CAST(0.01 AS DOUBLE) AS grid_degrees, '41,43' AS latitude_screen, '-89,-87' AS longitude_screen FROM b",
    c=CNT, b=IMBALANCE_SQL))
def run_manifest(spark, folder):
    """The manifest without the version of Spark and the session's time zone, flat."""
    found = explore.run_manifest(incidents(spark, folder), "run-1", "incident view", 1, ["class_distribution", "zone_mix"], zone_status="Analysed area_group.")
    flat = found.select("*", "class_imbalance.*").drop("class_imbalance", "spark_version", "time_zone")
    return flat.withColumns({c: F.array_join(c, ",") for c in ("outputs", "latitude_screen", "longitude_screen")})

# -------------------------------------------------------------------- dashboard

AREA_N = "SELECT community_area AS k, count(*) AS n FROM inc WHERE community_area IS NOT NULL GROUP BY 1"
RISK = "SELECT k, n, CASE WHEN n >= 3 * (SELECT median(n) FROM an) THEN 'High' ELSE 'Moderate' END AS risk_level FROM an"
HOT = "SELECT * FROM risk ORDER BY n DESC, k LIMIT 10"


@query("hotspots", over(
    "SELECT k AS area_id, coalesce(name, 'Area ' || k) AS area_name, risk_level, n AS incident_count, "
    f"{r6('coalesce(lat, 41.85)')} AS latitude, {r6('coalesce(lon, -87.65)')} AS longitude "
    "FROM hot LEFT JOIN areas ON k = area_id", an=AREA_N, risk=RISK, hot=HOT, areas=AREAS_SQL))
def hotspots(spark, folder):
    return dashboard.hotspots(incidents(spark, folder), area_dimension(spark))


@query("overview", over(
    f"SELECT count(*) AS total_incidents, {r6('avg(CASE WHEN arrest THEN 1 ELSE 0 END)')} AS arrest_rate, "
    "(SELECT count(CASE WHEN risk_level = 'High' THEN 1 END) FROM hot) AS high_risk_zones, "
    "format('{:,}', count(*)) AS total_text, "
    "printf('%.1f%%', round(avg(CASE WHEN arrest THEN 1 ELSE 0 END), 6) * 100) AS rate_text FROM inc",
    an=AREA_N, risk=RISK, hot=HOT))
def overview(spark, folder):
    return dashboard.overview(incidents(spark, folder))


YEAR_LIST = ", ".join(str(y) for y in YEARS)
GRID = f"""SELECT strftime(make_date(y, m, 1), '%b %Y') AS month, CAST(y AS INT) AS year, CAST(m AS INT) AS month_number,
  c.k1 IS NOT NULL AS available, e.coverage_end, coalesce(urgent, 0) AS urgent, coalesce(high, 0) AS high,
  coalesce(medium, 0) AS medium, coalesce(other, 0) AS other
FROM (SELECT unnest([{YEAR_LIST}]) AS y) CROSS JOIN generate_series(1, 12) g(m)
LEFT JOIN (SELECT year(date) AS k1, month(date) AS k2, count(*) FILTER (primary_type = '1-URGENT') AS urgent,
  count(*) FILTER (primary_type = '2-HIGH') AS high, count(*) FILTER (primary_type = '3-MEDIUM') AS medium,
  count(*) FILTER (primary_type NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS other FROM inc GROUP BY 1, 2) c
  ON y = c.k1 AND m = c.k2
LEFT JOIN (SELECT year(date) AS k, strftime(max(date), '%Y-%m-%d') AS coverage_end FROM inc GROUP BY 1) e ON y = e.k"""


def _grid(spark, folder):
    return dashboard.trend_grid(incidents(spark, folder), years=YEARS, classes=VIEW_TREND)


@query("trend_grid", over("SELECT * FROM grid", grid=GRID))
def trend_grid(spark, folder):
    return _grid(spark, folder)


@query("trend_view", over(
    "SELECT month_number, " + ", ".join(
        f'max(CASE WHEN year = {y} AND available THEN urgent + high + medium + other END) AS "{y}"' for y in (1999, 2000, 2001))
    + " FROM grid WHERE year IN (1999, 2000, 2001) AND month_number BETWEEN 3 AND 10 GROUP BY 1", grid=GRID))
def trend_view(spark, folder):
    return dashboard.trend_view(_grid(spark, folder), (1999, 2000, 2001), (3, 10), classes=VIEW_TREND)


@query("trend_year_totals", over(
    "SELECT year, bool_or(available) AS available, CAST(sum(CASE WHEN available THEN high ELSE 0 END) AS BIGINT) AS total, "
    "max(CASE WHEN available THEN coverage_end END) AS coverage_end FROM grid WHERE year IN (1994, 1999, 2000) "
    "AND month_number BETWEEN 3 AND 10 GROUP BY 1", grid=GRID))
def trend_year_totals(spark, folder):
    return dashboard.trend_year_totals(_grid(spark, folder), (1994, 1999, 2000), (3, 10), "high", VIEW_TREND)


@query("recent_incidents", over(
    "SELECT case_number AS id, primary_type AS type, coalesce(name, 'Unknown area') AS area, "
    "coalesce(location_description, '[MISSING]') AS location, strftime(date, '%Y-%m-%d %H:%M') AS time, "
    "CASE WHEN primary_type = '1-URGENT' THEN 'High' WHEN primary_type IN ('2-HIGH', '3-MEDIUM') THEN 'Moderate' ELSE 'Low' END "
    "AS severity, arrest FROM (SELECT * FROM inc ORDER BY date DESC, unique_key LIMIT 8) "
    "LEFT JOIN areas ON community_area = area_id", areas=AREAS_SQL))
def recent_incidents(spark, folder):
    return dashboard.recent_incidents(incidents(spark, folder), area_dimension(spark),
                                      high=VIEW_HIGH, moderate=VIEW_MODERATE)


@query("area_profile_top3", over(
    "SELECT area_id, name, coalesce(risk_level, 'Moderate') AS risk_level, coalesce(r.n, 0) AS incident_count, "
    f"{r6('lat')} AS latitude, {r6('lon')} AS longitude, district, CAST(rn - 1 AS INT) AS position, t.primary_type AS type, t.n AS type_count "
    "FROM areas LEFT JOIN risk r ON area_id = r.k LEFT JOIN (SELECT * FROM (SELECT community_area, primary_type, count(*) AS n, "
    "row_number() OVER (PARTITION BY community_area ORDER BY count(*) DESC, primary_type) AS rn FROM inc GROUP BY 1, 2) "
    "WHERE rn <= 3) t ON area_id = t.community_area", an=AREA_N, risk=RISK, areas=AREAS_SQL))
def area_profile_top3(spark, folder):
    profile = dashboard.area_profile(incidents(spark, folder), area_dimension(spark))
    kept = [c for c in profile.columns if c != "top_crimes"]
    return (profile.select(*kept, F.posexplode_outer("top_crimes").alias("position", "t"))
            .select(*kept, "position", F.col("t.type").alias("type"), F.col("t.count").alias("type_count")))


@query("map_symbols", over(
    f"SELECT k AS area_id, {r6('(lon + 87.94) / 0.42 * 300')} AS x, {r6('(42.03 - lat) / 0.39 * 360')} AS y, "
    f"{r6('6 + sqrt(n / (max(n) OVER ())) * 16')} AS radius FROM hot JOIN areas ON k = area_id",
    an=AREA_N, risk=RISK, hot=HOT, areas=AREAS_SQL))
def map_symbols(spark, folder):
    return dashboard.map_symbols(dashboard.hotspots(incidents(spark, folder), area_dimension(spark)))
