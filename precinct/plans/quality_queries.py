"""Profiles, contracts, cleaning, set operations and statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.operators import quality, relational as rel, sketches
from precinct.operators.features import add_area_group, add_temporal, drop_leakage as drop_leak, fit_medians, \
    handle_missing
from precinct.operators.quantiles import quantile_table
from precinct.operators.splits import time_split
from precinct.plans.common import REPEATS, over, query, r6, union_sql
from precinct.session import shared_path
from precinct.sources.tables import snapshot_digest as digest
from precinct.sources.testviews import TRAIN_END, VALIDATION_END, incidents, incidents_with_repeats, load

COLUMNS = ["unique_key", "case_number", "date", "primary_type", "location_description", "arrest", "domestic", "beat",
           "district", "ward", "community_area", "year", "latitude", "longitude"]
CRITICAL = ["unique_key", "date", "primary_type", "case_number"]
CODES = ["primary_type", "location_description", "beat", "district", "ward", "community_area", "year"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("missing_profile", over(union_sql(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
    f"{r6(f'(count(*) - count({c})) / count(*) * 100')} AS missing_pct FROM inc" for c in COLUMNS)))
def missing_profile(spark, folder):
    return quality.missing_profile(incidents(spark, folder))


@query("missing_profile_gaps", over("SELECT * FROM (" + union_sql(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
    f"round((count(*) - count({c})) / count(*) * 100, 4) AS missing_pct FROM inc" for c in COLUMNS)
    + ") WHERE missing_count > 0"))
def missing_profile_gaps(spark, folder):
    return quality.missing_profile(incidents(spark, folder), only_gaps=True, scale=4)


@query("critical_nulls", over(union_sql(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count FROM inc" for c in CRITICAL)))
def critical_nulls(spark, folder):
    return quality.critical_nulls(incidents(spark, folder), CRITICAL)


@query("cardinality", over(union_sql(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_values "
    "FROM inc" for c in CODES)))
def cardinality(spark, folder):
    return quality.cardinality(incidents(spark, folder), CODES)


@query("distinct_null_rules", over(union_sql([
    "SELECT 'value' AS rule, count(DISTINCT ward) + max(CASE WHEN ward IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM inc",
    "SELECT 'ignored' AS rule, count(DISTINCT ward) AS n_distinct FROM inc"])))
def distinct_null_rules(spark, folder):
    inc = incidents(spark, folder)
    return (rel.n_distinct(inc, "ward", count_null=True).withColumn("rule", F.lit("value"))
            .unionByName(rel.n_distinct(inc, "ward").withColumn("rule", F.lit("ignored"))))


@query("duplicate_profile", over(union_sql(
    ["SELECT '<row>' AS scope, count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM rep)) AS distinct_rows, "
     "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM rep)) AS duplicate_rows FROM rep"] +
    [f"SELECT '{k}', count(*), count(DISTINCT {k}), count(*) - count(DISTINCT {k}) FROM rep"
     for k in ("unique_key", "case_number")]), rep=REPEATS))
def duplicate_profile(spark, folder):
    return quality.duplicate_profile(incidents_with_repeats(spark, folder), ["unique_key", "case_number"])


@query("repeated_keys", over(
    'SELECT case_number, count(*) AS "count" FROM inc GROUP BY 1 HAVING count(*) > 1'))
def repeated_keys(spark, folder):
    return rel.repeated_keys(incidents(spark, folder), "case_number")


@query("repeated_key_rows", over(
    "SELECT unique_key, case_number, date, primary_type FROM inc WHERE case_number IN "
    "(SELECT case_number FROM inc GROUP BY 1 HAVING count(*) > 1)"))
def repeated_key_rows(spark, folder):
    rows = incidents(spark, folder).select("unique_key", "case_number", "date", "primary_type")
    return rel.rows_with_repeated_key(rows, "case_number")


RULES = {"year outside 1996..2000": "year < 1996 OR year > 2000", "district outside 1..61": "district < 1 OR district > 61",
         "ward outside 1..50": "ward < 1 OR ward > 50",
         "community_area outside 1..77": "community_area < 1 OR community_area > 77",
         "latitude outside 41.0..43.0": "latitude < 41 OR latitude > 43",
         "longitude outside -89.0..-87.0": "longitude < -89 OR longitude > -87"}


@query("validity_checks", over(union_sql(
    f"SELECT '{n}' AS rule, count(CASE WHEN {c} THEN 1 END) AS violations FROM inc" for n, c in RULES.items())))
def validity_checks(spark, folder):
    return quality.validity_checks(incidents(spark, folder), quality.default_rules(years=(1996, 2000)))


@query("year_mismatch", over("SELECT count(CASE WHEN year(date) <> year THEN 1 END) AS mismatches FROM inc"))
def year_mismatch(spark, folder):
    return quality.year_mismatch(incidents(spark, folder))


@query("domain_violations", over(union_sql(
    ["SELECT 'domestic not boolean' AS rule, count(CASE WHEN CAST(domestic AS VARCHAR) NOT IN ('true','false') THEN 1 END) AS violations FROM inc"]
    + [f"SELECT '{c} not a whole number', count(CASE WHEN {c} % 1 <> 0 THEN 1 END) FROM inc"
       for c in ("beat", "district", "ward", "community_area")]
    + [f"SELECT '{c} not a finite number', count(CASE WHEN isinf({c}) THEN 1 END) FROM inc"
       for c in ("latitude", "longitude")])))
def domain_violations(spark, folder):
    return quality.domain_violations(incidents(spark, folder))


@query("whole_number_rule", """SELECT 'price not a whole number' AS rule,
  count(CASE WHEN l_extendedprice <> floor(l_extendedprice) THEN 1 END) AS violations FROM lineitem""")
def whole_number_rule(spark, folder):
    price = F.col("l_extendedprice")
    return quality.validity_checks(load(spark, folder, "lineitem"), {"price not a whole number": price % 1 != 0})


@query("contract_counts", over(
    'SELECT count(*) AS "rows", min(date) AS "start", max(date) AS "end", count(*) - count(date) AS null_dates, '
    "count(CASE WHEN primary_type IS NULL OR trim(primary_type) = '' THEN 1 END) AS null_targets FROM inc"))
def contract_counts(spark, folder):
    return quality.contract_counts(incidents(spark, folder))


MEDIANS = f"SELECT median(latitude) AS la, median(longitude) AS lo FROM inc WHERE date < TIMESTAMP '{TRAIN_END}'"
AREA_GROUP = """CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'Unknown'
  WHEN latitude >= la AND longitude < lo THEN 'North-West' WHEN latitude >= la THEN 'North-East'
  WHEN longitude < lo THEN 'South-West' ELSE 'South-East' END"""


@query("feature_validation", over(
    "SELECT count(*) AS total_rows, count(DISTINCT unique_key) AS unique_ids, "
    "count(*) - count(primary_type) AS missing_target, count(*) - count(hour(date)) AS missing_hour, "
    "count(*) - count(month(date)) AS missing_month, count(*) - count(isodow(date)) AS missing_day_of_week, "
    "count(*) - count(isodow(date)) AS missing_is_weekend, CAST(0 AS BIGINT) AS missing_area_group FROM rep",
    rep=REPEATS))
def feature_validation(spark, folder):
    rows = incidents_with_repeats(spark, folder)
    train, _, _ = time_split(incidents(spark, folder), TRAIN_END, VALIDATION_END)
    return quality.feature_validation(add_area_group(add_temporal(rows), *fit_medians(train)))


@query("clean_dedup", over(
    f"SELECT DISTINCT * REPLACE ({r6('latitude')} AS latitude, {r6('longitude')} AS longitude) FROM rep", rep=REPEATS))
def clean_dedup(spark, folder):
    return quality.clean(incidents_with_repeats(spark, folder))


@query("dedup_by_key", over("SELECT unique_key, primary_type FROM inc"))
def dedup_by_key(spark, folder):
    rows = incidents_with_repeats(spark, folder).select("unique_key", "primary_type")
    return rel.drop_duplicates_by(rows, "unique_key")


@query("cleaning_report", over(
    "SELECT count(*) AS raw_rows, (SELECT count(*) FROM inc) AS clean_rows, "
    'count(*) - (SELECT count(*) FROM inc) AS removed_rows, 14 AS "columns" FROM rep', rep=REPEATS))
def cleaning_report(spark, folder):
    raw = incidents_with_repeats(spark, folder)
    return quality.cleaning_report(raw, quality.clean(raw))


@query("drop_leakage", over(
    "SELECT unique_key, date, primary_type, location_description, domestic, beat, district, ward, community_area, year, "
    f"{r6('latitude')} AS latitude, {r6('longitude')} AS longitude FROM inc"))
def drop_leakage(spark, folder):
    return drop_leak(incidents(spark, folder))


@query("fill_missing", over(
    "SELECT unique_key, coalesce(location_description, 'Unknown') AS location_description, coalesce(ward, -1) AS ward, "
    f"coalesce(community_area, -1) AS community_area, {r6('coalesce(latitude, la)')} AS latitude, "
    f"{r6('coalesce(longitude, lo)')} AS longitude, "
    "CASE WHEN latitude IS NULL OR longitude IS NULL THEN 1 ELSE 0 END AS coordinates_missing FROM inc, m", m=MEDIANS))
def fill_missing(spark, folder):
    inc = incidents(spark, folder)
    train, _, _ = time_split(inc, TRAIN_END, VALIDATION_END)
    return handle_missing(inc, fit_medians(train)).select(
        "unique_key", "location_description", "ward", "community_area", "latitude", "longitude", "coordinates_missing")


@query("drop_missing_rows", over(
    "SELECT unique_key, ward, community_area FROM inc WHERE ward IS NOT NULL AND community_area IS NOT NULL"))
def drop_missing_rows(spark, folder):
    rows = incidents(spark, folder).select("unique_key", "ward", "community_area")
    return rel.drop_missing(rows, ["ward", "community_area"])


@query("describe_numeric", union_sql(
    f"SELECT '{c}' AS column_name, count({c}) AS n, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS stddev, "
    f"{r6(f'min({c})')} AS min_value, {r6(f'max({c})')} AS max_value FROM lineitem" for c in MEASURES))
def describe_numeric(spark, folder):
    return rel.describe(load(spark, folder, "lineitem"), MEASURES)


@query("quartiles_exact", union_sql(
    f"SELECT '{c}' AS column_name, {r6(f'quantile_cont({c}, 0.25)')} AS q1, {r6(f'quantile_cont({c}, 0.5)')} AS median, "
    f"{r6(f'quantile_cont({c}, 0.75)')} AS q3 FROM lineitem" for c in MEASURES))
def quartiles_exact(spark, folder):
    return quantile_table(load(spark, folder, "lineitem"), MEASURES, [0.25, 0.5, 0.75], ["q1", "median", "q3"])


@query("exact_median", over(union_sql(
    f"SELECT '{c}' AS column_name, {r6(f'median({c})')} AS median FROM inc" for c in ("latitude", "longitude"))))
def exact_median(spark, folder):
    return quantile_table(incidents(spark, folder), ["latitude", "longitude"], [0.5], ["median"])


@query("approx_distinct_review")
def approx_distinct_review(spark, folder):
    return quality.feature_review(incidents(spark, folder), CODES + ["latitude", "longitude"])


@query("approx_quartiles")
def approx_quartiles(spark, folder):
    return rel.approx_quartiles(load(spark, folder, "lineitem"), MEASURES)


def _day_by_day(spark, folder) -> DataFrame:
    """Sketches of the incident view, stored year by year as they would come in."""
    inc = incidents(spark, folder)
    years = [r["y"] for r in inc.select(F.year("date").alias("y")).distinct().orderBy("y").collect()]  # one row per year
    parts = [inc.filter((F.col("date") >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (F.col("date") < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))) for y in years]
    return sketches.stored_day_by_day(shared_path(spark), parts, F.date_format("date", "yyyy-MM"), REVIEWED, ["latitude", "longitude"])


REVIEWED = ["unique_key", "case_number", "beat", "ward", "location_description", "latitude"]


@query("sketched_distinct", over(union_sql(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS null_count, true AS within_error FROM inc" for c in REVIEWED)))
def sketched_distinct(spark, folder):
    """Exact distinct values, and whether those of the united sketches of all months are within the stated error of them."""
    inc = incidents(spark, folder)
    wide = inc.agg(*[F.count_distinct(c).alias(c) for c in REVIEWED])
    exact = rel.tall(wide, {c: [F.col(c)] for c in REVIEWED}, "column_name", ["distinct_values"])
    return sketches.distinct_errors(sketches.distinct_review(_day_by_day(spark, folder)), exact)


@query("sketched_quantiles", "SELECT column_name, CAST(p AS DOUBLE) AS probability, true AS within_error FROM (VALUES ('latitude'), ('longitude')) AS c(column_name), (VALUES (0.25), (0.5), (0.75)) AS q(p)")
def sketched_quantiles(spark, folder):
    """Whether the quartiles of the united sketches have the rank they are to have, counted exactly."""
    return sketches.rank_errors(incidents(spark, folder), sketches.quantile_review(_day_by_day(spark, folder), [0.25, 0.5, 0.75]))


@query("snapshot_digest", over(
    "SELECT count(*) AS \"rows\", CAST(sum(('0x' || substr(md5(concat_ws('|', CAST(unique_key AS VARCHAR), case_number, "
    "primary_type, coalesce(CAST(ward AS VARCHAR), '\\N'))), 1, 15))::BIGINT) AS VARCHAR) AS digest FROM inc"))
def snapshot_digest(spark, folder):
    return digest(incidents(spark, folder), ["unique_key", "case_number", "primary_type", "ward"])


@query("value_counts_outcome", over('SELECT arrest, domestic, count(*) AS "count" FROM inc GROUP BY 1, 2'))
def value_counts_outcome(spark, folder):
    return rel.value_counts(incidents(spark, folder), "arrest", "domestic")


@query("outcome_rate_by_class", over(
    f"SELECT primary_type, {r6('avg(CASE WHEN arrest THEN 1 ELSE 0 END)')} AS rate FROM inc GROUP BY 1"))
def outcome_rate_by_class(spark, folder):
    return rel.rate(incidents(spark, folder), F.col("arrest"), "primary_type")


@query("key_set_check", over(
    "SELECT 'only_left' AS side, CAST(count(*) AS BIGINT) AS n FROM inc WHERE unique_key NOT IN (SELECT o_orderkey FROM orders) "
    "UNION ALL SELECT 'only_right', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT unique_key FROM inc)"))
def key_set_check(spark, folder):
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("unique_key"))
    return rel.key_differences(incidents(spark, folder), orders, "unique_key")


@query("unseen_classes", over(
    f"SELECT DISTINCT case_number FROM inc WHERE date >= TIMESTAMP '{TRAIN_END}' AND case_number NOT IN "
    f"(SELECT case_number FROM inc WHERE date < TIMESTAMP '{TRAIN_END}')"))
def unseen_classes(spark, folder):
    inc = incidents(spark, folder)
    train, validation, test = time_split(inc, TRAIN_END, VALIDATION_END)
    return rel.unseen_classes(rel.union_all(validation, test), train, "case_number")


@query("top_classes_kept", over(
    "SELECT unique_key, primary_type FROM inc WHERE primary_type IN "
    "(SELECT primary_type FROM inc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"))
def top_classes_kept(spark, folder):
    return rel.keep_top_classes(incidents(spark, folder).select("unique_key", "primary_type"), "primary_type", 3)
