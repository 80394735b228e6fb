"""Data-quality profiles, contracts and the cleaning step.

A profile is one aggregate over the table, turned tall afterwards, whatever the
number of columns it looks at.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precinct.functions.predicates import FALSE_TEXT, TRUE_TEXT, blank_or_null, is_infinite, out_of_range
from precinct.functions.scalars import fingerprint, norm_text, strip
from precinct.operators.relational import assert_unique_key, drop_exact_duplicates, tall
from precinct.schema import INCIDENTS, REQUEST_SCHEMA, WEEKDAYS, Roles, require_columns
from precinct.session import broadcast_if_small, settle


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def missing_profile(df: DataFrame, cols=None, only_gaps: bool = False, scale: int | None = None) -> DataFrame:
    """Missing count and percent per column."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count("*").alias("__rows"), *[_count(F.col(c).isNull()).alias(c) for c in cols])
    share = {c: F.when(F.col("__rows") > 0, F.col(c) / F.col("__rows") * 100) for c in cols}
    if scale is not None:
        share = {c: F.round(s, scale) for c, s in share.items()}
    profile = tall(wide, {c: [F.col(c), share[c]] for c in cols}, "column_name", ["missing_count", "missing_pct"])
    return profile.filter(F.col("missing_count") > 0) if only_gaps else profile


def critical_nulls(df: DataFrame, cols) -> DataFrame:
    return missing_profile(df, cols).select("column_name", "missing_count")


def _fingerprints(df: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """(scope, h1, h2, n): rows per fingerprint of every scope, counted before the one shuffle, which is narrow."""
    marks = F.array(*[F.struct(F.lit(i).alias("scope"), fingerprint(*[F.col(c) for c in cols]).alias("f")) for i, cols in enumerate(scopes.values())])
    return df.select(F.explode(marks).alias("m")).groupBy("m.scope", "m.f.h1", "m.f.h2").agg(F.count("*").alias("n"))


def _unlike(df: DataFrame, repeated: DataFrame, scope: int, cols: list[str]) -> DataFrame:
    """Distinct values minus one, for the fingerprints of a scope that stand for unlike values."""
    marked = df.select(fingerprint(*[F.col(c) for c in cols]).alias("f"), F.struct(*cols).alias("v")).select("f.*", "v")
    same = marked.join(repeated.filter(F.col("scope") == scope).select("h1", "h2"), ["h1", "h2"], "left_semi")
    # Equal values collapse map-side: a fingerprint's least and largest value are all that is shuffled of it.
    spans = same.groupBy("h1", "h2").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter(~F.col("low").eqNullSafe(F.col("high")))
    return same.join(spans.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg((F.count_distinct("v") - 1).alias("n"))


def duplicate_profile(df: DataFrame, keys=(), verify: bool = False) -> DataFrame:
    """Rows, distinct values and surplus rows for the whole row and for each key (NULL is a value).

    Whole rows never leave their task: 128-bit fingerprints are counted.  Two of 10^12 unlike rows share one with a chance
    of 10^-15; ``verify`` compares the values behind repeated fingerprints all the same and adds what it finds.
    """
    scopes = {"<row>": list(df.columns), **{k: [k] for k in keys}}
    found = _fingerprints(df, scopes)
    found = settle(found) if verify else found
    names = F.array(*[F.lit(s) for s in scopes])
    wide = found.groupBy("scope").agg(F.sum("n").alias("total_rows"), F.count("*").alias("distinct_rows"))
    if verify:
        repeated = found.filter(F.col("n") > 1)
        parts = [_unlike(df, repeated, i, cols).agg(F.lit(i).alias("scope"), F.coalesce(F.sum("n"), F.lit(0)).alias("unlike")) for i, cols in enumerate(scopes.values())]
        wide = wide.join(reduce(DataFrame.unionByName, parts), "scope").withColumn("distinct_rows", F.col("distinct_rows") + F.col("unlike"))
    axis = df.sparkSession.range(len(scopes)).select(F.col("id").cast("int").alias("scope"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return axis.join(wide, "scope", "left").select(
        F.get(names, F.col("scope")).alias("scope"), zero("total_rows").alias("total_rows"), zero("distinct_rows").alias("distinct_rows"),
        (zero("total_rows") - zero("distinct_rows")).alias("duplicate_rows"))


def cardinality(df: DataFrame, cols, count_null: bool = True) -> DataFrame:
    """Exact distinct values per column; one scan, each value counted once per column."""
    value = (lambda c: F.struct(c)) if count_null else F.col
    wide = df.agg(*[F.count_distinct(value(c)).alias(c) for c in cols])
    return tall(wide, {c: [F.col(c)] for c in cols}, "column_name", ["distinct_values"])


def feature_review(df: DataFrame, cols, rsd: float = 0.05) -> DataFrame:
    """Approximate distinct values and NULL count per column."""
    wide = df.agg(*[F.approx_count_distinct(c, rsd).alias(f"{c}__d") for c in cols],
                  *[_count(F.col(c).isNull()).alias(f"{c}__n") for c in cols])
    return tall(wide, {c: [F.col(f"{c}__d"), F.col(f"{c}__n")] for c in cols}, "column_name",
                ["approx_distinct_values", "null_count"])


def default_rules(roles: Roles = INCIDENTS, years: tuple[int, int] = (2024, 2026)) -> dict[str, Column]:
    """The range rules of the incident table."""
    bounds = {"year": years, "district": (1, 61), "ward": (1, 50), roles.area: (1, 77),
              roles.lat: (41.0, 43.0), roles.lon: (-89.0, -87.0)}
    return {f"{c} outside {lo}..{hi}": out_of_range(F.col(c), lo, hi) for c, (lo, hi) in bounds.items()}


def validity_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule."""
    wide = df.agg(*[_count(cond).alias(f"r{i}") for i, cond in enumerate(rules.values())])
    return tall(wide, {name: [F.col(f"r{i}")] for i, name in enumerate(rules)}, "rule", ["violations"])


def year_mismatch(df: DataFrame, ts: str = "date", year: str = "year") -> DataFrame:
    return df.agg(_count(F.year(ts) != F.col(year)).alias("mismatches"))


def domain_violations(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Flag values that are not boolean, codes that are not whole numbers, coordinates that are not finite."""
    flag = F.lower(F.trim(F.col(roles.flag).cast("string")))
    rules = {f"{roles.flag} not boolean": ~flag.isin(*TRUE_TEXT, *FALSE_TEXT)}
    for c in roles.codes:
        number = F.col(c).try_cast("double")
        rules[f"{c} not a whole number"] = F.col(c).isNotNull() & (number.isNull() | (number % 1 != 0))
    for c in (roles.lat, roles.lon):
        number = F.col(c).try_cast("double")
        rules[f"{c} not a finite number"] = (F.col(c).isNotNull() & number.isNull()) | is_infinite(number)
    return validity_checks(df, rules)


def clean(df: DataFrame) -> DataFrame:
    """Drop exact copies; keep NULLs, repeated case numbers and all types as they are."""
    return drop_exact_duplicates(df)


def cleaning_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    before = raw.agg(F.count("*").alias("raw_rows"))
    after = cleaned.agg(F.count("*")).scalar()
    return before.select("raw_rows", after.alias("clean_rows"), (F.col("raw_rows") - after).alias("removed_rows"),
                         F.lit(len(cleaned.columns)).alias("columns"))


def feature_validation(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """One row: rows, unique ids and missing target / feature counts."""
    return df.agg(F.count("*").alias("total_rows"), F.count_distinct(roles.id).alias("unique_ids"),
                  _count(F.col(roles.target).isNull()).alias("missing_target"),
                  *[_count(F.col(c).isNull()).alias(f"missing_{c}")
                    for c in ("hour", "month", "day_of_week", "is_weekend", "area_group")])


def contract_counts(df: DataFrame, roles: Roles = INCIDENTS) -> DataFrame:
    """Rows, time range, NULL times and blank targets in one pass."""
    return df.agg(F.count("*").alias("rows"), F.min(roles.ts).alias("start"), F.max(roles.ts).alias("end"),
                  _count(F.col(roles.ts).isNull()).alias("null_dates"),
                  _count(blank_or_null(F.col(roles.target))).alias("null_targets"))


def assert_contract(df: DataFrame, roles: Roles = INCIDENTS, unique: bool = True) -> dict:
    """Fail on absent columns, an empty table, NULL times, blank targets or repeated ids."""
    require_columns(df, [roles.id, roles.ts, roles.target, roles.lat, roles.lon, roles.context, roles.flag,
                         *roles.codes])
    if not isinstance(df.schema[roles.ts].dataType, T.TimestampNTZType):
        raise ValueError(f"{roles.ts} must be a wall-clock timestamp without time zone")
    facts = contract_counts(df, roles).first().asDict()
    if facts["rows"] == 0 or facts["null_dates"] or facts["null_targets"]:
        raise ValueError(f"Input needs review: {facts}")
    if unique:
        assert_unique_key(df, roles.id)
    return facts

# ------------------------------------------------------------ scoring requests

# Closed ranges of the request fields.
REQUEST_RANGES = {
    "communityArea": (1, 77), "hourOfDay": (0, 23), "month": (1, 12), "year": (2001, 2030),
    "district": (1, 31), "ward": (1, 50), "beat": (111, 2535),
    "latitude": (41.6, 42.1), "longitude": (-87.95, -87.5),
}
REQUIRED_FIELDS = ("communityArea", "locationDescription", "dayOfWeek", "hourOfDay", "month")
REQUEST_DEFAULTS = {"year": 2026, "domestic": False}
LOCATION_LENGTH = 80


def request_reasons(df: DataFrame) -> Column:
    """Array of the names of all offending fields, in schema order."""
    known = [f.name for f in REQUEST_SCHEMA.fields]
    checks: dict[str, list[Column]] = {c: [] for c in known}
    for c in REQUIRED_FIELDS:
        checks[c].append(F.col(c).isNull())
    for c, (low, high) in REQUEST_RANGES.items():
        checks[c].append(out_of_range(F.col(c), low, high))
    place = F.col("locationDescription")
    checks["locationDescription"].append((strip(place) == "") | (F.length(place) > LOCATION_LENGTH))
    checks["dayOfWeek"].append(~F.col("dayOfWeek").isin(*WEEKDAYS))
    extra = {c: [F.col(c).isNotNull()] for c in df.columns if c not in known}
    entries = [F.when(F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in conds]),
                                 F.lit(False)), F.lit(c))
               for c, conds in {**checks, **extra}.items() if conds]
    return F.array_compact(F.array(*entries))


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests with defaults and a normalised location, rejects with reasons)."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in REQUEST_SCHEMA.fields if f.name not in df.columns}
    full = df.withColumns(absent) if absent else df
    judged = full.withColumn("reasons", request_reasons(full))
    fields = [f.name for f in REQUEST_SCHEMA.fields]
    valid = (judged.filter(F.size("reasons") == 0).select(*fields).fillna(REQUEST_DEFAULTS)
             .withColumn("locationDescription", norm_text(F.col("locationDescription"))))
    return valid, judged.filter(F.size("reasons") > 0).select("request_id", "reasons")


def _levels(levels: DataFrame, col: str) -> DataFrame:
    """Distinct known values, broadcast after counting them: the requests then stay where they are."""
    return broadcast_if_small(settle(levels.select(F.col(levels.columns[0]).alias(col)).distinct()))


def reject_unknown(df: DataFrame, levels: DataFrame, col: str = "locationDescription") -> DataFrame:
    """Requests whose location the training data never shows."""
    return df.join(_levels(levels, col), col, "left_anti")


def keep_known(df: DataFrame, levels: DataFrame, col: str = "locationDescription") -> DataFrame:
    return df.join(_levels(levels, col), col, "left_semi")
