import pytest
from pyspark.sql import functions as F

from precinct.operators import quality
from precinct.schema import REQUEST_SCHEMA
from conftest import rows_of

GOOD = dict(request_id=1, communityArea=68, locationDescription="STREET", dayOfWeek="Saturday", hourOfDay=23, month=7)


def frame(spark, *requests, extra=""):
    names = [f.name for f in REQUEST_SCHEMA.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REQUEST_SCHEMA.fields) + extra
    cols = names + ([c.split()[0] for c in extra.split(", ") if c])
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in requests], schema)


def test_valid_request_gets_defaults_and_a_normal_location(spark):
    valid, rejects = quality.validate_requests(frame(spark, {**GOOD, "locationDescription": "  street "}))
    row = valid.first()
    assert (row["locationDescription"], row["year"], row["domestic"]) == ("STREET", 2026, False)
    assert rejects.isEmpty()


@pytest.mark.parametrize("change, field", [
    ({"communityArea": 0}, "communityArea"), ({"communityArea": 78}, "communityArea"), ({"dayOfWeek": "Funday"}, "dayOfWeek"),
    ({"hourOfDay": 24}, "hourOfDay"), ({"month": 13}, "month"), ({"latitude": 0.0}, "latitude"),
    ({"longitude": 0.0}, "longitude"), ({"ward": 99}, "ward"), ({"locationDescription": "   "}, "locationDescription"),
    ({"locationDescription": "x" * 81}, "locationDescription"), ({"beat": 5}, "beat"), ({"year": 1999}, "year"),
    ({"communityArea": None}, "communityArea"), ({"locationDescription": None}, "locationDescription"),
    ({"dayOfWeek": None}, "dayOfWeek"), ({"hourOfDay": None}, "hourOfDay"), ({"month": None}, "month")])
def test_bad_field_is_named(spark, change, field):
    valid, rejects = quality.validate_requests(frame(spark, {**GOOD, **change}))
    assert valid.isEmpty() and rejects.first()["reasons"] == [field]


def test_unknown_field_is_refused_only_where_given(spark):
    df = frame(spark, {**GOOD, "crimeType": "THEFT"}, {**GOOD, "request_id": 2}, extra=", crimeType string")
    valid, rejects = quality.validate_requests(df)
    assert [r["request_id"] for r in valid.collect()] == [2]
    assert rows_of(rejects) == [(1, ["crimeType"])]


def test_unknown_location_is_rejected(spark):
    levels = spark.createDataFrame([("STREET",), ("STREET",)], "l string")
    df = frame(spark, GOOD, {**GOOD, "request_id": 2, "locationDescription": "MOON BASE"})
    assert [r["request_id"] for r in quality.reject_unknown(df, levels).collect()] == [2]
    assert [r["request_id"] for r in quality.keep_known(df, levels).collect()] == [1]


def test_contract_accepts_good_rows_and_names_problems(tiny):
    assert quality.assert_contract(tiny)["rows"] == 12
    with pytest.raises(ValueError, match="missing required"):
        quality.assert_contract(tiny.drop("ward"))
    with pytest.raises(ValueError, match="review"):
        quality.assert_contract(tiny.limit(0))
    with pytest.raises(ValueError, match="review"):
        quality.assert_contract(tiny.withColumn("primary_type", F.when(F.col("unique_key") > 1, F.col("primary_type")).otherwise(" ")))
    with pytest.raises(ValueError, match="unique"):
        quality.assert_contract(tiny.unionByName(tiny.filter("unique_key = 1")))
    with pytest.raises(ValueError, match="time zone"):
        quality.assert_contract(tiny.withColumn("date", F.col("date").cast("timestamp")))


def test_domain_rules_find_each_kind_of_problem(spark):
    df = spark.createDataFrame(
        [("maybe", "1.5", "x", "1", "1", float("inf"), 1.0), (None, None, "2", "3", "4", None, float("nan"))],
        "domestic string, beat string, district string, ward string, community_area string, latitude double, longitude double")
    found = {r["rule"]: r["violations"] for r in quality.domain_violations(df).collect()}
    assert {k for k, v in found.items() if v} == {"domestic not boolean", "beat not a whole number",
                                                  "district not a whole number", "latitude not a finite number"}


def test_missing_profile_of_an_empty_table(tiny):
    rows = quality.missing_profile(tiny.limit(0), ["ward"]).collect()
    assert (rows[0]["missing_count"], rows[0]["missing_pct"]) == (0, None)


def test_cleaning_keeps_repeated_case_numbers_and_nulls(tiny):
    raw = tiny.unionByName(tiny.filter("unique_key <= 2"))
    assert tuple(quality.cleaning_report(raw, quality.clean(raw)).first()) == (14, 12, 2, 14)


def test_duplicates_and_cardinality(tiny):
    got = {r["scope"]: r["duplicate_rows"] for r in quality.duplicate_profile(tiny, ["case_number"]).collect()}
    assert got == {"<row>": 0, "case_number": 1}
    assert dict(rows_of(quality.cardinality(tiny, ["ward", "primary_type"]))) == {"ward": 6, "primary_type": 4}


ODD_ROWS = [(None, 1, 0.0), (1, None, 0.0), (None, 1, 0.0), (1, None, -0.0), (None, None, float("nan")), (None, None, float("nan")), (1, 1, None), (2, 1, None)]


@pytest.mark.parametrize("verify", [False, True])
def test_duplicates_of_odd_rows(spark, verify):
    df = spark.createDataFrame(ODD_ROWS, "a int, b int, c double")
    got = {r["scope"]: (r["total_rows"], r["distinct_rows"]) for r in quality.duplicate_profile(df, ["a", "c"], verify).collect()}
    assert got == {"<row>": (8, 5), "a": (8, 3), "c": (8, 3)}
    assert [tuple(r) for r in quality.duplicate_profile(df.limit(0), ["a"], verify).collect()] == [("<row>", 0, 0, 0), ("a", 0, 0, 0)]


def test_unlike_rows_behind_one_fingerprint_are_told_apart(spark, monkeypatch):
    weak = lambda *cols: F.struct((F.xxhash64(*cols) % 3).alias("h1"), F.lit(0).cast("long").alias("h2"))
    monkeypatch.setattr(quality, "fingerprint", weak)
    df = spark.createDataFrame([(i % 40, i % 7) for i in range(200)], "a int, b int")
    got = {r["scope"]: r["distinct_rows"] for r in quality.duplicate_profile(df, ["a", "b"], verify=True).collect()}
    assert got == {"<row>": df.distinct().count(), "a": 40, "b": 7}


def test_no_whole_row_in_the_shuffle_of_duplicates(tiny):
    plan = quality.duplicate_profile(tiny, ["case_number"])._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert shuffled and not any("latitude" in line for line in shuffled) and "Expand" not in plan


def test_rules_and_year_mismatch(tiny):
    assert quality.year_mismatch(tiny).first()[0] == 0
    found = dict(rows_of(quality.validity_checks(tiny, quality.default_rules())))
    assert found["community_area outside 1..77"] == 1 and found["latitude outside 41.0..43.0"] == 3
