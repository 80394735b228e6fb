import datetime as dt

import pytest

from precinct.operators import dashboard, explore
from precinct.schema import area_dimension
from conftest import rows_of


def test_coordinate_states(tiny):
    got = {r["coordinate_status"]: r["count"] for r in explore.coordinate_status(tiny).collect()}
    assert got == {"missing_or_nan": 2, "invalid_global_range": 1, "outside_broad_screen": 1, "within_broad_screen": 8}
    assert explore.mapped_totals(tiny).first() == (12, 8, 4)


def test_day_axis_holds_zero_days_and_both_boundaries(tiny):
    days = explore.daily_iqr_flags(tiny).collect()
    assert len(days) == (dt.date(2025, 12, 31) - dt.date(2024, 1, 1)).days + 1
    assert sum(r["count"] for r in days) == 12
    assert [r["day"] for r in days if r["boundary_day"]] == [dt.date(2024, 1, 1), dt.date(2025, 12, 31)]
    assert {r["day"] for r in days if r["flag_iqr"]} == {r["day"] for r in days if r["count"] > 0}
    assert explore.unusual_days(tiny).count() == len(days)


def test_months_hours_weekdays_are_complete(tiny):
    months = {r["month"]: (r["count"], r["boundary_month"]) for r in explore.month_counts(tiny).collect()}
    assert len(months) == 24 and months["2024-01"] == (3, True) and months["2024-03"] == (0, False)
    assert explore.hour_counts(tiny).count() == 24
    week = {r["weekday"]: r for r in explore.weekday_exposure(tiny).collect()}
    assert len(week) == 7 and week["Monday"]["count"] == 2 and week["Monday"]["observed_calendar_days"] == 105


def test_year_flags_and_matched_window(tiny):
    flags = {r["eda_year"]: r["calendar_boundary_coverage"] for r in explore.year_counts(tiny).collect()}
    assert flags == {2024: explore.FULL_YEAR, 2025: explore.PARTIAL_YEAR}
    # The window runs from 01-02 inclusive to 12-31 exclusive.
    assert dict(rows_of(explore.matched_calendar_window(tiny))) == {2024: 2, 2025: 6}


def test_shares_add_up_within_each_group(tiny):
    for field in ("hour", "weekday", "month", "district", "community_area", "location_description", "domestic"):
        sums = {}
        for r in explore.category_mix(tiny, field).collect():
            sums[r["group_value"]] = sums.get(r["group_value"], 0) + r["within_group_pct"]
        assert all(v == pytest.approx(100) for v in sums.values())


def test_missing_group_is_explicit(tiny):
    assert {r["ward"]: r["count"] for r in explore.geo_counts(tiny, "ward").collect()}["[MISSING]"] == 1
    sparse = {r["feature"]: r["total_groups"] for r in explore.sparse_groups(tiny).collect()}
    assert sparse["ward"] == 6


def test_imbalance_row(tiny):
    row = explore.class_imbalance(tiny).first()
    assert (row["classes"], row["largest_class"], row["smallest_class"], row["largest_smallest_ratio"]) == (4, "THEFT", "ROBBERY", 6.0)
    assert row["classes_below_100"] == 4 and row["top_5_share_pct"] == 100.0


def test_coordinate_summary_ignores_nan(tiny):
    row = explore.coordinate_summary(tiny).first()
    assert (row["rows"], row["missing_latitude"], row["lat_min"], row["lat_max"]) == (12, 1, 41.8, 95.0)


def test_zone_mix_needs_a_complete_match(tiny):
    zones = tiny.selectExpr("unique_key", "case when unique_key < 6 then 'N' end as area_group")
    mix, totals, status = explore.zone_mix(tiny, zones)
    assert dict(rows_of(totals)) == {"N": 5, "[MISSING]": 7} and status.startswith("Analysed")
    with pytest.raises(ValueError):
        explore.zone_mix(tiny, zones.filter("unique_key > 1"))
    assert explore.zone_mix(tiny, None)[0] is None
    joined = explore.zone_mix(tiny, zones.filter("unique_key > 1"), check=False)
    assert dict(rows_of(joined[1])) == {"N": 4, "[MISSING]": 7}


@pytest.mark.parametrize("fault, rows, zones", [
    ("null id", [None, None, 1], [1]), ("no zone", [1, 2, 3], [1, 2]), ("no record", [1], [1, 2]), ("repeated record", [1, 1, 2], [1, 2]),
    ("repeated zone", [1, 2], [1, 2, 2])])
def test_zone_faults_are_named_and_counted(spark, fault, rows, zones):
    df = spark.createDataFrame([(i, "A") for i in rows], "unique_key long, primary_type string")
    side = spark.createDataFrame([(i, "N") for i in zones], "unique_key long, area_group string")
    with pytest.raises(ValueError, match=f"'{fault}': 1"):
        explore.zone_mix(df, side)


def test_zone_cells_need_one_shuffle_of_the_rows(tiny):
    zones = tiny.selectExpr("unique_key", "'N' as area_group")
    plan = explore.zone_cells(tiny, zones)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(") == 2  # by id, and the few cells


def test_ten_findings_and_manifest(tiny):
    rows = {r["n"]: r["text"] for r in explore.findings(tiny).collect()}
    assert sorted(rows) == list(range(1, 11)) and "THEFT holds 50.00%" in rows[2]
    manifest = explore.run_manifest(tiny, "r", "view", 3, ["a", "b"]).first()
    assert (manifest["rows"], manifest["source_version"], manifest["outputs"]) == (12, 3, ["a", "b"])


def test_category_maximum_and_matrix(tiny):
    top = explore.mix_maximum(tiny, "district").first()
    assert (top["group_value"], top["primary_type"], top["within_group_pct"]) == ("3", "THEFT", pytest.approx(200 / 3))
    matrix = {r["group_value"]: r["ARSON"] for r in explore.category_mix_matrix(tiny, "district", ["THEFT", "ARSON"]).collect()}
    assert matrix["1"] == 0 and matrix["3"] == pytest.approx(100 / 3)


def test_trend_grid_reconciles_with_the_overview(tiny):
    rows = dashboard.trend_grid(tiny).collect()
    assert len(rows) == 48 and {r["year"] for r in rows} == {2023, 2024, 2025, 2026}
    assert all([r["month_number"] for r in sorted(rows, key=lambda r: r["month_number"]) if r["year"] == y] == list(range(1, 13))
               for y in range(2023, 2027))
    assert all(r["theft"] + r["battery"] + r["robbery"] + r["other"] == 0 for r in rows if not r["available"])
    total = sum(r["theft"] + r["battery"] + r["robbery"] + r["other"] for r in rows)
    facts = dashboard.overview(tiny).first()
    assert total == facts["total_incidents"] == 12
    assert facts["arrest_rate"] == pytest.approx(3 / 12) and facts["rate_text"] == "25.0%"
    assert {r["coverage_end"] for r in rows if r["year"] == 2025} == {"2025-12-31"}


def test_trend_view_has_gaps_as_null(tiny):
    view = {r["month_number"]: r for r in dashboard.trend_view(dashboard.trend_grid(tiny), (2024, 2025), (1, 3)).collect()}
    assert (view[1]["2024"], view[1]["2025"], view[2]["2025"], view[3]["2025"]) == (3, 1, None, 2)
    totals = {r["year"]: r["total"] for r in dashboard.trend_year_totals(dashboard.trend_grid(tiny), (2023, 2024), (1, 12), "theft").collect()}
    assert totals == {2023: 0, 2024: 3}


def test_hotspots_recent_profile_and_symbols(spark, tiny):
    areas = area_dimension(spark)
    spots = {r["area_id"]: (r["area_name"], r["risk_level"], r["incident_count"]) for r in dashboard.hotspots(tiny, areas).collect()}
    assert spots[1] == ("Rogers Park", "High", 6) and spots[90] == ("Area 90", "Moderate", 1)
    recent = dashboard.recent_incidents(tiny, areas).collect()
    assert len(recent) == 8 and max(r["time"] for r in recent) == "2025-12-31 01:01"
    assert {r["type"]: r["severity"] for r in recent} == {"BATTERY": "High", "ARSON": "High", "THEFT": "Moderate", "ROBBERY": "High"}
    profile = {r["area_id"]: r for r in dashboard.area_profile(tiny, areas).collect()}
    assert len(profile) == 77 and [t["type"] for t in profile[1]["top_crimes"]] == ["BATTERY", "THEFT"]
    assert profile[50]["incident_count"] == 0
    radii = {r["area_id"]: r["radius"] for r in dashboard.map_symbols(dashboard.hotspots(tiny, areas)).collect()}
    assert radii[1] == 22.0
