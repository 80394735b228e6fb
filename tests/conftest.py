import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from precinct.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


INCIDENT = ("unique_key long, case_number string, date timestamp_ntz, primary_type string, location_description string, "
            "arrest boolean, domestic boolean, beat int, district int, ward int, community_area int, year int, "
            "latitude double, longitude double")


@pytest.fixture(scope="session")
def tiny(spark):
    """Twelve hand-made incidents with gaps, a repeated case number, NaN coordinates and a leap day."""
    nan = float("nan")
    at = dt.datetime
    rows = [
        (1, "A1", at(2024, 1, 1, 0, 0), "THEFT", "STREET", True, False, 111, 1, 1, 1, 2024, 41.90, -87.70),
        (2, "A2", at(2024, 1, 1, 9, 30), "THEFT", "STREET", False, False, 111, 1, 1, 1, 2024, 41.91, -87.60),
        (3, "A2", at(2024, 1, 2, 9, 0), "BATTERY", " street ", False, True, 112, 1, 2, 1, 2024, 41.80, -87.70),
        (4, "A4", at(2024, 2, 29, 23, 59), "BATTERY", None, False, True, 112, 2, 2, 2, 2024, 41.80, -87.60),
        (5, "A5", at(2024, 12, 31, 12, 0), "THEFT", "SHOP", False, None, 113, 2, None, 2, 2024, None, None),
        (6, "A6", at(2025, 1, 2, 0, 0), "ROBBERY", "SHOP", True, False, 113, 2, 3, None, 2025, nan, -87.60),
        (7, "A7", at(2025, 3, 1, 6, 0), "THEFT", "HOME", False, False, 114, 3, 3, 3, 2025, 45.0, -87.65),
        (8, "A8", at(2025, 3, 1, 6, 10), "THEFT", "HOME", False, True, 114, 3, 3, 3, 2025, 95.0, -87.65),
        (9, "A9", at(2025, 6, 1, 18, 0), "ARSON", "HOME", True, False, 114, 3, 4, 90, 2025, 41.85, -87.65),
        (10, "B1", at(2025, 6, 1, 18, 0), "THEFT", "STREET", False, False, 111, 1, 4, 1, 2025, 41.85, -87.65),
        (11, "B2", at(2025, 12, 30, 1, 1), "BATTERY", "STREET", False, False, 111, 1, 5, 1, 2025, 41.85, -87.66),
        (12, "B3", at(2025, 12, 31, 1, 1), "BATTERY", "STREET", False, False, 111, 1, 5, 1, 2025, 41.85, -87.66),
    ]
    return spark.createDataFrame(rows, INCIDENT)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
