"""Table shapes, column roles and the fixed lookup values."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INCIDENT_SCHEMA = T.StructType([
    T.StructField("unique_key", T.LongType()),
    T.StructField("case_number", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("block", T.StringType()),
    T.StructField("iucr", T.StringType()),
    T.StructField("primary_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location_description", T.StringType()),
    T.StructField("arrest", T.BooleanType()),
    T.StructField("domestic", T.BooleanType()),
    T.StructField("beat", T.IntegerType()),
    T.StructField("district", T.IntegerType()),
    T.StructField("ward", T.IntegerType()),
    T.StructField("community_area", T.IntegerType()),
    T.StructField("fbi_code", T.StringType()),
    T.StructField("x_coordinate", T.DoubleType()),
    T.StructField("y_coordinate", T.DoubleType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("updated_on", T.TimestampNTZType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("location", T.StringType()),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("communityArea", T.IntegerType()),
    T.StructField("locationDescription", T.StringType()),
    T.StructField("dayOfWeek", T.StringType()),
    T.StructField("hourOfDay", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("domestic", T.BooleanType()),
    T.StructField("district", T.IntegerType()),
    T.StructField("ward", T.IntegerType()),
    T.StructField("beat", T.IntegerType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])


@dataclass(frozen=True)
class Roles:
    """Names of the columns an operator works on."""

    id: str = "unique_key"
    case: str = "case_number"
    ts: str = "date"
    target: str = "primary_type"
    lat: str = "latitude"
    lon: str = "longitude"
    codes: tuple[str, ...] = ("beat", "district", "ward", "community_area")
    context: str = "location_description"
    flag: str = "domestic"
    outcome: str = "arrest"
    area: str = "community_area"


INCIDENTS = Roles()

# Columns that reveal the target or identify the record.
LEAKAGE_COLUMNS = ("case_number", "iucr", "description", "fbi_code", "arrest", "updated_on")

# Class names behind the severity groups.
HIGH_SEVERITY = ("HOMICIDE", "CRIMINAL SEXUAL ASSAULT", "ROBBERY", "WEAPONS VIOLATION", "BATTERY", "ASSAULT", "KIDNAPPING",
                 "HUMAN TRAFFICKING", "ARSON")
MODERATE_SEVERITY = ("BURGLARY", "MOTOR VEHICLE THEFT", "NARCOTICS", "CRIMINAL DAMAGE", "SEX OFFENSE",
                     "OFFENSE INVOLVING CHILDREN", "STALKING", "INTIMIDATION", "THEFT")

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Blank, tab, line ends, vertical tab, form feed, the four separators, next line and no-break space.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

MISSING = "[MISSING]"
UNKNOWN = "Unknown"
UNSEEN = "UNSEEN_IN_TRAINING"

# The 77 community areas: id, name, latitude, longitude, default district.
AREAS = [
    (1, "Rogers Park", 42.0098, -87.6698, 24),
    (2, "West Ridge", 42.0006, -87.6925, 24),
    (3, "Uptown", 41.9658, -87.6533, 19),
    (4, "Lincoln Square", 41.9699, -87.6887, 19),
    (5, "North Center", 41.9509, -87.6877, 19),
    (6, "Lake View", 41.9427, -87.6534, 19),
    (7, "Lincoln Park", 41.9214, -87.6513, 18),
    (8, "Near North Side", 41.8996, -87.6333, 18),
    (9, "Edison Park", 42.0054, -87.8134, 16),
    (10, "Norwood Park", 41.9856, -87.8067, 16),
    (11, "Jefferson Park", 41.9702, -87.7633, 16),
    (12, "Forest Glen", 41.9788, -87.7554, 16),
    (13, "North Park", 41.9847, -87.7189, 17),
    (14, "Albany Park", 41.9683, -87.7280, 17),
    (15, "Portage Park", 41.9537, -87.7644, 16),
    (16, "Irving Park", 41.9535, -87.7189, 17),
    (17, "Dunning", 41.9472, -87.8066, 16),
    (18, "Montclare", 41.9294, -87.7981, 25),
    (19, "Belmont Cragin", 41.9264, -87.7658, 25),
    (20, "Hermosa", 41.9215, -87.7344, 25),
    (21, "Avondale", 41.9387, -87.7099, 14),
    (22, "Logan Square", 41.9231, -87.7093, 14),
    (23, "Humboldt Park", 41.9022, -87.7214, 14),
    (24, "West Town", 41.8979, -87.6833, 12),
    (25, "Austin", 41.8924, -87.7654, 15),
    (26, "West Garfield Park", 41.8794, -87.7289, 11),
    (27, "East Garfield Park", 41.8819, -87.7022, 11),
    (28, "Near West Side", 41.8744, -87.6633, 12),
    (29, "North Lawndale", 41.8587, -87.7139, 10),
    (30, "South Lawndale", 41.8384, -87.7139, 10),
    (31, "Lower West Side", 41.8542, -87.6698, 12),
    (32, "Loop (Downtown)", 41.8819, -87.6278, 1),
    (33, "Near South Side", 41.8566, -87.6244, 1),
    (34, "Armour Square", 41.8407, -87.6339, 9),
    (35, "Douglas", 41.8344, -87.6189, 2),
    (36, "Oakland", 41.8236, -87.6033, 2),
    (37, "Fuller Park", 41.8089, -87.6322, 9),
    (38, "Grand Boulevard", 41.8128, -87.6178, 2),
    (39, "Kenwood", 41.8089, -87.5933, 2),
    (40, "Washington Park", 41.7944, -87.6189, 2),
    (41, "Hyde Park", 41.7944, -87.5933, 2),
    (42, "Woodlawn", 41.7806, -87.5933, 3),
    (43, "South Shore", 41.7606, -87.5756, 3),
    (44, "Chatham", 41.7439, -87.6133, 6),
    (45, "Avalon Park", 41.7439, -87.5844, 4),
    (46, "South Chicago", 41.7397, -87.5533, 4),
    (47, "Burnside", 41.7289, -87.5956, 5),
    (48, "Calumet Heights", 41.7289, -87.5656, 4),
    (49, "Roseland", 41.7006, -87.6256, 5),
    (50, "Pullman", 41.6961, -87.6033, 5),
    (51, "South Deering", 41.6856, -87.5678, 4),
    (52, "East Side", 41.7067, -87.5356, 4),
    (53, "West Pullman", 41.6744, -87.6333, 5),
    (54, "Riverdale", 41.6506, -87.6033, 5),
    (55, "Hegewisch", 41.6556, -87.5456, 4),
    (56, "Garfield Ridge", 41.7944, -87.7689, 8),
    (57, "Archer Heights", 41.8089, -87.7289, 8),
    (58, "Brighton Park", 41.8189, -87.6989, 9),
    (59, "McKinley Park", 41.8319, -87.6733, 9),
    (60, "Bridgeport", 41.8364, -87.6489, 9),
    (61, "New City (Back of the Yards)", 41.8067, -87.6589, 9),
    (62, "West Elsdon", 41.7933, -87.7133, 8),
    (63, "Gage Park", 41.7933, -87.6989, 8),
    (64, "Clearing", 41.7789, -87.7689, 8),
    (65, "West Lawn", 41.7722, -87.7289, 8),
    (66, "Chicago Lawn", 41.7722, -87.6933, 8),
    (67, "West Englewood", 41.7753, -87.6667, 7),
    (68, "Englewood", 41.7753, -87.6416, 7),
    (69, "Greater Grand Crossing", 41.7606, -87.6189, 3),
    (70, "Ashburn", 41.7467, -87.7089, 8),
    (71, "Auburn Gresham", 41.7439, -87.6556, 6),
    (72, "Beverly", 41.7167, -87.6744, 22),
    (73, "Washington Heights", 41.7167, -87.6489, 22),
    (74, "Mount Greenwood", 41.6933, -87.7089, 22),
    (75, "Morgan Park", 41.6889, -87.6689, 22),
    (76, "O'Hare", 41.9786, -87.9047, 16),
    (77, "Edgewater", 41.9847, -87.6611, 24),
]

# Centre used for an area id that the dimension does not hold.
DEFAULT_CENTRE = (41.85, -87.65)


def area_rows() -> list[tuple[int, str, float, float, int]]:
    return AREAS


def area_dimension(spark: SparkSession) -> DataFrame:
    """The area dimension: 77 rows, so callers may broadcast it."""
    return spark.createDataFrame(area_rows(), "area_id int, name string, lat double, lon double, district int")


def require_columns(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Input is missing required columns: {missing}")


def severity(target: Column, high=HIGH_SEVERITY, moderate=MODERATE_SEVERITY) -> Column:
    """Severity group of a class: High, Moderate or Low."""
    return (F.when(target.isin(*high), "High")
            .when(target.isin(*moderate), "Moderate")
            .otherwise("Low"))
