"""Incident and request tables expressed over the TPC-H-like test tables.

The test data holds no incident table, so the operators run on a view of it: one
incident per order, with the customer and nation giving place and context.  The
``%`` rules below inject NULLs, repeated case numbers, a rare class, rounded
times and malformed requests; no row is left out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.schema import Roles, WEEKDAYS
from precinct.session import tasks

TRAIN_END, VALIDATION_END = "1999-07-01", "2000-07-01"
EVENT_ROLES = Roles(id="event_id", ts="ts", target="event_type")

# Severity groups for the classes of the view.
VIEW_HIGH, VIEW_MODERATE = ("1-URGENT",), ("2-HIGH", "3-MEDIUM")
VIEW_TREND = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM"}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _nulled(every: int, key: str, value):
    return F.when(F.col(key) % every != 0, value)


def incidents(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """One incident per order; ``spread`` deals the rows out to tasks of bounded numbers, for consumers whose work per row outweighs a shuffle.

    They are dealt out behind the joins: a join that shuffles would cut the rows by their bytes again.
    """
    key = F.col("o_orderkey")
    hours = F.when(key % 11 == 0, 0).otherwise((key * 7) % 24).cast("int")
    minutes = F.when(key % 5 == 0, 0).otherwise((key * 13) % 60).cast("int")
    cust = F.col("c_custkey")
    orders = load(spark, folder, "orders")
    joined = (orders
              .join(load(spark, folder, "customer"), F.col("o_custkey") == cust)
              .join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")))
    made = joined.select(
        key.alias("unique_key"),
        F.concat(F.lit("C"), (key - F.when(key % 97 == 1, 1).otherwise(0)).cast("string")).alias("case_number"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hours, minutes)).alias("date"),
        F.when(key % 1000 == 0, "RARE").when(key % 10 < 4, "5-LOW")
         .otherwise(F.col("o_orderpriority")).alias("primary_type"),
        _nulled(211, "o_orderkey", F.col("c_mktsegment")).alias("location_description"),
        (F.col("o_orderstatus") == "F").alias("arrest"),
        (F.col("o_orderpriority") == "1-URGENT").alias("domestic"),
        (F.col("c_nationkey") * 100 + (cust % 10).cast("int")).alias("beat"),
        F.col("n_regionkey").alias("district"),
        _nulled(719, "o_orderkey", F.col("c_nationkey") + 1).alias("ward"),
        _nulled(709, "o_orderkey", (cust % 77).cast("int") + 1).alias("community_area"),
        F.year("o_orderdate").alias("year"),
        _nulled(149, "o_orderkey", F.lit(41.64) + ((cust * 37) % 380).cast("double") / 1000).alias("latitude"),
        _nulled(149, "o_orderkey", F.lit(-87.93) + ((cust * 53) % 410).cast("double") / 1000).alias("longitude"),
    )
    return made.repartition(tasks(orders), "unique_key") if spread else made


def incidents_with_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """The incident view plus a second copy of one record in seven."""
    rows = incidents(spark, folder)
    return rows.unionByName(rows.filter(F.col("unique_key") % 7 == 0))


def requests(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """One scoring request per order; some fields are absent, out of range or unknown.  ``spread`` as for ``incidents``."""
    key = F.col("o_orderkey")
    day = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), (key % 7).cast("int") + 1)
    segment = F.col("c_mktsegment")
    orders = load(spark, folder, "orders")
    joined = orders.join(
        load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    made = joined.select(
        key.alias("request_id"),
        F.when(key % 101 == 0, 78).when(key % 103 == 0, None)
         .otherwise((F.col("o_custkey") % 77).cast("int") + 1).alias("communityArea"),
        F.when(key % 107 == 0, "   ").when(key % 109 == 0, "MOON BASE")
         .when(key % 3 == 0, F.concat(F.lit("  "), F.lower(segment), F.lit(" ")))
         .otherwise(segment).alias("locationDescription"),
        F.when(key % 113 == 0, "Funday").otherwise(day).alias("dayOfWeek"),
        F.when(key % 127 == 0, 24).otherwise((key % 24).cast("int")).alias("hourOfDay"),
        F.when(key % 131 == 0, 13).otherwise((key % 12).cast("int") + 1).alias("month"),
        F.when(key % 5 != 0, (key % 6).cast("int") + 2021).alias("year"),
        F.when(key % 4 != 0, key % 6 == 1).alias("domestic"),
        F.when(key % 137 == 0, 40).when(key % 9 == 0, (key % 25).cast("int") + 1).alias("district"),
        F.when(key % 139 == 0, 99).when(key % 8 == 0, (key % 50).cast("int") + 1).alias("ward"),
        F.when(key % 10 == 0, (key % 2000).cast("int") + 111).alias("beat"),
        F.when(key % 151 == 0, F.lit(0.0)).when(key % 14 == 0, F.lit(41.7)).alias("latitude"),
        F.when(key % 157 == 0, F.lit(0.0)).when(key % 14 == 0, F.lit(-87.6)).alias("longitude"),
    )
    return made.repartition(tasks(orders), "request_id") if spread else made
