"""Registry and the SQL fragments that the oracle queries share.

A query is a function (spark, folder) -> DataFrame over the whole test tables.  Its
oracle is ANSI-style SQL for a second engine; floating results are rounded to six
places on both sides, because sums may be taken in another order.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precinct.schema import area_rows
from precinct.sources.testviews import TRAIN_END, VALIDATION_END

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "RARE"]


def tidy(df: DataFrame) -> DataFrame:
    """Round every floating column to six places (and turn -0.0 into 0.0)."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), 6) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, folder: tidy(build(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def r6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


INC = """SELECT o.o_orderkey AS unique_key,
  concat('C', CAST(o.o_orderkey - CASE WHEN o.o_orderkey % 97 = 1 THEN 1 ELSE 0 END AS VARCHAR)) AS case_number,
  o.o_orderdate + to_hours(CAST(CASE WHEN o.o_orderkey % 11 = 0 THEN 0 ELSE (o.o_orderkey * 7) % 24 END AS INT))
    + to_minutes(CAST(CASE WHEN o.o_orderkey % 5 = 0 THEN 0 ELSE (o.o_orderkey * 13) % 60 END AS INT)) AS date,
  CASE WHEN o.o_orderkey % 1000 = 0 THEN 'RARE' WHEN o.o_orderkey % 10 < 4 THEN '5-LOW'
       ELSE o.o_orderpriority END AS primary_type,
  CASE WHEN o.o_orderkey % 211 = 0 THEN NULL ELSE c.c_mktsegment END AS location_description,
  o.o_orderstatus = 'F' AS arrest,
  o.o_orderpriority = '1-URGENT' AS domestic,
  c.c_nationkey * 100 + CAST(c.c_custkey % 10 AS INT) AS beat,
  n.n_regionkey AS district,
  CASE WHEN o.o_orderkey % 719 = 0 THEN NULL ELSE c.c_nationkey + 1 END AS ward,
  CASE WHEN o.o_orderkey % 709 = 0 THEN NULL ELSE CAST(c.c_custkey % 77 AS INT) + 1 END AS community_area,
  CAST(year(o.o_orderdate) AS INT) AS year,
  CASE WHEN o.o_orderkey % 149 = 0 THEN NULL
       ELSE CAST(41.64 AS DOUBLE) + CAST((c.c_custkey * 37) % 380 AS DOUBLE) / 1000 END AS latitude,
  CASE WHEN o.o_orderkey % 149 = 0 THEN NULL
       ELSE CAST(-87.93 AS DOUBLE) + CAST((c.c_custkey * 53) % 410 AS DOUBLE) / 1000 END AS longitude
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""

REPEATS = "SELECT * FROM inc UNION ALL SELECT * FROM inc WHERE unique_key % 7 = 0"

SPLIT = f"""SELECT *, CASE WHEN date < TIMESTAMP '{TRAIN_END}' THEN 'train'
  WHEN date < TIMESTAMP '{VALIDATION_END}' THEN 'validation' ELSE 'test' END AS split FROM inc"""

AREAS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "({}, '{}', CAST({!r} AS DOUBLE), CAST({!r} AS DOUBLE), {})".format(i, n.replace("'", "''"), la, lo, d)
    for i, n, la, lo, d in area_rows()) + ") AS a(area_id, name, lat, lon, district)"

REQ = """SELECT o.o_orderkey AS request_id,
  CASE WHEN o.o_orderkey % 101 = 0 THEN 78 WHEN o.o_orderkey % 103 = 0 THEN NULL
       ELSE CAST(o.o_custkey % 77 AS INT) + 1 END AS communityArea,
  CASE WHEN o.o_orderkey % 107 = 0 THEN '   ' WHEN o.o_orderkey % 109 = 0 THEN 'MOON BASE'
       WHEN o.o_orderkey % 3 = 0 THEN '  ' || lower(c.c_mktsegment) || ' ' ELSE c.c_mktsegment END AS locationDescription,
  CASE WHEN o.o_orderkey % 113 = 0 THEN 'Funday' ELSE
    ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][CAST(o.o_orderkey % 7 AS INT) + 1] END AS dayOfWeek,
  CASE WHEN o.o_orderkey % 127 = 0 THEN 24 ELSE CAST(o.o_orderkey % 24 AS INT) END AS hourOfDay,
  CASE WHEN o.o_orderkey % 131 = 0 THEN 13 ELSE CAST(o.o_orderkey % 12 AS INT) + 1 END AS month,
  CASE WHEN o.o_orderkey % 5 <> 0 THEN CAST(o.o_orderkey % 6 AS INT) + 2021 END AS year,
  CASE WHEN o.o_orderkey % 4 <> 0 THEN o.o_orderkey % 6 = 1 END AS domestic,
  CASE WHEN o.o_orderkey % 137 = 0 THEN 40 WHEN o.o_orderkey % 9 = 0 THEN CAST(o.o_orderkey % 25 AS INT) + 1 END AS district,
  CASE WHEN o.o_orderkey % 139 = 0 THEN 99 WHEN o.o_orderkey % 8 = 0 THEN CAST(o.o_orderkey % 50 AS INT) + 1 END AS ward,
  CASE WHEN o.o_orderkey % 10 = 0 THEN CAST(o.o_orderkey % 2000 AS INT) + 111 END AS beat,
  CASE WHEN o.o_orderkey % 151 = 0 THEN CAST(0 AS DOUBLE) WHEN o.o_orderkey % 14 = 0 THEN CAST(41.7 AS DOUBLE) END AS latitude,
  CASE WHEN o.o_orderkey % 157 = 0 THEN CAST(0 AS DOUBLE) WHEN o.o_orderkey % 14 = 0 THEN CAST(-87.6 AS DOUBLE) END AS longitude
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""


def over(body: str, **ctes: str) -> str:
    """SQL with the incident view and further named steps in front."""
    steps = {"inc": INC, **ctes}
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in steps.items()) + "\n" + body


def union_sql(rows) -> str:
    return "\nUNION ALL\n".join(rows)
