"""Sinks and sources: what is written is read back and compared."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.operators import relational
from precinct.plans.common import over, query, r6, union_sql
from precinct.session import shared_path
from precinct.sources import tables
from precinct.sources.testviews import incidents

WHOLE = f"SELECT * REPLACE ({r6('latitude')} AS latitude, {r6('longitude')} AS longitude) FROM inc"
QUOTED = ("SELECT * REPLACE (CASE WHEN unique_key % 13 = 0 THEN 'SAY \"' || location_description || '\", THEN' ELSE location_description END AS location_description, "
          f"{r6('latitude')} AS latitude, {r6('longitude')} AS longitude) FROM inc")
SHAPE = "(SELECT count(*) FROM inc) AS \"rows\", 14 AS columns, (SELECT count(DISTINCT primary_type) FROM inc) AS classes"


def _quoted(rows: DataFrame) -> DataFrame:
    """Some places with quotes and a comma in them."""
    said = F.concat(F.lit('SAY "'), F.col("location_description"), F.lit('", THEN'))
    return rows.withColumn("location_description", F.when(F.col("unique_key") % 13 == 0, said).otherwise(F.col("location_description")))


@query("csv_round_trip", over(QUOTED))
def csv_round_trip(spark, folder):
    """Written with the columns in reverse; read by name."""
    rows, path = _quoted(incidents(spark, folder)), shared_path(spark)
    tables.write_csv(rows.select(*reversed(rows.columns)), path)
    return tables.read_incidents_csv(spark, path, rows.schema)


@query("overlapping_parts", over(WHOLE))
def overlapping_parts(spark, folder):
    """Two CSV parts that share the records of even id and differ in the order of their columns."""
    rows, root = incidents(spark, folder), shared_path(spark)
    tables.write_csv(rows, f"{root}/part_0")
    tables.write_csv(rows.filter(F.col("unique_key") % 2 == 0).select(*reversed(rows.columns)), f"{root}/part_1")
    return tables.read_parts(spark, f"{root}/part_*", "unique_key", rows.schema)


@query("latest_snapshot", over(WHOLE))
def latest_snapshot(spark, folder):
    """The second of two versions is the latest; the first stays readable under its number."""
    rows, root = incidents(spark, folder), shared_path(spark)
    tables.write_snapshot(rows.filter(F.col("arrest")), root)
    tables.write_snapshot(rows, root)
    return tables.read_snapshot(spark, root)[0]


def _name() -> str:
    return f"precinct_{uuid.uuid4().hex}"


@query("json_round_trip", over(WHOLE))
def json_round_trip(spark, folder):
    rows, path = incidents(spark, folder), shared_path(spark)
    tables.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("resolved_source", over(WHOLE))
def resolved_source(spark, folder):
    """The first candidate is not there, the second lacks a column, the third is taken."""
    rows, short, full = incidents(spark, folder), _name(), _name()
    tables.register(rows.select("unique_key"), short)
    tables.register(rows, full)
    return tables.resolve_source(spark, [_name(), short, full], must_have=["unique_key", "primary_type"])


@query("source_fallback", over(WHOLE))
def source_fallback(spark, folder):
    """No candidate table: the CSV is read."""
    rows, path = incidents(spark, folder), shared_path(spark)
    tables.write_csv(rows, path)
    return tables.resolve_source(spark, [_name()], csv=path, must_have=["unique_key"], schema=rows.schema)


@query("registered_view", over(f"SELECT primary_type, count(*) AS n, {r6('avg(latitude)')} AS latitude FROM inc GROUP BY 1"))
def registered_view(spark, folder):
    """A view by name, queried in SQL."""
    name = _name()
    tables.register(incidents(spark, folder), name)
    return spark.sql(f"SELECT primary_type, count(*) AS n, avg(latitude) AS latitude FROM {name} GROUP BY 1")


@query("catalog_listing", over("SELECT 'events_listed' AS name, true AS is_temporary, count(*) AS \"rows\" FROM events "
                               "UNION ALL SELECT 'incidents_listed', true, count(*) FROM inc"))
def catalog_listing(spark, folder):
    for name, rows in (("incidents_listed", incidents(spark, folder)), ("events_listed", spark.read.parquet(f"{folder}/events.parquet"))):
        tables.register(rows, name)
    listed = (tables.list_tables(spark).filter(F.col("tableName").isin("incidents_listed", "events_listed"))
              .select(F.col("tableName").alias("name"), F.col("isTemporary").alias("is_temporary")))
    counted = [spark.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name in ("incidents_listed", "events_listed")]
    return listed.join(relational.union_all(*counted), "name")


@query("preview_rows", over("SELECT unique_key, primary_type FROM inc ORDER BY unique_key LIMIT 5"))
def preview_rows(spark, folder):
    """The first rows in a stated order."""
    return tables.preview(relational.chronological(incidents(spark, folder), "unique_key", "case_number").select("unique_key", "primary_type"), 5)


@query("table_shape", over(f"SELECT {SHAPE}"))
def table_shape(spark, folder):
    return tables.table_shape(incidents(spark, folder), "primary_type")


DESCRIBED = ["unique_key bigint", "case_number string", "date timestamp_ntz", "primary_type string", "location_description string", "arrest boolean",
             "domestic boolean", "beat int", "district int", "ward int", "community_area int", "year int", "latitude double", "longitude double"]


@query("described_schema", over(union_sql(
    f"SELECT {i} AS position, '{c.split()[0]}' AS column_name, '{c.split()[1]}' AS data_type, {c.startswith('primary_type')} AS is_target, "
    f"count(*) FILTER ({c.split()[0]} IS NULL) AS null_count FROM inc" for i, c in enumerate(DESCRIBED))))
def described_schema(spark, folder):
    """Columns with their types, next to how many values each lacks."""
    rows = incidents(spark, folder)
    nulls = relational.null_counts(rows)
    tall = nulls.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in rows.columns])).alias("n")).select("n.*")
    return tables.describe_schema(rows, "primary_type").drop("nullable").join(tall, "column_name")


@query("saved_and_stored", over(f"SELECT side, {SHAPE} FROM (VALUES ('stored'), ('written')) AS t(side)"))
def saved_and_stored(spark, folder):
    """A snapshot's shape as written and as read back."""
    rows, root, name = incidents(spark, folder), shared_path(spark), _name()
    version = tables.write_snapshot(rows, root)
    tables.register(tables.read_snapshot(spark, root, version)[0], name)
    return tables.verify_saved(rows, name, "primary_type")


@query("rewritten_table", over(WHOLE))
def rewritten_table(spark, folder):
    """A table written twice, first with fewer columns and rows, holds what was written last."""
    rows, path, name = incidents(spark, folder), shared_path(spark), f"rewritten_{uuid.uuid4().hex}"
    tables.write_table(rows.filter(F.col("arrest")).drop("ward"), name, path=path)
    tables.write_table(rows, name, overwrite_schema=True, path=path)
    return spark.table(name)
