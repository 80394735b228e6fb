from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from precinct.schema import INCIDENT_SCHEMA
from precinct.sources import tables
from conftest import rows_of


def test_csv_round_trip_keeps_types(spark, tiny, tmp_path):
    path = str(tmp_path / "csv")
    tables.write_csv(tiny, path)
    back = tables.read_incidents_csv(spark, path, tiny.schema)
    assert back.schema == tiny.schema
    assert back.count() == tiny.count()
    assert back.filter("unique_key = 4").first()["date"] == tiny.filter("unique_key = 4").first()["date"]


def test_csv_schema_has_22_columns():
    assert len(INCIDENT_SCHEMA.fields) == 22


def test_parts_with_overlapping_pages_keep_one_row_per_key(spark, tmp_path):
    for i, ids in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(k, "x") for k in ids], "id long, v string").coalesce(1).write.option("header", True) \
            .csv(str(tmp_path / f"part_{i}.csv"))
    got = tables.read_parts(spark, str(tmp_path / "part_*.csv"), "id", spark.createDataFrame([], "id long, v string").schema)
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3]


def test_snapshots_are_numbered_and_pinned(spark, tiny, tmp_path):
    root = str(tmp_path / "snap")
    assert tables.write_snapshot(tiny, root) == 1
    assert tables.write_snapshot(tiny.filter("unique_key < 3"), root) == 2
    latest, number = tables.read_snapshot(spark, root)
    assert (latest.count(), number) == (2, 2)
    assert tables.read_snapshot(spark, root, 1)[0].count() == 12


def test_resolve_source_falls_back_and_checks_columns(spark, tiny, tmp_path):
    tables.register(tiny, "incidents_view")
    assert tables.resolve_source(spark, ["absent_table", "incidents_view"]).count() == 12
    with pytest.raises(ValueError):
        tables.resolve_source(spark, ["incidents_view"], must_have=["hour"])
    path = str(tmp_path / "csv")
    tables.write_csv(tiny, path)
    assert tables.resolve_source(spark, ["absent_table"], csv=path, schema=tiny.schema).count() == 12


def test_saved_table_reads_back_equal(spark, tiny):
    spark.sql("DROP TABLE IF EXISTS tiny_saved")
    tables.write_table(tiny, "tiny_saved")
    sides = {r["side"]: (r["rows"], r["columns"], r["classes"]) for r in tables.verify_saved(tiny, "tiny_saved", "primary_type").collect()}
    assert sides["stored"] == sides["written"] == (12, 14, 4)
    assert "tiny_saved" in [r["tableName"] for r in tables.list_tables(spark).collect()]
    spark.sql("DROP TABLE tiny_saved")


def test_json_sink_and_literal_rows(spark, tmp_path):
    tables.write_json(tables.literal_rows(spark, [(1, 0.5)], "k int, v double"), str(tmp_path / "m"))
    assert rows_of(spark.read.schema("k int, v double").json(str(tmp_path / "m"))) == [(1, 0.5)]


def test_schema_listing_marks_the_target(tiny):
    listed = tables.describe_schema(tiny, "primary_type")
    assert listed.count() == 14
    assert [r["column_name"] for r in listed.filter("is_target").collect()] == ["primary_type"]


def test_digest_ignores_order_and_counts_copies(tiny):
    cols = ["unique_key", "primary_type", "ward"]
    base = tables.snapshot_digest(tiny, cols).first()
    assert tables.snapshot_digest(tiny.orderBy(F.desc("unique_key")).repartition(3), cols).first() == base
    assert tables.snapshot_digest(tiny.unionByName(tiny.filter("unique_key = 1")), cols).first() != base


def test_preview(tiny):
    assert tables.preview(tiny, 3).count() == 3


def test_csv_is_bound_by_name_and_keeps_quotes(spark, tmp_path):
    folder = tmp_path / "turned"
    folder.mkdir()
    (folder / "part.csv").write_text('v,extra,id\n"SAY ""HI"", THEN",x,7\n')
    schema = spark.createDataFrame([], "id long, v string").schema
    assert rows_of(tables.read_incidents_csv(spark, str(folder), schema)) == [(7, 'SAY "HI", THEN')]
    (folder / "other.csv").write_text("id,extra,v\n8,y,b\n")
    with pytest.raises(Exception):
        tables.read_incidents_csv(spark, str(folder), schema).collect()
    with pytest.raises(ValueError, match="lacks the columns"):
        tables.read_incidents_csv(spark, str(folder), spark.createDataFrame([], "id long, w string").schema)


def test_bad_records_are_errors(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,v\nseven,a\n")
    with pytest.raises(Exception):
        tables.read_incidents_csv(spark, str(tmp_path / "bad.csv"), spark.createDataFrame([], "id long, v string").schema).collect()


def test_latest_version_lists_folders(spark, tmp_path):
    root = str(tmp_path / "versions")
    assert tables.latest_version(spark, root) is None
    assert [tables.write_snapshot(spark.range(n), root) for n in (1, 2, 3)] == [1, 2, 3]
    (tmp_path / "versions" / "v=note").mkdir()
    assert tables.latest_version(spark, root) == 3 and tables.read_snapshot(spark, root)[0].count() == 3


def test_two_writers_get_two_versions(spark, tmp_path):
    root = str(tmp_path / "s")
    with ThreadPoolExecutor(4) as threads:
        numbers = list(threads.map(lambda n: tables.write_snapshot(spark.range(n), root), range(1, 5)))
    assert sorted(numbers) == [1, 2, 3, 4]
    assert {v: tables.read_snapshot(spark, root, v)[0].count() for v in numbers} == dict(zip(numbers, range(1, 5)))


def test_a_lost_number_is_followed_by_the_next(spark, tmp_path, monkeypatch):
    """Another writer takes the number between the listing and the claim."""
    root, latest = str(tmp_path / "s"), tables.latest_version
    seen = []

    def late(session, where):
        found = latest(session, where)
        if not seen:
            seen.append(1)
            tables.write_snapshot(spark.range(7), root)
        return found

    monkeypatch.setattr(tables, "latest_version", late)
    assert tables.write_snapshot(spark.range(3), root) == 2
    assert [tables.read_snapshot(spark, root, v)[0].count() for v in (1, 2)] == [7, 3]


def test_publishing_a_name_twice_keeps_the_first(spark, tmp_path):
    root = str(tmp_path / "p")
    assert tables.publish_once(spark.range(2), root, "k=a") is True and tables.publish_once(spark.range(5), root, "k=a") is False
    assert spark.read.parquet(f"{root}/k=a").count() == 2 and spark.read.parquet(root).count() == 2


def test_a_table_rewritten_with_another_schema(spark, tiny, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(tiny.drop("ward"), "tiny_external", path=path)
    tables.write_table(tiny, "tiny_external", overwrite_schema=True, path=path)
    assert spark.table("tiny_external").columns == tiny.columns and spark.table("tiny_external").count() == 12
    spark.sql("DROP TABLE tiny_external")
