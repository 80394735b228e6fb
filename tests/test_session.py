import os

import pytest
from pyspark.sql import functions as F

from precinct import session
from precinct.sources import testviews
from conftest import SF


def test_stored_tables_of_a_scope_can_be_discarded(spark):
    outside = session.store(spark.range(3))
    with session.scope() as outer:
        kept = session.store(spark.range(4))
        with session.scope() as inner:
            session.store(spark.range(5))
    assert outer == [kept.stored_path] and len(inner) == 1
    session.discard(spark, *inner, kept)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in [*inner, *outer])
    assert outside.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(kept.stored_path)


def test_rows_are_dealt_out_by_their_number(spark, monkeypatch):
    """A narrow table in one file is one task of a scan, however many rows it has."""
    stored = session.store(spark.range(10_000).coalesce(1))
    monkeypatch.setattr(session, "TASK_ROWS", 1_000)
    made = session.dealt(stored)
    assert stored.rdd.getNumPartitions() < 10 == made.rdd.getNumPartitions() and made.count() == 10_000
    assert session.dealt(made).rdd.getNumPartitions() == 10 and session.tasks(spark.range(0)) == 1


def test_views_are_cut_by_rows_behind_a_join_that_shuffles(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1"), spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for view in (testviews.incidents, testviews.requests):
            parts = [r["count"] for r in view(spark, SF, spread=True).groupBy(F.spark_partition_id()).count().collect()]
            assert sum(parts) == spark.read.parquet(f"{SF}/orders.parquet").count() and len(parts) >= sum(parts) // 100 and max(parts) < 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"), spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
