import pytest
from pyspark.sql import functions as F

from precinct.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(60_000).select(F.col("id"), (F.col("id") % 12).alias("month"), (F.col("id") % 700).alias("code"),
                                      F.when(F.col("id") % 5 != 0, (F.xxhash64("id") / 1e15)).alias("x"), F.lit(None).cast("int").alias("none"))


def test_parts_unite_to_the_whole_without_being_read_again(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    parts = [rows.filter(F.col("month").between(low, low + 3)) for low in (0, 4, 8)]
    table = sketches.stored_day_by_day(path, parts, F.col("month"), ["id", "code", "none"], ["x", "none"])
    assert table.count() == 12
    exact = spark.createDataFrame([("id", 60_000), ("code", 700), ("none", 0)], "column_name string, distinct_values long")
    found = sketches.distinct_errors(sketches.distinct_review(table), exact).collect()
    assert len(found) == 3 and all(r["within_error"] for r in found)
    assert {r["column_name"]: r["null_count"] for r in found} == {"id": 0, "code": 0, "none": 60_000}
    quartiles = sketches.quantile_review(sketches.partition_sketches(rows, F.col("month"), [], ["x"]), [0.01, 0.5, 0.99])
    assert all(r["within_error"] for r in sketches.rank_errors(rows, quartiles).collect())
    plan = sketches.distinct_review(table)._jdf.queryExecution().executedPlan().toString()
    assert path in plan and "Range" not in plan


def test_a_new_part_is_all_that_is_sketched(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    sketches.add_partitions(path, sketches.partition_sketches(rows.filter("month < 11"), F.col("month"), ["code"], []))
    before = sketches.distinct_review(spark.read.parquet(path)).first()["approx_distinct_values"]
    late = rows.filter("month = 11").withColumn("code", F.col("code") + 10_000)
    sketches.add_partitions(path, sketches.partition_sketches(late, F.col("month"), ["code"], []))
    after = sketches.distinct_review(spark.read.parquet(path)).first()["approx_distinct_values"]
    assert after > before + 100


def test_a_wrong_estimate_is_flagged(spark, rows):
    wrong = spark.createDataFrame([("x", 0.5, 1e9)], "column_name string, probability double, value double")
    assert [r["within_error"] for r in sketches.rank_errors(rows, wrong).collect()] == [False]
    exact = spark.createDataFrame([("code", 500)], "column_name string, distinct_values long")
    review = sketches.distinct_review(sketches.partition_sketches(rows, F.col("month"), ["code"], []))
    assert [r["within_error"] for r in sketches.distinct_errors(review, exact).collect()] == [False]
