import numpy as np
import pytest
from pyspark.sql import functions as F

from precinct.operators import quantiles

PROBES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, values, **limits):
    rows = [(None if v is None else float(v),) for v in values]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "x double"), ["x"], PROBES)["x"]
    clean = np.array([v for v in values if v is not None and np.isfinite(v)], dtype=float)
    for q in PROBES:
        assert got[q] == pytest.approx(np.quantile(clean, q), rel=1e-12, abs=1e-12)


@pytest.fixture(params=[50_000, 40])
def sort_rows(request, monkeypatch):
    """With the small bound every rank has to be bracketed more than once, by coarse sketches."""
    monkeypatch.setattr(quantiles, "SORT_ROWS", request.param)
    monkeypatch.setattr(quantiles, "BINS", 16)
    if request.param < 1000:
        monkeypatch.setattr(quantiles, "ACCURACY", 50)


def test_uniform_and_heavy_tail(spark, sort_rows):
    random = np.random.default_rng(7)
    check(spark, random.uniform(-5, 5, 3000))
    check(spark, np.exp(random.normal(0, 6, 3000)))


def test_value_that_holds_a_third_of_the_rows(spark, sort_rows):
    random = np.random.default_rng(8)
    check(spark, np.concatenate([np.full(1000, 3.25), random.uniform(0, 10, 2000)]))


def test_null_nan_and_infinite_are_left_out(spark, sort_rows):
    check(spark, [None, float("nan"), float("inf"), 1.0, 2.0, 4.0])


def test_empty_column_has_no_quantile(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.median(df, ["x"]) == {"x": None}


def test_several_columns_in_one_call(spark, sort_rows):
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(500)], "a double, b double")
    table = {r["column_name"]: r["q1"] for r in quantiles.quantile_table(df, ["a", "b"], [0.25], ["q1"]).collect()}
    assert table == {"a": 124.75, "b": -374.25}


def counted(monkeypatch):
    scans = []
    scan = quantiles._scan
    monkeypatch.setattr(quantiles, "_scan", lambda *a: (scans.append(1), scan(*a))[1])
    return scans


def test_three_scans_for_any_number_of_columns(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORT_ROWS", 2000)  # 6 of 2000 shares of 200,000 rows fit, the table does not
    scans = counted(monkeypatch)
    df = spark.range(200_000).select(*[(F.xxhash64("id", F.lit(i)) / 1e12).alias(f"c{i}") for i in range(5)])
    got = quantiles.exact_quantiles(df, df.columns, [0.25, 0.5, 0.75])
    assert len(scans) == 3
    rows = df.toPandas()
    for c in df.columns:
        assert [got[c][q] for q in (0.25, 0.5, 0.75)] == pytest.approx(list(np.quantile(rows[c], [0.25, 0.5, 0.75])), rel=1e-12)


def test_a_sketch_that_is_wrong_costs_scans_not_results(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORT_ROWS", 100)
    sketched = quantiles._sketched
    monkeypatch.setattr(quantiles, "_sketched", lambda *a: ([(n, low, high, [low + 1.0] * len(at)) for n, low, high, at in sketched(*a)[0]], {}))
    scans = counted(monkeypatch)
    check(spark, np.random.default_rng(9).normal(0, 9, 4000))
    assert len(scans) > 3


def test_other_aggregates_ride_along(spark, monkeypatch):
    scans = counted(monkeypatch)
    df = spark.createDataFrame([(1.0, "a"), (3.0, None), (float("nan"), "b")], "x double, name string")
    found, extra = quantiles.quantiles_and(df, ["x"], [0.5], {"rows": F.count("*"), "named": F.count("name")})
    assert found == {"x": {0.5: 2.0}} and extra == {"rows": 3, "named": 2} and len(scans) <= 3
