import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from precinct.operators import relational as rel
from precinct.operators.splits import stratified_split, time_split, with_split, split_coverage
from precinct.schema import area_dimension
from precinct.session import settle
from conftest import rows_of


def test_repeated_keys_and_their_rows(tiny):
    assert [r["case_number"] for r in rel.repeated_keys(tiny, "case_number").collect()] == ["A2"]
    assert sorted(r["unique_key"] for r in rel.rows_with_repeated_key(tiny, "case_number").collect()) == [2, 3]


def test_lookup_gives_the_default_and_works_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    table = settle(spark.createDataFrame([("a", 0.5), ("c", 0.1)], "k string, v double"))
    want = {("a", 0.5), ("b", 0.0), (None, 0.0)}
    assert set(rows_of(rel.lookup(rows, table, ["k"], {"v": 0.0}))) == want
    wide = rel.lookup(rows, table, ["k"], {"v": 0.0}, rows=10**9)
    assert "ResolvedHint" not in wide._jdf.queryExecution().analyzed().toString()
    assert set(rows_of(wide)) == want


def test_area_names_for_listed_unlisted_and_absent_ids(spark, tiny):
    got = {r["unique_key"]: r["area_name"] for r in rel.with_area(tiny, area_dimension(spark), "community_area").collect()}
    assert (got[1], got[9], got[6]) == ("Rogers Park", "Area 90", None)
    named = rel.with_area(tiny, area_dimension(spark), "community_area", unknown="Unknown area")
    assert {r["area_name"] for r in named.filter("unique_key = 6").collect()} == {"Unknown area"}


def test_area_dimension_is_complete(spark):
    rows = area_dimension(spark).collect()
    assert [r["area_id"] for r in rows] == list(range(1, 78))
    assert {r["area_id"]: r["district"] for r in rows}[68] == 7


def test_key_checks(spark, tiny):
    rel.assert_unique_key(tiny, "unique_key")
    rel.assert_one_to_one(tiny, tiny.select("unique_key"), "unique_key")
    with pytest.raises(ValueError):
        rel.assert_unique_key(tiny, "case_number")
    with pytest.raises(ValueError):
        rel.assert_one_to_one(tiny, tiny.filter("unique_key > 1"), "unique_key")
    with pytest.raises(ValueError):
        rel.assert_same_keys(tiny.filter("unique_key > 1"), tiny, "unique_key")
    with pytest.raises(ValueError):
        rel.assert_one_to_one(tiny, tiny.unionByName(tiny.filter("unique_key = 1")), "unique_key")


def test_unseen_classes(tiny):
    train, _, test = time_split(tiny, "2025-01-01", "2025-06-01")
    assert {r[0] for r in rel.unseen_classes(test, train, "primary_type").collect()} == {"ARSON"}


def test_n_distinct_counts_null_on_request(tiny):
    assert rel.n_distinct(tiny, "ward").first()[0] == 5
    assert rel.n_distinct(tiny, "ward", count_null=True).first()[0] == 6


def test_ties_break_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "t string")
    assert [r["t"] for r in rel.top_groups(df, "t", 2).collect()] == ["c", "a"]
    assert dict(rows_of(rel.label_by_frequency(df, "t"))) == {"c": 0.0, "a": 1.0, "b": 2.0}
    assert dict(rows_of(rel.label_by_name(df, "t"))) == {"a": 0.0, "b": 1.0, "c": 2.0}
    assert rel.argmax_row(rel.value_counts(df, "t").filter("t <> 'c'"), "count", "t").first()["t"] == "a"


def test_unseen_class_gets_minus_one(spark):
    train = spark.createDataFrame([("a",)], "t string")
    rows = spark.createDataFrame([("a",), ("z",)], "t string")
    assert dict(rows_of(rel.apply_labels(rows, rel.label_by_name(train, "t"), "t").select("t", "label"))) == {"a": 0.0, "z": -1.0}


def test_class_weights_and_prior(tiny):
    weights = dict((r["primary_type"], r["weight"]) for r in rel.class_weights(tiny, "primary_type").collect())
    assert weights["THEFT"] == pytest.approx(12 / (4 * 6)) and weights["ARSON"] == pytest.approx(3.0)
    prior = {r["primary_type"]: (r["rank"], r["share"]) for r in rel.class_prior(tiny, "primary_type").collect()}
    assert prior["THEFT"] == (1, 0.5) and prior["ARSON"][0] == 3 and prior["ROBBERY"][0] == 4


def test_time_split_is_half_open_and_complete(tiny):
    parts = time_split(tiny, "2025-01-02", "2025-06-01 18:00:00", check=True)
    assert [p.count() for p in parts] == [5, 3, 4]
    with pytest.raises(ValueError):
        time_split(tiny, "2020-01-01", "2021-01-01", check=True)
    assert {r["split"]: (r["rows"], r["unseen_targets"]) for r in
            split_coverage(with_split(tiny, "2025-01-02", "2025-06-01")).collect()} == {
        "train": (5, 0), "validation": (3, 1), "test": (4, 1)}


@pytest.mark.parametrize("bits", [2, 16])
def test_stratified_split_is_exact_with_a_hot_class(spark, bits):
    rows = [(i, "hot" if i % 3 else f"c{i % 5}") for i in range(3000)] + [(5000, "single")]
    got = stratified_split(spark.createDataFrame(rows, "unique_key long, t string"), "t", 0.2, bucket_bits=bits).collect()
    by_class = defaultdict(list)
    for k, t in rows:
        by_class[t].append((int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16), k))
    want = {k for members in by_class.values() for _, k in sorted(members)[:int(0.2 * len(members) + 0.5)]}
    assert {r["unique_key"] for r in got if r["part"] == "test"} == want
    assert len(got) == len(rows)


def test_set_operations(tiny):
    twice = rel.union_all(tiny, tiny)
    assert rel.drop_exact_duplicates(twice).count() == 12
    assert rel.drop_duplicates_by(tiny, "case_number").count() == 11
    assert rel.distinct_values(tiny, "primary_type").count() == 4
    assert rel.keep_top_classes(tiny, "primary_type", 2).count() == 10
    assert rel.drop_missing(tiny, ["ward", "community_area"]).count() == 10


def test_ordering_operators(tiny):
    assert [r["unique_key"] for r in rel.recent(tiny, "date", "unique_key", 3).collect()] == [12, 11, 9]
    assert [r["unique_key"] for r in rel.chronological(tiny, "date", "unique_key").collect()][:3] == [1, 2, 3]
    counts = rel.value_counts(tiny, "primary_type")
    assert [r[0] for r in rel.extremes(counts, "count", 2, "primary_type").collect()] == ["ARSON", "ROBBERY"]
    assert rel.coverage(tiny, "date").first()["count"] == 12
    assert Counter(r["count"] for r in rel.coverage(tiny, "date", "year").collect()) == Counter([5, 7])


def test_cumulative_share_ends_at_100(tiny):
    rows = rel.cumulative_share(rel.value_counts(tiny, "primary_type"), "primary_type").orderBy("cumulative_pct").collect()
    assert rows[-1]["cumulative_pct"] == pytest.approx(100) and sum(r["share_pct"] for r in rows) == pytest.approx(100)


def test_null_counts_and_fill(tiny):
    assert rel.null_counts(tiny, ["ward", "location_description"]).first() == (1, 1)
    assert rel.fill(tiny, {"ward": -1}).filter("ward = -1").count() == 1
    assert rel.approx_distinct(tiny, ["primary_type"]).first()[0] == 4


def test_approximate_quartiles_are_close(spark):
    q = rel.approx_quartiles(spark.range(10001).select(F.col("id").cast("double").alias("x")), ["x"]).first()
    assert abs(q["q1"] - 2500) < 20 and abs(q["median"] - 5000) < 20 and abs(q["q3"] - 7500) < 20
